"""Near-duplicate texts by circulant MinHash, banding and exact Jaccard verification.

The signature needs two permutations of a 32-bit universe: one scatters the shingles
once, the other is shifted circularly, one place more for each coordinate, and the smallest image is
kept. Bands of a signature are hashed to buckets; texts that share a bucket are
candidates, and a link counts only after the full shingle sets have been compared.

Texts with equal shingle sets form one class, found by a 128-bit digest before banding, so
copies are never paired. The members of a bucket are first paired with one pivot near
the middle of the group, and linked texts become one component; pairs within a component need
no test. What then remains in other components than a bucket's main one is compared with all members of the
bucket, block by block of sets, so that links come out but pairs are never rows.

With 26 bands of 5 rows, a pair at similarity 0.8 is missed with probability below
0.00004, one at 0.9 below 1e-9.

Words are maximal runs of bytes other than white space (0x20, 0x09 to 0x0D), A-Z lower-cased. A text with fewer words
than a shingle has its whole sequence as its one shingle; a null or wordless text has none
and is linked with nothing. Null ids, repeated rows and further columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .decontam import key
from .hashing import blocks, letters, mix64, word_hashes
from .shared import by_blocks, small, spread_join, stored, unused

BANDS, ROWS = 26, 5
#: Members of a block.
CROSS = 64
#: Rows (some 50 bytes each) up to which a side is broadcast; beyond it, it is shuffled.
BROADCAST_ROWS = 200_000
_U = np.uint64
_LETTER = letters("\t\n\x0b\x0c\r ")
_PLACE = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _place(k: int) -> np.uint64:
    """What tells the k-th word of a shingle from the others."""
    return _U(int(_PLACE[k % 7]) * (k + 1) % (1 << 64))


def _permute32(x: np.ndarray, a: int, b: int, out: np.ndarray | None = None) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    out = x.copy() if out is None else out
    for shift, by in ((16, a), (13, b)):
        out ^= out >> np.uint32(shift)
        out *= np.uint32(by)
    out ^= out >> np.uint32(16)
    return out


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text buffer[offsets[i]:offsets[i+1]]: its distinct shingles of `size` words, as sorted 64-bit hashes."""
    first, word = word_hashes(buffer, offsets, _LETTER)
    joined = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        joined += mix64(word[k : k + len(joined)] + _place(k))
    joined = mix64(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            got = np.sort(joined[a : b - size + 1])
            out.append(got[np.concatenate(([True], got[1:] != got[:-1]))])
        elif b > a:
            whole = sum((mix64(word[a + k : a + k + 1] + _place(k)) for k in range(b - a)), np.full(1, b - a, np.uint64))
            out.append(mix64(whole))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes, one row for each set; no set may be empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    joined = np.concatenate(sets)
    scattered = _permute32((joined ^ (joined >> _U(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.zeros((len(sets), bands), np.uint64)
    room = np.empty_like(scattered)
    for k in range(bands * rows):
        np.add(scattered, np.uint32(k + 1), out=room)  # the circular shift
        least = np.minimum.reduceat(_permute32(room, 0x7FEB352D, 0x846CA68B, room), starts)
        band = k // rows
        out[:, band] = mix64(out[:, band] * _PLACE[2] + least.astype(np.uint64) + _U(band + 1))
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The last column is the text; in its place n_shingles, node (digest of the set) and bands."""
    for batch in batches:
        for at, to, data, offsets in blocks(batch.column(batch.num_columns - 1)):
            sets = shingle_sets(data, offsets, size)
            some = [s for s in sets if len(s)]
            found = iter(signatures(some, bands, rows) if some else ())
            node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            hashes = [next(found) if len(s) else None for s in sets]
            kept = [batch.column(i).slice(at, to - at) for i in range(batch.num_columns - 1)]
            new = [pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*batch.schema.names[:-1], "n_shingles", "node", "bands"])


def _verified(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose sets are similar enough."""
    for batch in batches:
        sets = []
        for name in ("text_a", "text_b"):
            mine: list[np.ndarray] = []
            for _, _, data, offsets in blocks(batch.column(name)):
                mine += shingle_sets(data, offsets, size)
            sets.append(mine)
        keep = []
        for x, y in zip(*sets, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _needed_texts(docs: DataFrame, text: str, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text) of each class in pairs."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "k"), "node"))
    nodes = small(nodes, nodes.count(), BROADCAST_ROWS).select("node", "k.k1", "k.k2")
    return docs.select(F.col(text).alias("text"), *key(text)).join(nodes, ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text"))


def _links(docs: DataFrame, text: str, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    texts = stored(_needed_texts(docs, text, pairs, classes))
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda x: _verified(x, size, percent), "a binary, b binary")


def _shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(node, text) become (node, set): sorted hashes of the text's shingles."""
    for batch in batches:
        for at, to, data, offsets in blocks(batch.column("text")):
            sets = [s.view(np.int64) for s in shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, to - at), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])


def _crossed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (mine, other) of members (node, root, set) become the links (a, b) between different roots."""
    for batch in batches:
        found: set[tuple[bytes, bytes]] = set()
        sides = []
        for name in ("mine", "other"):
            column = batch.column(name)
            flat = column.flatten()
            sets = flat.field("set")
            ends, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            bounds = column.offsets.to_numpy() - column.offsets[0].as_py()
            sides.append((bounds, flat.field("node").to_pylist(), flat.field("root").to_pylist(), [values[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]))
        (at1, node1, root1, sets1), (at2, node2, root2, sets2) = sides
        for i in range(len(batch)):
            other = range(at2[i], at2[i + 1])
            words, inverse = np.unique(np.concatenate([sets2[k] for k in other]), return_inverse=True)
            sizes = np.array([len(sets2[k]) for k in other])
            has = np.zeros((len(words), len(other)), np.uint8)
            has[inverse, np.repeat(np.arange(len(other)), sizes)] = 1
            for j in range(at1[i], at1[i + 1]):
                place = np.searchsorted(words, sets1[j]).clip(max=len(words) - 1)
                both = has[place[words[place] == sets1[j]]].sum(0, dtype=np.int64)
                for k in np.flatnonzero(100 * both >= percent * (len(sets1[j]) + sizes - both)).tolist():
                    if root1[j] != root2[other[k]]:
                        found.add((min(node1[j], node2[other[k]]), max(node1[j], node2[other[k]])))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _cross_links(docs: DataFrame, text: str, left: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different roots in the buckets of left (h, node, root, main, rows): members outside the main root against all, block by block."""
    nodes = left.select("node").distinct()
    texts = _needed_texts(docs, text, nodes.select(F.col("node").alias("a"), F.col("node").alias("b")), classes)
    sets = texts.mapInArrow(lambda b: _shingled(b, size), "node binary, set array<long>")
    return by_blocks(left.join(sets, "node"), "h", ["node", "root", "set"], F.col("root") != F.col("main"), F.lit(CROSS), lambda b: _crossed(b, percent), "a binary, b binary").distinct()


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def classes_and_rows(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(node, root) of each class that isn't its component's first, and a row (id, k1, k2, n_shingles, node) for each document."""
    keyed = docs.select(F.col(doc_id).alias("id"), *key(text), F.col(text).alias("text"))
    schema = keyed.drop("text").withColumns({"n_shingles": F.lit(0).cast("long"), "node": F.lit(None).cast("binary"), "bands": F.lit(None).cast("array<long>")}).schema
    signed = stored(keyed.mapInArrow(lambda b: _signed(b, size, bands, rows), schema))
    documents = signed.drop("bands")
    classes = stored(signed.where("node is not null").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    dealt = classes.select("node", "n", F.explode("bands").alias("h"))
    many = dealt.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(dealt.join(many, "h"))
    # Texts near the middle of a group share more buckets with more others.
    middle = stored(members.groupBy("node").agg(F.sum("size").cast("double").alias("w")))
    members = stored(members.drop("size").join(middle, "node"))
    # Round one pairs all members of a bucket with its most central text.
    pivot = F.max(F.struct("w", "node", "n")).alias("p")
    pairs = members.join(members.groupBy("h").agg(pivot), "h").select("node", "n", F.col("p.node").alias("node2"), F.col("p.n").alias("n2")).where("node <> node2")
    most = F.least("n", "n2")
    pairs = stored(pairs.where(F.lit(100) * most >= F.lit(percent) * (F.col("n") + F.col("n2") - most)).select(*_pairs("node", "node2")).distinct())
    links = stored(_links(docs, text, pairs, classes, size, percent))
    found = stored(components(links))
    # Round two looks at buckets whose members are in several components; a member without links is one of its own.
    at = members.select("h", "node", "w").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = at.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("w", "node", "root")).alias("p"), F.count("*").alias("rows")).where("lo <> hi").select("h", F.col("p.root").alias("main"), "rows")
    left = stored(at.join(mixed, "h").select("h", "node", "root", "main", "rows"))
    more = stored(_cross_links(docs, text, left, classes, size, percent))
    if more.take(1):
        found = stored(components(links.unionByName(more)))
    return found, documents


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """A row for each row of docs: id, k1, k2 (key of its text), n_shingles, component (smallest id it reaches), first (the key of the one row of its group to keep)."""
    found, documents = classes_and_rows(docs, doc_id, text, size, percent)
    mine = F.struct("id", "k1", "k2")
    tops = documents.where("node is not null").groupBy("node").agg(F.min("id").alias("component"), F.min(F.when(F.col("id").isNotNull(), mine)).alias("first"), F.min(mine).alias("any"))
    tops = stored(tops.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = tops.groupBy("root").agg(F.min("component").alias("component"), F.coalesce(F.min("first"), F.min("any")).alias("first"), F.count("*").alias("rows"))
    by_node = spread_join(tops.select("node", "root"), best, "root", "rows", tops.count()).drop("root")
    return documents.join(by_node, "node", "left").select("id", "k1", "k2", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"), "first")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id stays, and wordless rows stay. All columns are kept."""
    rows = stored(groups(docs, doc_id, text, size, percent).where("first is not null"))
    copies = rows.groupBy("id", "k1", "k2").agg(F.count("*").alias("n"), F.first("first").alias("first"))
    keeps = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    gone = stored(copies.where(~keeps | (F.col("n") > 1)).select("id", "k1", "k2", keeps.alias("again")))
    n = gone.count()
    i, one, two, again = unused(docs, "id", "k1", "k2", "again")
    gone = small(gone, n, BROADCAST_ROWS).toDF(i, one, two, again)
    keyed = docs.withColumns(dict(zip((one, two), key(text), strict=True)))
    same = keyed[doc_id].eqNullSafe(gone[i]) & (keyed[one] == gone[one]) & (keyed[two] == gone[two])
    main = keyed.join(gone, same, "left_anti")
    back = keyed.join(gone.where(again), same, "left_semi").dropDuplicates([doc_id, one, two])
    return main.unionByName(back).select(*docs.columns)

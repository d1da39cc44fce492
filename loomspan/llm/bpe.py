"""Byte-level BPE encoding and decoding of whole texts.

A text of at most `chunk` characters is one chunk and is encoded where it lies. A
longer one is cut into overlapping chunks that are dealt over the cluster and
pre-tokenised in parallel. Two neighbours are stitched at the first pre-token
boundary that both have inside their overlap: a match of the pattern depends
only on what follows its start, so from a common boundary on both agree. The pieces
between such boundaries are encoded; ids are concatenated in order, and decoding
concatenates the raw bytes of the ids.

Where neighbours share no boundary (a pre-token as long as the overlap), the piece goes on to the
first place of a later chunk where a space or line feed follows another character: no pre-token spans
such a place, wherever matching began. So results stay exact, and only the run itself is held whole.

Stretches of more than WHOLE characters without such a place are matched by another module first, and
each pre-token is merged alone, so that runs of millions of characters are safe.

Defined cases: a null text counts as empty and gives no ids; equal long texts are
encoded once and given to each of their rows; repeated rows, null ids and further
columns are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import unused

#: Characters of a chunk, and characters that it shares with the next.
CHUNK, OVERLAP = 1 << 15, 256
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters that the library's own matcher is given at once: it keeps a stack as deep as a run is long.
WHOLE = 20_000
#: No pre-token spans such a place.
_CUT = re.compile(r"(?<=\S)[ \n]")


@lru_cache(2)
def _codec(path: str):
    """The tokenizer of a rank file and the decimal text of each id."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc, [str(i) for i in range(max(ranks.values()) + 1)]


def encode(text: str, path: str = RANKS) -> list[int]:
    """Ids of a text of any length; runs of any length are safe."""
    enc = _codec(path)[0]
    if len(text) <= WHOLE:
        return enc.encode_ordinary(text)
    import regex

    out: list[int] = []
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + WHOLE // 2)
        to = cut.start() if cut else len(text)
        part = text[at:to]
        if len(part) <= WHOLE:
            out += enc.encode_ordinary(part)
        else:
            for m in regex.finditer(public_tokenizers.PATTERN, part):
                out += enc._core_bpe.encode_single_piece(m[0].encode())
        at = to
    return out


def decode(ids: list[int], path: str = RANKS) -> bytes:
    return _codec(path)[0].decode_bytes(ids)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    """The last column is the text; in its place: number of ids, decimal ids joined by spaces, decoded bytes, or both hashed."""
    enc, names = _codec(path)
    kind = pa.string() if digests else pa.binary()
    for batch in batches:
        n, ids, raw = [], [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            got = encode(text or "", path)
            joined, decoded = " ".join(map(names.__getitem__, got)), enc.decode_bytes(got)
            n.append(len(got))
            ids.append(hashlib.sha256(joined.encode()).hexdigest() if digests else joined)
            raw.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
        kept = [(batch.schema.field(i), batch.column(i)) for i in range(batch.num_columns - 1)]
        new = [(pa.field("n_tokens", pa.int64()), pa.array(n, pa.int64())), (pa.field("ids_sha256" if digests else "ids", pa.string()), pa.array(ids, pa.string())), (pa.field("decoded_sha256" if digests else "raw", kind), pa.array(raw, kind))]
        yield pa.RecordBatch.from_arrays([a for _, a in kept + new], schema=pa.schema([f for f, _ in kept + new]))


def _split(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    names = ["digest", "idx", "start", "last", "part"]
    for batch in batches:
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(digest, i, s, s + chunk >= len(text), text[s : s + chunk + overlap] if s + chunk < len(text) else text[s:]) for i, s in enumerate(range(0, len(text), chunk))]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 64], strict=True)], names=names)


def boundaries(part: str, start: int, last: bool, chunk: int, overlap: int) -> tuple[list[int], list[int], int | None]:
    """Ends of pre-tokens of a chunk, as offsets in the text: within the overlap with the chunk before, and with the one after; and its first sure place beyond the former.

    In the second list no white space stands before a boundary, so that the piece that ends there is
    split alone as it is in the text; where boundaries before white space exist, only these count.
    """
    import regex

    head, tail = [start], []
    for m in regex.finditer(public_tokenizers.PATTERN, part):
        e = m.end()
        if e <= overlap:
            head.append(start + e)
        if chunk <= e < len(part) and not last and not part[e - 1].isspace():
            tail.append(e)
    if plain := [e for e in tail if part[e] in " \n\t\r"]:
        tail = plain
    sure = _CUT.search(part, overlap + 1, chunk)
    return head, [start + e for e in tail], start + sure.start() if sure else None


def _bounded(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        both = [boundaries(*x, chunk, overlap) for x in zip(rows["part"], rows["start"], rows["last"], strict=True)]
        new = [pa.array([b[k] for b in both], kind) for k, kind in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "head", "tail", "sure"])


def pieces(texts: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (digest, piece, text) of texts (digest, text): each can be encoded alone. Equal digests count once."""
    if overlap * 2 > chunk:
        raise ValueError("a chunk must be at least twice as long as the overlap")
    parts = (
        texts.mapInArrow(lambda b: _split(b, chunk, overlap), "digest string, idx long, start long, last boolean, part string")
        .dropDuplicates(["digest", "idx"])
        .mapInArrow(lambda b: _bounded(b, chunk, overlap), "digest string, idx long, start long, last boolean, part string, head array<long>, tail array<long>, sure long")
    )
    order = Window.partitionBy("digest").orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    now = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    known = F.coalesce(F.max(F.when((F.col("idx") == 0) | F.col("sure").isNotNull(), F.col("idx"))).over(now), F.lit(0))
    parts = parts.withColumn("cut", F.when(~F.col("last"), cut)).withColumn("lost", F.max(F.when(F.col("cut").isNull(), F.col("idx"))).over(before))
    # A chunk's boundaries count from its sure place, or from where a chunk whose boundaries count was stitched to it.
    parts = parts.withColumn("cut", F.when(F.coalesce("lost", F.lit(-1)) < known, F.col("cut")))
    parts = parts.withColumn("came", F.lag("cut").over(order))
    parts = parts.withColumn("begin", F.when(F.col("idx") == 0, F.lit(0)).otherwise(F.coalesce("came", "sure") - F.col("start")))
    parts = parts.withColumn("end", F.when(F.col("last"), F.length("part")).when(F.col("cut").isNotNull(), F.col("cut") - F.col("start")).otherwise(F.lit(chunk)))
    opens = F.when(F.col("begin").isNotNull(), F.col("idx"))
    parts = parts.withColumns({"piece": F.max(opens).over(now), "open": F.max(opens).over(before)})
    # What lies before a sure place, or a whole chunk without one, continues the piece that is open.
    joins = F.when(F.col("begin").isNull(), F.col("end")).when(F.col("came").isNull() & (F.col("idx") > 0), F.col("begin"))
    sides = F.array(
        F.struct(F.col("open").alias("piece"), F.substring("part", F.lit(1), F.coalesce(joins, F.lit(0)).cast("int")).alias("part")),
        F.struct("piece", F.substring("part", (F.coalesce("begin", "end") + 1).cast("int"), (F.col("end") - F.coalesce("begin", "end")).cast("int")).alias("part")),
    )
    return (
        parts.select("digest", "idx", F.explode(sides).alias("x"))
        .select("digest", "idx", "x.piece", "x.part")
        .where("part <> ''")
        .groupBy("digest", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "part"))).alias("parts"))
        .select("digest", "piece", F.array_join("parts.part", "").alias("text"))
    )


def encode_table(docs: DataFrame, text: str = "text", path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All columns of docs but the text, and n_tokens, ids_sha256, decoded_sha256 of its ids and decoded bytes; columns of docs with these names are replaced."""
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    digest, = unused(docs, "digest")
    others = [c for c in docs.columns if c != text]
    whole = docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias(text))
    short = whole.where(F.length(text) <= chunk)
    short = short.mapInArrow(lambda b: _encoded(b, path, True), short.select(*others, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema)
    long = whole.where(F.length(text) > chunk).withColumn(digest, F.sha2(text, 256))
    done = (
        pieces(long.select(F.col(digest).alias("digest"), F.col(text).alias("text")), chunk, overlap)
        .mapInArrow(lambda b: _encoded(b, path, False), "digest string, piece long, n_tokens long, ids string, raw binary")
        .groupBy("digest")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("i"), F.array_sort(F.collect_list(F.struct("piece", "raw"))).alias("r"))
        .select(F.col("digest").alias(digest), "n_tokens", F.sha2(F.array_join(F.filter(F.col("i.ids"), lambda x: x != ""), " "), 256).alias("ids_sha256"), F.sha2(F.aggregate(F.col("r.raw"), F.lit(b""), lambda a, x: F.concat(a, x)), 256).alias("decoded_sha256"))
    )
    return short.unionByName(long.select(*others, digest).join(done, digest).drop(digest))

"""Cross-entropy difference of two matched bigram models.

A target model is trained on chosen documents and a background model on all others. Both
share one vocabulary, the order (two) and the smoothing, so that a difference of
their losses comes from the counts alone. A document's score is the target's loss per
token less the background's: the lower, the more it is like the target. A document that a model was
trained on is scored without its own counts, so that neither model knows it by heart.

    P(w | v) = MIX * c(v, w) / c(v) + (1 - MIX) * (c(w) + ADD) / (N + ADD * V)

V is the number of words, and one for all others. Every word and every pair of words counts exactly: what is gathered grows with the
corpus, is never cut off by frequency and never leaves the tasks as a whole.

Counts come to the texts, not texts to the counts:

1. Texts are tokenised into *chunks* of about CHUNK tokens of one model, stored as packed arrays.
2. Each chunk gives its distinct words and pairs, as sorted hashes with counts, cut by ranges of the hash into buckets. So a
   frequent word is one entry of a chunk, and buckets have equal shares whatever is frequent.
3. A bucket adds up the counts of all chunks, and answers each chunk with the counts of its own entries.
4. A chunk and its answers give the losses of its documents.

The number of buckets grows with the tokens (BUCKET of them each), so that a task's memory doesn't. Words and pairs go by 64-bit
hashes: among a hundred million, the chance that any two share one is below 1 in 1000.

Words are maximal runs of digits, letters a-z and characters from U+0080 on, after A-Z are lower-cased. The first word of a text has no pair.
Defined cases: a null or wordless text has no tokens, losses 0 and score 0; a model without tokens is uniform; ids in the target that are
null are ignored, repeated ones count once; equal texts of different rows count each; null ids, repeated rows and further columns stay; an empty table gives an
empty table; a text of any length is held by one task, as hashes of its words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import blocks, letters, mix64, word_hashes
from .shared import small, stored, unused

MIX, ADD = 0.4, 0.1
#: Tokens of a chunk, and as how many each of its rows counts; tokens for each bucket, and fewest buckets.
CHUNK, ROW, BUCKET, BUCKETS = 2_000_000, 20, 4_000_000, 24
#: Rows of target ids (some 50 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: What a chunk is of: texts of the background, of the target, or texts that no model is trained on.
BACKGROUND, TARGET, NEITHER = range(3)

_LETTER = letters("".join(chr(c) for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)))
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte in columns, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(x: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").reshape(-1)


def _rising(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def _risen(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x), dtype=np.uint64)


def _chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(other columns, mark, text) rows become chunks: other columns as one Arrow stream, tokens of each row, distinct words and each token's place among them."""
    held: dict[int, list] = {}
    sizes: dict[int, int] = {}

    def out(mark: int) -> pa.RecordBatch:
        sizes.pop(mark)
        rows, lengths, words = (list(x) for x in zip(*held.pop(mark), strict=True))
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema) as stream:
            for r in rows:
                stream.write_batch(r)
        return pa.RecordBatch.from_pylist([{"chunk": uuid.uuid4().hex, "mark": mark, "rows": sink.getvalue().to_pybytes(), "lengths": packed(np.concatenate(lengths)), "words": _rising(distinct), "at": packed(at), "tokens": len(at)}], schema=CHUNKS)

    for batch in batches:
        marks = batch.column("mark")
        for mark in pc.unique(marks).to_pylist():
            mine = batch.filter(pc.equal(marks, mark))
            others = mine.select(list(range(mine.num_columns - 2)))
            for at, to, data, offsets in blocks(mine.column(mine.num_columns - 1)):
                first, words = word_hashes(data, offsets, _LETTER)
                held.setdefault(mark, []).append((others.slice(at, to - at), np.diff(first), words))
                sizes[mark] = sizes.get(mark, 0) + len(words) + ROW * (to - at)
                if sizes[mark] > size:
                    yield out(mark)
    for mark in list(held):
        yield out(mark)


CHUNKS = pa.schema([("chunk", pa.string()), ("mark", pa.int32()), ("rows", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()), ("at", pa.binary()), ("tokens", pa.int64())])
CHUNK_KINDS = "chunk string, mark int, rows binary, lengths binary, words binary, at binary, tokens long"


def _tokens(lengths: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: each token's row, places of tokens that have one before them in their row, and the keys of these pairs."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    later = np.flatnonzero(row[1:] == row[:-1]) + 1
    hashed = words[at]
    return row, later, mix64(hashed[later - 1] * _SECOND + hashed[later])


def _parts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range starts in sorted keys, and the end."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Chunks become (bucket, chunk, mark, pairs, keys, counts): sorted distinct words, or pairs, in each bucket's range."""
    for batch in batches:
        for chunk, mark, lengths, words, at in zip(*(batch.column(c).to_pylist() for c in ("chunk", "mark", "lengths", "words", "at")), strict=True):
            words, at = _risen(words), unpacked(at).astype(np.int64)
            _, _, pairs = _tokens(unpacked(lengths).astype(np.int64), words, at)
            rows = []
            for kind, (keys, counts) in enumerate(((words, np.bincount(at, minlength=len(words))), np.unique(pairs, return_counts=True))):
                starts = _parts(keys, buckets)
                rows += [(b, chunk, mark, kind == 1, _rising(keys[s:e]), packed(counts[s:e])) for b, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if e > s]
            for s in range(0, len(rows), 256):
                columns = zip(*rows[s : s + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "mark", "pairs", "keys", "counts"])


def _answered(asked: pa.Table) -> pa.Table:
    """The counts of a bucket, for each chunk and kind in the order of its keys: of the background and of the target; and a row with the bucket's number of words."""
    out, distinct = [], 0
    for kind in (False, True):
        mine = asked.filter(pc.equal(asked["pairs"], kind)).to_pylist()
        if not mine:
            continue
        lists = [_risen(r["keys"]) for r in mine]
        keys = np.concatenate(lists)
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        starts, group = np.flatnonzero(new), np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        marks = np.repeat([r["mark"] for r in mine], [len(x) for x in lists])
        counts = np.concatenate([unpacked(r["counts"]) for r in mine]).astype(np.int64)
        sums = [np.add.reduceat(np.where(marks == m, counts, 0)[order], starts) for m in (BACKGROUND, TARGET)]
        distinct += 0 if kind else int((sums[0] + sums[1] > 0).sum())
        ends = np.cumsum([len(x) for x in lists])
        for r, e, n in zip(mine, ends, map(len, lists), strict=True):
            out.append({"chunk": r["chunk"], "bucket": r["bucket"], "pairs": kind, "background": packed(sums[0][group[e - n : e]]), "target": packed(sums[1][group[e - n : e]]), "distinct": 0})
    out.append({"chunk": None, "bucket": None, "pairs": False, "background": b"", "target": b"", "distinct": distinct})
    return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("pairs", pa.bool_()), ("background", pa.binary()), ("target", pa.binary()), ("distinct", pa.int64())]))


def _own(row: np.ndarray, place: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each token's entry occurs in its own row. counts: how often entries occur in the chunk."""
    out = np.ones(len(row), np.int64)
    many = np.flatnonzero(counts[place] > 1)
    both = row[many] * len(counts) + place[many]
    order = np.argsort(both)
    new = np.ones(len(both), bool)
    new[1:] = both[order[1:]] != both[order[:-1]]
    n = np.diff(np.flatnonzero(new), append=len(both))
    out[many[order]] = np.repeat(n, n)
    return out


def _losses(chunk: dict, answers: list[dict], totals: tuple[int, int], vocabulary: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens of a chunk's rows, and their losses by the background and the target."""
    lengths, words, at = unpacked(chunk["lengths"]).astype(np.int64), _risen(chunk["words"]), unpacked(chunk["at"]).astype(np.int64)
    row, later, keys = _tokens(lengths, words, at)
    known = {(a["pairs"], a["bucket"]): a for a in answers}

    def seen(kind: bool, model: str) -> np.ndarray:
        parts = [unpacked(known[k][model]).astype(np.int64) for k in sorted(known) if k[0] == kind]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    distinct, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    own_word = _own(row, at, np.bincount(at, minlength=len(words)))
    own_pair = _own(row[later], place, times)
    out = []
    for mark, model in ((BACKGROUND, "background"), (TARGET, "target")):
        mine = int(chunk["mark"] == mark)
        word = seen(False, model)[at] - mine * own_word
        total = totals[mark] - mine * lengths[row]
        p = (word + ADD) / (total + ADD * vocabulary)
        before, pair = word[later - 1], seen(True, model)[place] - mine * own_pair
        p[later] = np.where(before > 0, MIX * pair / np.maximum(before, 1) + (1 - MIX) * p[later], p[later])
        out.append(np.bincount(row, -np.log(p), minlength=len(lengths)))
    return lengths, out


def _scored(_: tuple, chunks: pa.Table, answers: pa.Table, totals: tuple[int, int], vocabulary: int) -> pa.Table:
    tables = []
    for chunk in chunks.to_pylist():
        n, (background, target) = _losses(chunk, answers.to_pylist(), totals, vocabulary)
        with pa.ipc.open_stream(chunk["rows"]) as stream:
            rows = stream.read_all()
        per = np.maximum(n, 1)
        for name, x in (("n_tokens", n), ("target_loss", target / per), ("background_loss", background / per), ("score", (target - background) / per)):
            rows = rows.append_column(name, pa.array(x))
        tables.append(rows)
    return pa.concat_tables(tables)


def score(docs: DataFrame, target: DataFrame, unseen: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows of docs with, in place of the text: n_tokens, target_loss, background_loss and their difference, score; columns of docs with these names are replaced.

    target: the ids (first column) of the docs that train the target model. unseen: further rows with the columns of docs, scored as well, that train nothing.
    """
    docs = docs.drop(*({"n_tokens", "target_loss", "background_loss", "score"} - {text, doc_id}))
    others = [c for c in docs.columns if c != text]
    chosen = stored(target.select(F.col(target.columns[0]).alias("_chosen")).where("_chosen is not null").distinct())
    taken, = unused(docs, "chosen")
    chosen = small(chosen.select(F.col("_chosen").alias(taken)), chosen.count(), BROADCAST_ROWS)
    names = [f"c{i}" for i in range(len(others))]  # names of one's own, as those of the table may clash

    def marked(df: DataFrame, mark) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)), mark.cast("int").alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))

    rows = marked(docs.join(chosen, docs[doc_id] == chosen[taken], "left"), F.when(F.col(taken).isNull(), BACKGROUND).otherwise(TARGET))
    if unseen is not None:
        rows = rows.unionByName(marked(unseen, F.lit(NEITHER)))
    chunks = stored(rows.mapInArrow(partial(_chunked, size=chunk), CHUNK_KINDS))
    known = chunks.groupBy("mark").agg(F.sum("tokens").alias("n")).collect()  # three rows
    tokens = {r.mark: r.n for r in known}
    buckets = max(BUCKETS, sum(tokens.values()) // BUCKET)
    asked = chunks.mapInArrow(partial(_asked, buckets=buckets), "bucket int, chunk string, mark int, pairs boolean, keys binary, counts binary")
    # As many partitions as buckets, and later as few chunks in each, so that tasks don't grow with the input.
    answers = stored(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answered, "chunk string, bucket int, pairs boolean, background binary, target binary, distinct long"))
    vocabulary = (answers.agg(F.sum("distinct")).first()[0] or 0) + 1
    kinds = [docs.schema[c].dataType.simpleString() for c in others]
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), "n_tokens long, target_loss double, background_loss double, score double"])
    totals = (tokens.get(BACKGROUND, 0), tokens.get(TARGET, 0))
    both = chunks.repartition(buckets, "chunk").groupBy("chunk").cogroup(answers.where("chunk is not null").repartition(buckets, "chunk").groupBy("chunk"))
    scored = both.applyInArrow(lambda k, a, b: _scored(k, a, b, totals, vocabulary), schema)
    return scored.toDF(*others, "n_tokens", "target_loss", "background_loss", "score")

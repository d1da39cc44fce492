"""Hard-negative mining with a vector-approximation file.

Vectors are of integers. The file holds, for each row, the cell of each of its components: a dimension's range in the whole table is cut into CELLS
cells of equal width. With an anchor, the largest score of a row's cells is linear in their numbers, so that the upper bounds of a block of rows with
a block of anchors are one product of matrices, in floats that hold all its sums exactly. As all cells of a dimension are equally wide, the lower bound lies a fixed gap below it.
Only rows whose bounds leave them a place are scored exactly:

1. positives: rows of the anchor's label whose upper bound isn't below the k-th best score so far;
2. negatives: rows of other labels whose upper bound isn't below the k-th best score so far in one of the positives' windows of scores.

The file is stored in blocks of rows, anchors in blocks of their own; both are split into parts by counted rows, and each task meets a part of the rows with a part of the anchors, read
from the stored tables (a nested-loop join: neither side is copied to disk once more, however many blocks the other has). So a hot label, or anything else but the number of rows, makes no task larger.
A task yields at most k rows for an anchor or a window, and a ranking over these leaves the k best. Of the rows of a block with one label and one vector, only the smallest ids that can win a place are met.
Work grows as anchors times rows: the anchors are a stated query set, against all rows; stored and shuffled bytes grow as the rows, as the file has at most PARTS parts.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; several rows of one id count once, as the smallest label and then the smallest vector;
rows are scored with rows of as many components only (an empty vector scores 0); components beyond +-2**24 after scaling count as that, so that scores fit 64 bits; ties go to the smaller id; an empty table, or one without anchors, gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Cells of a dimension; rows and anchors of a block; anchors whose bounds are held at a time.
CELLS = 64
ROWS, ANCHORS, AT_A_TIME = 8192, 4096, 128
#: Rows of a part of the file, and its parts at most; anchors of a part of theirs. A task meets two parts.
PART, PARTS, ANCHOR_PART = 1 << 18, 64, 1 << 14
#: Rows after which the first bounds are tightened; rows scored exactly at a time.
FIRST, SCORED = 32, 1 << 13
LARGEST = 1 << 24
#: More than any sum of bounds.
FAR = np.int64(1) << np.int64(62)


def scaled(vector: Column, by: float) -> Column:
    """Integers floor(by * x), within LARGEST."""
    edge = F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(by)), -edge), edge)).cast("int"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))), F.lit(True))


def prepared(rows: DataFrame, vec_id: str, label: Column, vector: str, by: float) -> DataFrame:
    """(id, label, v): the rows that take part, each id once."""
    got = rows.where(F.col(vec_id).isNotNull() & label.isNotNull() & usable(F.col(vector))).select(F.col(vec_id).alias("id"), F.struct(label.cast("long").alias("label"), scaled(F.col(vector), by).alias("v")).alias("x"))
    return got.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.label", "x.v")


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _cut(n: int, size: int) -> list[np.ndarray]:
    return np.array_split(np.arange(n), max(1, -(-n // size)))


def _each_dim(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.StructArray]]:
    """Blocks of up to size rows whose vectors have as many components, in the order of their labels."""
    for batch in batches:
        rows = batch.to_struct_array()
        dims, labels = np.asarray(batch.column("dim")), np.asarray(batch.column("label"))
        for dim in np.unique(dims):
            here = np.flatnonzero(dims == dim)
            for part in _cut(len(here), size):
                at = here[part]
                yield int(dim), rows.take(pa.array(at[np.argsort(labels[at], kind="stable")]))


def _parts(block: pa.StructArray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors."""
    return block.field("id").to_numpy(zero_copy_only=False).astype(np.int64), block.field("label").to_numpy(zero_copy_only=False).astype(np.int64), _matrix(block.field("v"), dim).astype(np.int32)


def _packed(dim: int, names: list[str], parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], names=names)


def _first_copies(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the `most` smallest ids of their label and vector."""
    key = np.concatenate([labels[:, None].view(np.uint8).reshape(len(ids), 8), np.ascontiguousarray(v).view(np.uint8).reshape(len(ids), -1)], axis=1)
    _, same = np.unique(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    rank = np.arange(len(ids)) - np.repeat(starts, np.diff(starts, append=len(ids)))
    return np.sort(order[rank < most])


FILE = ["dim", "ids", "labels", "cells", "v"]
ASKING = ["a_dim", "a_ids", "a_labels", "a_v"]
WINDOWS = ["p_ids", "p_scores", "lows", "highs"]


def _file(edges: dict[int, tuple[np.ndarray, np.ndarray]], size: int, copies: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows as bytes: ids, labels, cells (a dimension after another), components in 16 or 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, block in _each_dim(batches, size):
            ids, labels, v = _parts(block, dim)
            kept = _first_copies(ids, labels, v, copies)
            ids, labels, v = ids[kept], labels[kept], v[kept]
            low, width = edges[dim]
            cells = ((v - low) // width).astype(np.uint8).T if dim else np.empty((0, len(v)), np.uint8)
            yield _packed(dim, FILE, [ids, labels, cells, v.astype(np.int16) if np.abs(v).max(initial=0) < 1 << 15 else v])

    return run


def _asking(size: int, width: int = 0, least: int = 0, most: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of anchors as bytes; with a width, also the windows of that many positives, of which those that are missing have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, block in _each_dim(batches, size):
            parts = [*_parts(block, dim)]
            if width:
                of = np.zeros((4, len(block), width), np.int64)
                of[2:] = np.array([FAR, -FAR])[:, None, None]
                for i, found in enumerate(block.field("positives").to_pylist()):
                    for j, p in enumerate(found):
                        s = p["positive_score"]
                        of[:, i, j] = p["positive_id"], s, -(-least * s // 100), most * s // 100
                parts += [*of]
            yield _packed(dim, [*ASKING, *(WINDOWS if width else [])], parts)

    return run


class _Bounds:
    """Upper bounds of the scores of rows, by their cells, with some anchors; gap: how far below them the lower bounds lie."""

    def __init__(self, anchors: np.ndarray, low: np.ndarray, width: np.ndarray):
        a = anchors.astype(np.int64)
        steps = a * width[None, :]
        most = int(np.abs(steps).sum(axis=1).max(initial=0)) * (CELLS - 1)
        self.kind, self.exact = next(((kind, 1 << bits) for kind, bits in ((np.float32, 24), (np.float64, 53)) if most < 1 << bits), (np.int64, FAR))
        self.steps = steps.astype(self.kind)
        self.base = (a * low[None, :] + np.maximum(a, 0) * (width - 1)[None, :]).sum(axis=1)
        self.gap = (np.abs(a) * (width - 1)[None, :]).sum(axis=1)
        self.held: np.ndarray | None = None

    def reaching(self, some: slice, cells: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places, in a row for each of some anchors, of bounds that aren't below the anchor's least score. cells: of the kind of the bounds."""
        steps, least = self.steps[some], self._less_base(some, least)
        n = len(steps) * cells.shape[1]
        if self.held is None or len(self.held) < n:
            self.held, self.found = np.empty(n, self.kind), np.empty(n + 8, bool)
        upper, found = self.held[:n].reshape(len(steps), -1), self.found[: n + -n % 8]
        np.matmul(steps, cells, out=upper)
        np.greater_equal(upper, least[:, None], out=found[:n].reshape(upper.shape))
        found[n:] = False
        # Few are found: eight at a time are passed over.
        at = (np.flatnonzero(found.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        return at[found[at]]

    def _less_base(self, some: slice, scores: np.ndarray) -> np.ndarray:
        """In the kind of the bounds, in which what is beyond these is infinite."""
        x = scores - self.base[some]
        if self.kind is np.int64:
            return x
        return np.where(x > self.exact, np.inf, np.where(x < -self.exact, -np.inf, x)).astype(self.kind)

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        return ((self.steps @ cells.astype(self.kind)).astype(np.int64) + self.base[:, None]).T


def _kth(x: np.ndarray, k: int) -> int:
    """The k-th largest; below everything where there are fewer."""
    return int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -int(FAR)


class _Best:
    """The k best (score, id) of each of n keys so far."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -FAR), np.zeros((n, k), np.int64)

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        may = scores >= self.scores[keys, -1]
        if not may.any():
            return
        k, touched = self.scores.shape[1], np.unique(keys[may])
        keys = np.concatenate([np.repeat(touched, k), keys[may]])
        scores, ids = np.concatenate([self.scores[touched].ravel(), scores[may]]), np.concatenate([self.ids[touched].ravel(), ids[may]])
        order = np.lexsort((ids, -scores, keys))
        top = order[np.searchsorted(keys[order], touched)[:, None] + np.arange(k)]
        self.scores[touched], self.ids[touched] = scores[top], ids[top]


class _Asked:
    """A block of anchors with the best rows of each of its windows, over the blocks of rows that it meets."""

    def __init__(self, ids: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int, at_a_time: int):
        self.ids, self.lows, self.highs, self.at_a_time, self.fresh = ids, lows, highs, at_a_time, True
        self.best = _Best(lows.size, k)

    def meet(self, rows: tuple[np.ndarray, ...], a_labels: np.ndarray, a_v: np.ndarray, edges: tuple[np.ndarray, np.ndarray], same: bool) -> None:
        """same: rows of the anchor's label, itself left out; else those of other labels."""
        bounds, labels = _Bounds(a_v, *edges), rows[1]
        cells = rows[2].astype(bounds.kind)
        if same:
            wanted = np.intersect1d(labels, a_labels)
            pairs = [(slice(*np.searchsorted(labels, [x, x + 1])), slice(*np.searchsorted(a_labels, [x, x + 1]))) for x in wanted]
        else:
            pairs = [(slice(0, len(labels)), slice(0, len(a_labels)))]
        for here, asking in pairs:
            first = here.start
            while first < here.stop:
                last = min(here.stop, first + max(FIRST, 3 * (first - here.start))) if self.fresh else here.stop
                piece = np.ascontiguousarray(cells[:, first:last])
                for a in range(asking.start, asking.stop, self.at_a_time):
                    some = slice(a, min(asking.stop, a + self.at_a_time))
                    self._score(bounds, rows, slice(first, last), piece, some, a_labels, a_v, same)
                first = last
        self.fresh = False

    def _score(self, bounds: _Bounds, rows: tuple[np.ndarray, ...], here: slice, cells: np.ndarray, some: slice, a_labels: np.ndarray, a_v: np.ndarray, same: bool) -> None:
        ids, labels, _, v = rows
        n, width = here.stop - here.start, self.lows.shape[1]
        worst = self.best.scores[:, -1].reshape(self.lows.shape)[some]
        lows, highs = self.lows[some], self.highs[some]
        least = np.where(lows <= highs, np.maximum(lows, worst), FAR).min(axis=1)
        may = bounds.reaching(some, cells, least)
        for at in range(0, len(may), SCORED):
            j, r = np.divmod(may[at : at + SCORED], n)
            j, r = j + some.start, r + here.start
            fits = ids[r] != self.ids[j] if same else labels[r] != a_labels[j]
            j, r = j[fits], r[fits]
            s = np.einsum("ij,ij->i", v[r].astype(np.int64), a_v[j].astype(np.int64))
            which, w = np.nonzero((s[:, None] >= self.lows[j]) & (s[:, None] <= self.highs[j]))
            self.best.add(j[which] * width + w, s[which], ids[r[which]])


def _searched(edges: dict[int, tuple[np.ndarray, np.ndarray]], k: int, same: bool, at_a_time: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs of blocks: the k best rows of each window of each anchor. same: positives, whose only window is open; else negatives."""
    kinds = {"cells": np.uint8, "a_v": np.int32}

    def meet(asked: dict[tuple[int, int], tuple[_Asked, np.ndarray, np.ndarray]], batch: pa.RecordBatch, at: int) -> None:
        dim = batch.column("dim")[at].as_py()
        x = {c: batch.column(c)[at].as_buffer() for c in batch.schema.names if c not in ("dim", "a_dim")}
        got = {c: np.frombuffer(b, kinds.get(c, np.int64)) for c, b in x.items() if c != "v"}
        n, m = len(got["ids"]), len(got["a_ids"])
        v = np.frombuffer(x["v"], np.int16 if x["v"].size == 2 * n * dim else np.int32).reshape(n, dim)
        key = dim, int(got["a_ids"][0])
        if key not in asked:
            of = [np.array(got[c]).reshape(m, -1) for c in WINDOWS] if not same else [np.zeros((m, 1), np.int64)] * 2 + [np.full((m, 1), -FAR), np.full((m, 1), FAR)]
            asked[key] = _Asked(np.array(got["a_ids"]), of[2], of[3], k, at_a_time), of[0], of[1]
        asked[key][0].meet((got["ids"], got["labels"], got["cells"].reshape(dim, n), v), got["a_labels"], got["a_v"].reshape(m, dim), edges[dim], same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[tuple[int, int], tuple[_Asked, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                meet(asked, batch, at)
            del batch  # not held while the next one comes
        for a, p_ids, p_scores in asked.values():
            key, place = np.nonzero(a.best.scores > -FAR)
            anchor, found = a.ids[key // a.lows.shape[1]], [a.best.ids[key, place], a.best.scores[key, place]]
            columns = [anchor, *found] if same else [anchor, p_ids.ravel()[key], p_scores.ravel()[key], *found]
            names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"][: len(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _met(file: DataFrame, asking: DataFrame) -> DataFrame:
    """Each block of rows with each block of anchors, a part with a part in a task, read from both tables without a shuffle."""
    return file.join(asking.hint("shuffle_replicate_nl"), F.col("dim") == F.col("a_dim")).drop("a_dim")


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: Column | None = None, vector: str = "embedding", by: float = 256.0, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each of an anchor's best positives.

    is_anchor: on the id, as column id. least, most: a negative's score in hundredths of its positive's.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    ready = stored(prepared(rows, vec_id, F.col("label") if label is None else label, vector, by))
    asking = ready.where(is_anchor)
    n, n_anchors = ready.count(), asking.count()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    parts = min(PARTS, -(-n // PART))
    anchor_parts = max(-(-n_anchors // ANCHOR_PART), -(-2 * spark.sparkContext.defaultParallelism // parts))
    ranges = ready.select(F.size("v").alias("dim"), F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("dim", "pos").collect()  # one a dimension
    edges: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.empty(0, np.int64), np.empty(0, np.int64))}
    for dim in {r.dim for r in ranges}:
        low, high = (np.array([r[c] for r in ranges if r.dim == dim], np.int64) for c in ("lo", "hi"))
        edges[dim] = low, -(-(high - low + 1) // CELLS)
    binary = " binary, "
    file = stored(ready.repartition(parts, "id").select(F.size("v").alias("dim"), "id", "label", "v").mapInArrow(_file(edges, ROWS, max(positives + 1, negatives)), f"dim int, {binary.join(FILE[1:])} binary"))
    asking = asking.select(F.size("v").alias("dim"), "id", "label", "v")
    blocks = stored(asking.repartition(anchor_parts, "id").mapInArrow(_asking(ANCHORS), f"a_dim int, {binary.join(ASKING[1:])} binary"))
    close = _met(file, blocks).mapInArrow(_searched(edges, positives, True, AT_A_TIME), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    close = close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    chosen = close.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    blocks = stored(asking.join(chosen, "id").repartition(anchor_parts, "id").mapInArrow(_asking(ANCHORS, positives, least, most), f"a_dim int, {binary.join([*ASKING[1:], *WINDOWS])} binary"))
    far = _met(file, blocks).mapInArrow(_searched(edges, negatives, False, AT_A_TIME), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

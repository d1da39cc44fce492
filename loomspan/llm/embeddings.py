"""Near-duplicate embeddings by NN-descent.

Vectors are compared only within a label and a dimension. Equal vectors form one node.

1. Buckets of random hyperplanes, small enough to compare all in them, give first lists of neighbours. There are as many tables of
   buckets as a pair at the threshold needs to meet in one with probability 1 - MISS.
2. NN-descent: round by round, each node's neighbours (in either direction) are compared with one another, as
   neighbours of neighbours are likely neighbours. Only neighbours within twice the threshold's angle are kept: two nodes linked
   with a third lie no further apart. A list holds the best `k`; one that is full of links is saturated and is doubled, up to
   `widest`. Rounds end when none finds a new link.
3. Edges at or above the threshold are links and give components. Buckets that were too large to be compared whole, and whose
   members are in different components, are then compared between these, block by block.
4. A node's links are its edges, in components where no list was saturated to the end. In the others, pairs are never rows: blocks of the
   component are compared with blocks and the links of each node are counted, exactly.
5. Audit: a sample of nodes, which grows with the square root of their number, is compared with all of its label. Where it misses a link, the search
   is repeated with other hyperplanes and its links are added; a recall below LEAST_RECALL after SEARCHES searches is an error.

Shuffles carry vectors in the type they are given in; cosines are computed in double precision.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing, nor does
one with a null label; vectors of different dimensions don't link; equal similarities are taken in the order of node names, which changes no result; repeated rows are copies; null ids and further columns
are allowed; an empty table gives no rows.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import by_blocks, small, spread_join, stored

THRESHOLD, K, WIDEST = 0.93, 10, 40
#: Most bits of a bucket's code, aimed rows of a bucket, rows beyond which one is split, and how often a pair at the threshold may meet in no bucket.
BITS, BUCKET, SPLIT, MISS = 24, 24, 64, 0.05
ROUNDS, SEARCHES, LEAST_RECALL = 8, 3, 0.9
#: Vectors of a block, and of one of a group of more than BLOCK * BLOCK.
BLOCK, LARGE_BLOCK = 256, 2048
#: Blocks of a label that the audit compares under one key.
TOGETHER = 64
#: Labels and dimensions up to which their sizes are broadcast.
BROADCAST_ROWS = 500_000
_LOG = logging.getLogger(__name__)


def _unit(values: np.ndarray, dim: int) -> np.ndarray:
    x = values.reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _members(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray, np.ndarray, np.ndarray]:
    """Of a column of lists of (node, vec, ...): where lists start, the flat members, where vectors start, all their values."""
    flat = column.values
    vec = flat.field("vec")
    return column.offsets.to_numpy(), flat, vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False)


def tables_for(bits: int, threshold: float, miss: float) -> int:
    """Tables of buckets of so many bits, for a pair at the threshold to meet in none of them with probability `miss` at most."""
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if meets >= 1 - miss else math.ceil(math.log(miss) / math.log(1 - meets))


def _coded(batches: Iterator[pa.RecordBatch], seed: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(node, vec, ...) with codes: for each table BITS signs of projections."""
    for batch in batches:
        vec = batch.column("vec")
        offsets, values = vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False)
        dims = np.diff(offsets)
        codes = np.zeros((len(dims), tables), np.int64)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x = np.stack([values[offsets[r] : offsets[r + 1]] for r in rows]).astype(np.float64)
            planes = np.random.default_rng([seed, dim]).standard_normal((dim, tables * BITS))
            signs = ((x @ planes) > 0).reshape(len(rows), tables, BITS)
            codes[rows] = signs @ (1 << np.arange(BITS - 1, -1, -1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])


def _compared(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Lists of members (node, vec, kth, room) become directed edges (a, b, sim): for each member the best that beat its list's last, as many as it has room for."""
    for batch in batches:
        starts, flat, offsets, values = _members(batch.column(0))
        kth, room = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("kth", "room"))
        left, right, sims = [], [], []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            m = e - s
            if m < 2:
                continue
            x = _unit(values[offsets[s] : offsets[e]], int(offsets[s + 1] - offsets[s]))
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            order = np.argsort(-sim, axis=1)[:, : min(m - 1, int(room[s:e].max()))]
            at, rank = np.repeat(np.arange(m), order.shape[1]), np.tile(np.arange(order.shape[1]), m)
            to = order.ravel()
            got = sim[at, to]
            keep = (got > kth[s + at]) & (rank < room[s + at])
            left.append(s + at[keep])
            right.append(s + to[keep])
            sims.append(got[keep])
        if left:
            a, b = (pa.array(np.concatenate(z)) for z in (left, right))
            yield pa.RecordBatch.from_arrays([flat.field("node").take(a), flat.field("node").take(b), pa.array(np.concatenate(sims))], names=["a", "b", "sim"])


def _compare(lists: DataFrame, k: int) -> DataFrame:
    return lists.select("members").mapInArrow(partial(_compared, k=k), "a string, b string, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))


class Search:
    """The graph that one or more NN-descents build over nodes (node, label, dim, vec, n)."""

    def __init__(self, nodes: DataFrame, threshold: float, k: int, widest: int, miss: float, split: int, rounds: int):
        self.nodes, self.threshold, self.k, self.widest, self.split, self.rounds = nodes, threshold, k, widest, split, rounds
        # As an angle, the floor is twice the threshold.
        self.floor = max(-1.0, 2 * threshold * threshold - 1)
        sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("rows"))
        sizes = sizes.withColumn("bits", F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / BUCKET)))).cast("int"))
        enough = [tables_for(b, threshold, miss) for b in range(BITS + 1)]
        self.sizes = stored(sizes.withColumn("tables", F.element_at(F.array(*map(F.lit, enough)), F.col("bits") + 1)))
        #: The same with a broadcast hint where that is small: a row for each label and dimension.
        self.near_sizes = small(self.sizes, self.sizes.count(), BROADCAST_ROWS)
        self.tables = self.sizes.agg(F.max("tables")).first()[0] or 1
        self.graph: DataFrame | None = None
        #: Members (key, node) of buckets that were not compared whole.
        self.large: list[DataFrame] = []

    def _best(self, edges: DataFrame) -> DataFrame:
        """The best of each a, as many as its list holds: k, doubled while it is full of links, up to widest."""
        rank = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        most = edges.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= self.widest)
        links = F.count_if(F.col("sim") >= self.threshold).over(Window.partitionBy("a"))
        return most.withColumn("links", links).withColumn("width", self._width(F.col("links"))).where(F.col("_r") <= F.col("width")).select("a", "b", "sim", "links", "width")

    def _width(self, links):
        k = self.k
        return F.when(links < k, F.lit(k)).otherwise(F.least(F.lit(self.widest), (F.lit(k) * F.pow(F.lit(2), F.floor(F.log2(links / k)) + 1)).cast("int"))).cast("int")

    def _buckets(self, seed: int) -> DataFrame:
        """Lists of nodes that share a bucket of one of the tables; of larger buckets, random parts."""
        vec = self.nodes.schema["vec"].dataType.simpleString()
        coded = self.nodes.select("node", "label", "dim", "vec").mapInArrow(partial(_coded, seed=seed, tables=self.tables), f"node string, label string, dim int, vec {vec}, codes array<long>")
        dealt = coded.join(self.near_sizes, ["label", "dim"])
        dealt = dealt.select("node", "label", "dim", "vec", "bits", "tables", F.posexplode("codes").alias("t", "code")).where(F.col("t") < F.col("tables"))
        key = F.concat_ws(" ", F.lit(str(seed)), "dim", "t", F.expr(f"shiftright(code, {BITS} - bits)"), "label")
        dealt = stored(dealt.select(F.xxhash64(key).alias("key"), "node", "vec"))
        parts = dealt.groupBy("key").agg(F.ceil(F.count("*") / self.split).alias("parts"))
        dealt = dealt.join(parts, "key")
        self.large.append(dealt.where("parts > 1").select("key", "node"))
        part = F.pmod(F.xxhash64("node", "key"), F.col("parts"))
        return dealt.groupBy("key", part.alias("part")).agg(F.collect_list(F.struct("node", "vec", F.lit(self.floor).alias("kth"), F.lit(self.k).alias("room"))).alias("members"))

    def _neighbours(self) -> DataFrame:
        """Lists of the neighbours of each node, in either direction, with the node itself."""
        graph = self.graph
        state = graph.groupBy("a").agg(F.count("*").alias("have"), F.min("sim").alias("last"), F.first("links").alias("links"), F.first("width").alias("width"))
        closed = F.col("links") >= self.widest
        kth = F.when(closed, F.lit(2.0)).when(F.col("have") >= F.col("width"), F.col("last")).otherwise(F.lit(self.floor))
        state = state.select(F.col("a").alias("node"), kth.alias("kth"), F.col("width").alias("room"))
        both = graph.select("a", "b", "sim").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
        rank = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        both = both.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= self.widest + self.k)
        at = both.select(F.col("a").alias("at"), F.col("b").alias("node")).unionByName(both.where("_r = 1").select(F.col("a").alias("at"), F.col("a").alias("node")))
        known = self.nodes.select("node", "vec").join(state, "node", "left")
        known = known.select("node", F.struct("node", "vec", F.coalesce("kth", F.lit(self.floor)).alias("kth"), F.coalesce("room", F.lit(self.k)).alias("room")).alias("member"))
        return at.join(known, "node").groupBy("at").agg(F.collect_list("member").alias("members"))

    def descend(self, seed: int) -> None:
        """A search from new buckets; what it finds is added to the graph."""
        found = _compare(self._buckets(seed), self.k)
        if self.graph is not None:
            found = found.unionByName(self.graph.select("a", "b", "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
        self.graph = stored(self._best(found))
        for _ in range(self.rounds):
            new = stored(_compare(self._neighbours(), self.k).join(self.graph.select("a", "b"), ["a", "b"], "left_anti"))
            links = new.agg(F.count_if(F.col("sim") >= self.threshold)).first()[0]
            if not links:
                break
            self.graph = stored(self._best(self.graph.select("a", "b", "sim").unionByName(new)))

    def links(self) -> DataFrame:
        """Links (a, b) in both directions."""
        over = self.graph.where(F.col("sim") >= self.threshold).select("a", "b")
        return over.unionByName(over.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

    def bridges(self, roots: DataFrame) -> DataFrame:
        """Pairs of roots (a, b) that links join between members of buckets that were not compared whole."""
        large = self.large[0]
        for more in self.large[1:]:
            large = large.unionByName(more)
        at = stored(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        sizes = at.groupBy("key", "root").agg(F.count("*").alias("c"))
        main = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"), F.sum("c").alias("rows")).where("roots > 1").drop("roots")
        dealt = at.join(main, "key").withColumn("minor", F.col("root") != F.col("main"))
        return by_blocks(dealt.join(self.nodes.select("node", "vec"), "node"), "key", ["node", "vec", "root"], F.col("minor"), _block(), partial(_bridged, threshold=self.threshold), "a string, b string").distinct()


def _block() -> Column:
    return F.when(F.col("rows") > BLOCK * BLOCK, F.lit(LARGE_BLOCK)).otherwise(F.lit(BLOCK))


def _bridged(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (mine, other) of members (node, vec, root) become the pairs of roots (a, b) that their links join, without those that others imply."""
    for batch in batches:
        found: list[tuple[str, str]] = []
        (s1, f1, o1, v1), (s2, f2, o2, v2) = (_members(batch.column(i)) for i in (0, 1))
        for i in range(len(batch)):
            a, b, c, d = s1[i], s1[i + 1], s2[i], s2[i + 1]
            dim = int(o1[a + 1] - o1[a])
            at, to = np.nonzero(_unit(v1[o1[a] : o1[b]], dim) @ _unit(v2[o2[c] : o2[d]], dim).T >= threshold)
            names, code = np.unique([*f1.field("root").slice(a, b - a).to_pylist(), *f2.field("root").slice(c, d - c).to_pylist()], return_inverse=True)
            pairs = np.unique(np.stack([code[at], code[b - a + to]], 1), axis=0)
            top = list(range(len(names)))
            for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
                ends = []
                for z in (x, y):
                    while top[z] != z:
                        top[z] = z = top[top[z]]
                    ends.append(z)
                if ends[0] != ends[1]:
                    top[ends[0]] = ends[1]
                    found.append((str(names[x]), str(names[y])))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.string())], names=["a", "b"])


def _counted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (mine, other) of members (node, vec, n) become (node, linked rows of other)."""
    for batch in batches:
        nodes, counts = [], []
        (s1, f1, o1, v1), (s2, f2, o2, v2) = (_members(batch.column(i)) for i in (0, 1))
        for i in range(len(batch)):
            a, b, c, d = s1[i], s1[i + 1], s2[i], s2[i + 1]
            dim = int(o1[a + 1] - o1[a])
            over = _unit(v1[o1[a] : o1[b]], dim) @ _unit(v2[o2[c] : o2[d]], dim).T >= threshold
            mine, other = f1.field("node").slice(a, b - a), f2.field("node").slice(c, d - c)
            over &= np.array(mine.to_pylist())[:, None] != np.array(other.to_pylist())[None, :]
            nodes.append(mine)
            counts.append(over @ f2.field("n").to_numpy(zero_copy_only=False)[c:d])
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(nodes), pa.array(np.concatenate(counts).astype(np.int64))], names=["node", "links"])


def _degrees(search: Search, links: DataFrame, roots: DataFrame, bridged: DataFrame) -> DataFrame:
    """(node, links): linked rows of other nodes. From the graph, or counted in blocks where lists were saturated or a bridge was found."""
    nodes = search.nodes
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    full = search.graph.where(F.col("links") >= search.widest).select(F.col("a").alias("node")).unionByName(bridged.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    dense = whole.join(full, "node").select("root").distinct()
    sizes = whole.join(dense, "root").groupBy("root").agg(F.count("*").alias("rows"))
    members = nodes.select("node", "vec", "n").join(whole, "node").join(sizes, "root")
    counted = by_blocks(members, "root", ["node", "vec", "n"], F.lit(True), _block(), partial(_counted, threshold=search.threshold), "node string, links long")
    plain = links.join(whole.join(dense, "root", "left_anti").select(F.col("node").alias("a")), "a").join(nodes.select(F.col("node").alias("b"), "n"), "b").select(F.col("a").alias("node"), F.col("n").alias("links"))
    return counted.unionByName(plain).groupBy("node").agg(F.sum("links").alias("links"))


def audit(search: Search, degrees: DataFrame) -> float:
    """The share of a sampled node's links that were found, on average over sampled nodes that have links in truth."""
    nodes = search.nodes
    n = search.sizes.agg(F.sum("rows")).first()[0] or 0
    step = max(1, int(n / (200 + 4 * math.sqrt(n)))) if n else 1
    sampled = nodes.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(step)) == 0).select("node", "label", "dim", "vec", "n")
    key = ["label", "dim"]
    parts = max(1, math.ceil(n / step / BLOCK))
    mine = sampled.withColumn("q", F.pmod(F.xxhash64("node"), F.lit(parts))).groupBy(*key, "q").agg(F.collect_list(F.struct("node", "vec", "n")).alias("mine"))
    many = F.ceil(F.col("rows") / LARGE_BLOCK)
    # A label's blocks are dealt over as many keys as it takes for TOGETHER of them in each; only the audited nodes are copied to all.
    copies = F.ceil(many / TOGETHER)
    blocks = nodes.join(search.near_sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), many)).withColumn("copy", F.pmod("block", copies))
    other = blocks.groupBy(*key, "copy", "block").agg(F.collect_list(F.struct("node", "vec", "n")).alias("other"))
    mine = mine.join(search.near_sizes, key).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).select(*key, "copy", "mine")
    truth = mine.join(other, [*key, "copy"]).select("mine", "other").mapInArrow(partial(_counted, threshold=search.threshold), "node string, links long").groupBy("node").agg(F.sum("links").alias("truth"))
    share = truth.where("truth > 0").join(degrees, "node", "left").agg(F.avg(F.coalesce("links", F.lit(0)) / F.col("truth"))).first()[0]
    return 1.0 if share is None else share


def linked(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, k: int = K, widest: int = WIDEST, miss: float = MISS, split: int = SPLIT, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """A row for each vector: vec_id, n_links, component_id (smallest id reachable), kept; and the recall that was measured."""
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    vec = F.col(embedding) if kind in ("float", "double") else F.col(embedding).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0) & F.col(label).isNotNull()
    name = F.concat(F.hex(F.xxhash64(F.lit(1), F.col(label), vec)), F.hex(F.xxhash64(vec, F.col(label), F.lit(2))))
    rows = stored(vectors.select(F.col(vec_id).alias("id"), F.when(F.coalesce(fine, F.lit(False)), name).alias("node"), F.col(label).cast("string").alias("label"), vec.alias("vec")))
    nodes = stored(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.size(F.first("vec")).alias("dim"), F.count("*").alias("n"), F.min("id").alias("least")))
    search = Search(nodes, threshold, k, widest, miss, split, rounds)
    for seed in range(SEARCHES):
        search.descend(seed)
        links = search.links()
        roots = stored(components(links))
        bridged = stored(search.bridges(roots))
        if bridged.take(1):
            roots = stored(components(links.unionByName(bridged)))
        degrees = stored(_degrees(search, links, roots, bridged))
        recall = audit(search, degrees)
        _LOG.info("search %d: recall %.4f of sampled links", seed + 1, recall)
        if recall == 1:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"only {recall:.3f} of the links of sampled vectors were found in {SEARCHES} searches")
    tops = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = stored(tops)
    least = tops.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("rows"))
    known = nodes.select("node", "n").join(spread_join(tops.select("node", "root"), least, "root", "rows", tops.count()), "node").join(degrees, "node", "left")
    known = known.select("node", "component", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("links"))
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    out = rows.select("id", "node").join(known, "node", "left").select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
    return out, recall


def link(vectors: DataFrame, **more) -> DataFrame:
    """The rows of linked()."""
    return linked(vectors, **more)[0]

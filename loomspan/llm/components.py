"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread_join, stored


#: Pairs up to which no key can hold too many of them for one task.
FEW = 1_000_000


def _stars(pairs: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) get the smallest of a and what a is paired with, m. Of many pairs, an a of a large share of them is not gathered in one task."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("rows"))
    return pairs.join(least.drop("rows"), "a") if total <= FEW else spread_join(pairs, least, "a", "rows", total)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for each node of edges (a, b) that isn't the smallest of its component; root is the smallest.

    Each round is joins and grouped minima, stored in the shared folder; the rounds grow
    with the logarithm of a component's size. No links give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (new.n, new.x) == mark or not new.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (new.n, new.x)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, 2 * new.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        if 2 * new.n > FEW:
            large = stored(large)
        small = _stars(large, 2 * new.n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct())

"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import stored

__all__ = ["by_blocks", "read", "small", "spread_join", "stored", "unused"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys that hold more than 1 / HOT of a table's rows, and LEAST_HOT of them, are hot; so there are fewer than HOT.
HOT, LEAST_HOT = 1000, 1000


#: Bytes, written as JSON, up to which a side with texts or lists is broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int, most: int, wide: bool = False) -> DataFrame:
    """df with a broadcast hint where its counted rows are at most `most`; beyond it the planner's shuffle join serves.

    wide: rows hold texts or lists of any length, so that their bytes are added up as well.
    """
    if rows > most:
        return df
    if wide and (df.agg(F.sum(F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def spread_join(many: DataFrame, one: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """many joined with one (unique keys) on a key; rows of hot keys stay where they are, and fewer than HOT rows of one are broadcast to them.

    rows: the column of one that says how many of the `total` rows of many have its key; it is dropped.
    """
    is_hot = (F.col(rows) > LEAST_HOT) & (F.col(rows) * HOT > total)
    if total <= LEAST_HOT:
        return many.join(one.drop(rows), key)
    hot = F.broadcast(one.where(is_hot).drop(rows))
    return many.join(hot.select(key), key, "left_anti").join(one.where(~is_hot).drop(rows), key).unionByName(many.join(hot, key))


def by_blocks(rows: DataFrame, group: str, member: list[str], asks: Column, size: Column, compared, schema: str) -> DataFrame:
    """Blocks of a group's rows that ask, each with all blocks of the group: rows (mine, other) of lists, dealt by group and both blocks, through mapInArrow.

    rows: with columns node and rows (how many the group has). size: rows of a block.
    """
    one = F.struct(*member)
    dealt = rows.withColumn("blocks", F.ceil(F.col("rows") / size)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = stored(dealt.groupBy(group, "block").agg(F.first("blocks").alias("blocks"), F.collect_list(one).alias("other"), F.collect_list(F.when(asks, one)).alias("mine")))
    left = dealt.where(F.size("mine") > 0).select(group, F.col("block").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), "mine")
    # A group's asking blocks as one list of numbers; each block of the group goes to all of them.
    asking = dealt.where(F.size("mine") > 0).groupBy(group).agg(F.collect_list("block").alias("asking"))
    right = dealt.select(group, F.col("block").alias("j"), "other").join(asking, group).select(group, F.explode("asking").alias("i"), "j", "other")
    return left.join(right, [group, "i", "j"]).select("mine", "other").mapInArrow(compared, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df clashes with it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

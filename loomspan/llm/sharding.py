"""Shards by weighted rendezvous hashing of stable record keys.

A key's score in a shard is -weight / ln(u), with u a hash of key and shard in (0, 1); the highest score wins.
With one more shard, a key either stays or moves into the new one. Scores are
expressions on the row, so nothing is shuffled to place it.

slots() then numbers the rows of each shard without gaps. Rows are dealt into
buckets of a shard by all of what they have and by their place in the input, so
that repeated keys spread as well; a bucket's rows are numbered in it and bucket
sizes give where it starts.

Defined cases: a null key is a key like any other; a null text has 0 bytes and the checksum of no
bytes; repeated rows share a shard and get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, unused

#: Buckets in which a shard's rows are numbered.
BUCKETS = 1024


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key among len(weights) weighted shards. A shard's score doesn't depend on the other shards."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)).cast("int")


def slots(rows: DataFrame, shard: str = "shard", buckets: int = BUCKETS) -> DataFrame:
    """rows with a slot for each: 0, 1, ... in its shard. A column of rows named slot is replaced."""
    rows = rows.drop("slot")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    bucket, n, start, i = unused(rows, "_bucket", "_n", "_start", "_i")
    placed = stored(rows.withColumn(bucket, F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(buckets)).cast("int")))
    sizes = placed.groupBy(shard, bucket).agg(F.count("*").alias(n))
    starts = sizes.withColumn(start, F.sum(n).over(Window.partitionBy(shard).orderBy(bucket)) - F.col(n)).drop(n)
    number = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(*columns))
    return placed.withColumn(i, number).join(starts, [shard, bucket]).withColumn("slot", F.col(start) + F.col(i) - 1).select(*columns, "slot")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot): sizes in bytes plus 1; grown_shard with one more shard of the last weight."""
    weights = weights or [1.0] * 16
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(key),
        (F.octet_length(bytes_) + 1).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), [*weights, weights[-1]]).alias("grown_shard"),
    )
    return slots(placed)

"""A table of span operations that batches add to and readers see as whole versions.

Operations lie in buckets, by session. A batch writes one part for each bucket that it touches; a version lists the parts of all buckets, so reading a version opens at most
MOST parts a bucket, however many batches there were: a bucket that has more is written anew, as one. Operations with the same span, number and route are one, the newest. Versions
are numbered by batch: a batch that comes again changes nothing. The last SLOTS versions stay readable; parts that none of them lists can be removed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spans import OPS, fold

BUCKETS, MOST, SLOTS = 256, 8, 4
_PART = f"{OPS}, batch long"


def _version(spark: SparkSession, folder: str) -> tuple[int, dict[int, list[int]]]:
    """The newest version's number, and the parts of each bucket by the batches that wrote them."""
    found: tuple[int, dict[int, list[int]]] = (-1, {})
    for slot in range(SLOTS):
        try:
            rows = spark.read.schema("version long, bucket int, batches array<long>").parquet(f"{folder}/versions/{slot}").collect()  # one a bucket
        except AnalysisException:
            continue
        if rows and rows[0].version > found[0]:
            found = rows[0].version, {r.bucket: list(r.batches) for r in rows if r.bucket >= 0}
    return found


def _parts(spark: SparkSession, folder: str, parts: dict[int, list[int]]) -> DataFrame:
    paths = [f"{folder}/parts/batch={b}/bucket={k}" for k, batches in parts.items() for b in batches]
    return spark.read.schema(_PART).parquet(*paths) if paths else spark.createDataFrame([], _PART)


def _newest(ops: DataFrame) -> DataFrame:
    """Of operations that are the same, the one of the newest batch."""
    n = F.row_number().over(Window.partitionBy("session_id", "route_key", "span_id", "op_seq").orderBy(F.desc("batch")))
    return ops.withColumn("_n", n).where("_n = 1").drop("_n")


def put(ops: DataFrame, folder: str, batch: int, buckets: int = BUCKETS, most: int = MOST) -> None:
    """Adds a batch's operations and publishes the version that has them."""
    spark = ops.sparkSession
    last, parts = _version(spark, folder)
    if batch <= last:
        return
    names = [c.split(" ", 1)[0] for c in OPS.split(", ")]
    dealt = ops.select(*names, F.lit(batch).cast("long").alias("batch"), F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int").alias("bucket"))
    where = f"{folder}/parts/batch={batch}"
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(where)
    touched = [r.bucket for r in spark.read.schema(f"{_PART}, bucket int").option("basePath", where).parquet(where).select("bucket").distinct().collect()]  # at most `buckets`
    for k in touched:
        parts.setdefault(k, []).append(batch)
    full = {k: v for k, v in parts.items() if len(v) > most}
    if full:
        # Written under a number of its own, which no batch has.
        whole = -batch - 1
        again = _newest(_parts(spark, folder, full)).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
        again.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/parts/batch={whole}")
        parts |= {k: [whole] for k in full}
    rows = [(batch, k, v) for k, v in parts.items()] or [(batch, -1, [])]
    spark.createDataFrame(rows, "version long, bucket int, batches array<long>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/{batch % SLOTS}")


def operations(spark: SparkSession, folder: str) -> DataFrame:
    """All operations of the newest version."""
    return _newest(_parts(spark, folder, _version(spark, folder)[1])).drop("batch")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The spans of the newest version, of each route."""
    return fold(operations(spark, folder), "route_key")

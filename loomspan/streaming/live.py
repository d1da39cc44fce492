"""The live path: envelopes arrive as files, spans are kept up to date.

Each micro-batch is written under its number and so are the spans of the sessions that it touches,
made by the same plan as in batch from all that these sessions have sent. A batch that runs again
overwrites what it wrote, and the newest batch of a session counts, so a restart or a repeated
delivery changes nothing. Late events are never dropped.

Events lie in BUCKETS folders of a batch, by session, so that a batch reads again only the buckets of the sessions that it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import sinks, tables, upserts
from ..operators.spans import fold
from . import stateful

LANDED = "source string, session_id string, seq long, event string, ts_ms long, payload string, source_version string"
LANDED_COLUMNS = [c.split(" ")[0] for c in LANDED.split(", ")]


def landed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of envelopes from JSON files."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).json(path)


BUCKETS = 256


def _seen(spark: SparkSession, events: str, path: str, schema) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).option("basePath", events).parquet(path)


def keep_spans(stream: DataFrame, translate: Callable[[DataFrame], DataFrame], events: str, spans: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query. events and spans are folders that this query alone writes."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.dropDuplicates(["session_id", "seq"]).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int"))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{events}/batch={number}")
        touched = _seen(spark, events, f"{events}/batch={number}", batch.schema).select("session_id", "bucket").distinct()
        buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most BUCKETS
        every = _seen(spark, events, events, batch.schema).where(F.col("bucket").isin(buckets)).join(touched, ["session_id", "bucket"], "left_semi")
        every = every.select(*batch.columns).dropDuplicates(["session_id", "seq"])
        with tables.scope(spark):
            fold(translate(every)).write.mode("overwrite").parquet(f"{spans}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, spans: str) -> DataFrame:
    """The spans of each session by its newest batch."""
    every = spark.read.option("basePath", spans).parquet(f"{spans}/batch=*")
    newest = every.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["session_id", "batch"]).drop("batch")


def first_of(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A stream without repetitions of a key within a delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def active(stream: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Stretches of activity of each session; one ends after a gap."""
    timed = stream.withColumn("time", F.timestamp_millis("ts_ms")).withWatermark("time", gap)
    return timed.groupBy("session_id", F.session_window("time", gap)).agg(F.count("*").alias("events"))


def keep_operations(events: DataFrame, folder: str, checkpoint: str, patient: int = stateful.PATIENT, buckets: int = upserts.BUCKETS, **trigger) -> StreamingQuery:
    """Starts a query that translates events one by one (see stateful) and adds the operations to a table (see upserts) that upserts.current reads.

    events: as LANDED, and a route (JSON text, null for none). The state store must be RocksDB, which transformWithState needs.
    """
    routed = sinks.deliveries(events).drop("route").withColumn("seq", F.col("seq").cast("long"))
    ops = stateful.translated(routed, patient)
    return ops.writeStream.foreachBatch(lambda batch, number: upserts.put(batch, folder, number, buckets)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

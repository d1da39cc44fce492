"""Any source: a root for each session, a span of no length for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.ids import span_id
from ...operators.spans import OPS


def debug_ops(events: DataFrame) -> DataFrame:
    """events: source, session_id, seq (from 1), event, ts_ms, payload."""
    sid = F.col("session_id")
    root = span_id(sid, F.lit("root"))
    opened = events.groupBy("session_id").agg(F.min_by("source", "seq").alias("source"), F.min_by("ts_ms", "seq").alias("start_ms"))
    roots = opened.select("session_id", F.lit(0).cast("long").alias("op_seq"), root.alias("span_id"), root.alias("root_span_id"), F.array().cast("array<string>").alias("parent_span_ids"), F.concat_ws(": ", "source", "session_id").alias("name"), F.lit("task").alias("span_type"), "start_ms")
    spans = events.select("session_id", F.col("seq").alias("op_seq"), span_id(sid, F.concat(F.lit("event:"), (F.col("seq") - 1).cast("string"))).alias("span_id"), root.alias("root_span_id"), F.array(root).alias("parent_span_ids"), F.col("event").alias("name"), F.lit("tool").alias("span_type"), F.col("ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), F.col("payload").alias("input"))
    return as_ops(roots.unionByName(spans, allowMissingColumns=True), "insert")


def as_ops(rows: DataFrame, op: str | None = None) -> DataFrame:
    """rows with all columns of a span operation; what is missing is null."""
    if op:
        rows = rows.withColumn("op", F.lit(op))
    out = []
    for column in OPS.split(", "):
        name, kind = column.split(" ", 1)
        out.append((F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name))
    return rows.select(*out)

"""The driver's tables read as agent events and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event of each type of the table events.
EVENTS = {"view": "UserPromptSubmit", "click": "PreToolUse", "purchase": "PostToolUse", "error": "PostToolUseFailure", "signup": "Stop"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, event, ts_ms, call_id, value), ordered by seq in a session."""
    e = table(spark, sf_dir, "events")
    event = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENTS.items()))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
        event.alias("event"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.get_json_object("props", "$.k").alias("call_id"),
        "value",
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, route, pos, role, text), ordered by pos in a session."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), (F.col("conv_id") % 3).alias("route"), F.col("turn").alias("pos"), "role", "text")


#: The same two, for SQL.
ENV = """env AS (SELECT 'u' || user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE event_type WHEN 'view' THEN 'UserPromptSubmit' WHEN 'click' THEN 'PreToolUse' WHEN 'purchase' THEN 'PostToolUse' WHEN 'error' THEN 'PostToolUseFailure' WHEN 'signup' THEN 'Stop' END AS event,
  epoch_us(ts) // 1000 AS ts_ms, json_extract_string(props, '$.k') AS call_id, value FROM events)"""
TRX = """trx AS (SELECT 'c' || conv_id AS session_id, conv_id % 3 AS route, turn AS pos, role, text FROM conversations)"""


def span_sql(session: str, key: str, namespace: str = "8f2b4e119c7a4d3eb6a15f0c2d8471ae") -> str:
    """SQL of a span id."""
    h = f"sha1(unhex('{namespace}') || encode({session} || chr(31) || {key}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr({h}, 17, 1))::INT + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"

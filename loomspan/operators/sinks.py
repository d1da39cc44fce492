"""Where span operations and journals go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_debug(ops: DataFrame, path: str) -> None:
    """Operations as lines `{"Insert": {...}}` or `{"Merge": {...}}`, appended."""
    row = F.struct(*(c for c in ops.columns if c not in ("op", "op_seq", "session_id", "route_key")))
    line = F.when(F.col("op") == "insert", F.to_json(F.struct(row.alias("Insert")))).otherwise(F.to_json(F.struct(row.alias("Merge"))))
    ops.select(line.alias("value")).write.mode("append").text(path)


def redacted(envelopes: DataFrame) -> DataFrame:
    """Envelopes as they are journaled: without credentials."""
    return envelopes.drop("config", "token")


def append_journal(envelopes: DataFrame, path: str) -> None:
    redacted(envelopes).write.mode("append").partitionBy("source").parquet(path)


def expired(files: DataFrame, now_ms: int | Column, days: float = 7) -> DataFrame:
    """Files (path, mtime_ms) that retention removes."""
    return files.where(F.col("mtime_ms") < now_ms - int(days * 86_400_000))


def status(live: DataFrame, errors: DataFrame) -> DataFrame:
    """Live sessions (session_id, queued, spans, last_error), and those that only have an authorisation error."""
    return live.unionByName(errors.join(live, "session_id", "left_anti"), allowMissingColumns=True)


def deliveries(envelopes: DataFrame) -> DataFrame:
    """Envelopes with the key of their delivery: session and route, compared as JSON values."""
    return envelopes.withColumn("route_key", F.coalesce(F.to_json(F.try_parse_json("route")), F.lit("{}")))

"""Turns, tool pairs, histories and other work on ordered session events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(by: str = "seq", *keys: str):
    return Window.partitionBy(*(keys or ("session_id",))).orderBy(by)


def up_to(by: str = "seq", *keys: str):
    return ordered(by, *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(by: str = "seq", *keys: str):
    return ordered(by, *keys).rowsBetween(Window.unboundedPreceding, -1)


def number_turns(events: DataFrame, prompt: Column, by: str = "seq") -> DataFrame:
    """turn: how many prompts came so far."""
    return events.withColumn("turn", F.sum(F.when(prompt, 1).otherwise(0)).over(up_to(by)).cast("long"))


def open_turns(events: DataFrame, prompt: Column, stop: Column, by: str = "seq") -> DataFrame:
    """open_turn: the turn that is open at each event, null after a stop and before the first prompt. Needs turn."""
    mark = F.when(prompt, F.col("turn")).when(stop, F.lit(-1))
    last = F.last(mark, ignorenulls=True).over(up_to(by))
    return events.withColumn("open_turn", F.when(last > 0, last))


def pair_tools(starts: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """First start of each call with the first stop after it: keys, start_ms, end_ms (null if none), stop."""
    first = starts.groupBy(*keys).agg(F.min_by("ts_ms", "seq").alias("start_ms"), F.min("seq").alias("start_seq"))
    after = first.join(stops.select(*keys, F.col("seq").alias("stop_seq"), F.col("ts_ms").alias("stop_ms"), F.col("event").alias("stop_event")), keys, "left")
    late = F.col("stop_seq") > F.col("start_seq")
    return after.groupBy(*keys, "start_ms").agg(F.min_by("stop_ms", F.when(late, F.col("stop_seq"))).alias("end_ms"), F.min_by("stop_event", F.when(late, F.col("stop_seq"))).alias("stop"))


def outer_pair_tools(starts: DataFrame, stops: DataFrame, keys: list[str], duration: Column) -> DataFrame:
    """All calls that have a start or a stop; a stop without a start begins `duration` before, at 0 at the earliest."""
    a = starts.groupBy(*keys).agg(F.min_by("ts_ms", "seq").alias("pre_ms"))
    b = stops.withColumn("_d", duration).groupBy(*keys).agg(F.min_by("ts_ms", "seq").alias("end_ms"), F.min_by("_d", "seq").alias("_d"))
    return a.join(b, keys, "full").withColumn("start_ms", F.coalesce("pre_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("_d")))).drop("_d", "pre_ms")


def history(records: DataFrame, item: str, by: str = "pos", *keys: str) -> DataFrame:
    """history: ordered items of a scope before each record. It grows with the square of a scope; history_ranges doesn't."""
    return records.withColumn("history", F.collect_list(item).over(before(by, *keys)))


def history_ranges(records: DataFrame, by: str = "pos", *keys: str) -> DataFrame:
    """(history_from, history_to): places of a scope whose records come before each record; null at its start."""
    w = before(by, *keys)
    return records.withColumn("history_from", F.min(by).over(w)).withColumn("history_to", F.max(by).over(w))


def cut_at(records: DataFrame, cutoff: Column, by: str = "pos", *keys: str) -> DataFrame:
    """Records before the first whose time is beyond the cutoff, even if later ones are earlier."""
    return records.withColumn("_m", F.max("ts_ms").over(up_to(by, *keys))).where(F.col("_m") <= cutoff).drop("_m")


def first_by(rows: DataFrame, keys: list[str], by: str = "seq") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_r = 1").drop("_r")

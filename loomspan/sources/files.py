"""Journals and transcripts as tables: line-delimited JSON files read in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_name

ENVELOPE = "seq long, source string, source_version string, plugin_version string, session_id string, event string, ts_ms long, managed_run_id string, payload string, route string"


def lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(path, pos, line, end_offset, complete) of files below a folder: a blank line takes its place but is dropped.

    Files are read in blocks, by many tasks where they are large; lines are numbered in their block, and blocks by what comes before them.
    complete says whether a line ends with a line feed; a reader of growing files leaves the last one until it does.
    """
    meta = F.col("_metadata")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").option("lineSep", "\n").text(path)
    rows = rows.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    inside = Window.partitionBy("path", "block").orderBy("at")
    rows = rows.withColumns({"n": F.row_number().over(inside).cast("long"), "bytes": F.sum(F.octet_length("line") + 1).over(inside).cast("long")})
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(F.max("n").alias("lines"), F.max("bytes").alias("length"))
    blocks = blocks.select("path", "block", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines"), F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("length"))
    placed = rows.join(blocks, ["path", "block"]).withColumn("end", F.col("length") + F.col("bytes"))
    placed = placed.select("path", (F.col("lines") + F.col("n") - 1).alias("pos"), "line", F.least("end", "size").alias("end_offset"), (F.col("end") <= F.col("size")).alias("complete"))
    return placed.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")


def journal(spark: SparkSession, path: str, through: int | None = None) -> DataFrame:
    """Envelopes of journal files, in order, up to a byte offset and to before the first line that isn't JSON."""
    read = lines(spark, path, ".ndjson").where(F.lit(True) if through is None else F.col("end_offset") <= through)
    read = read.withColumn("doc", F.try_parse_json("line"))
    broken = F.max(F.col("doc").isNull()).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    read = read.withColumn("broken", broken).where(~F.col("broken"))
    fields = [f.split(" ") for f in ENVELOPE.split(", ")]

    def field(name: str, kind: str) -> Column:
        at = F.try_variant_get("doc", f"$.{name}", "variant")
        return (F.to_json(at) if name in ("payload", "route") else F.try_variant_get("doc", f"$.{name}", kind)).alias(name)

    return read.select("path", *((F.col("pos") + 1).alias(n) if n == "seq" else field(n, k) for n, k in fields))


def replay(spark: SparkSession, path: str, session_id: str, route: str | None, through: int) -> DataFrame:
    """The envelopes of one session and route in a journal, up to the byte offset that was noted when the replay was asked for, in order and numbered anew; what was journaled later is delivered live.

    Routes are equal if they are so as JSON values. Envelopes that were journaled more than once (by session, event, time and payload) stay as often as they are there.
    """
    canonical = F.coalesce(F.to_json(F.try_parse_json("route")), F.lit("{}"))
    wanted = F.coalesce(F.to_json(F.try_parse_json(F.lit(route))), F.lit("{}"))
    mine = journal(spark, path, through).where((F.col("session_id") == session_id) & (canonical == wanted))
    return mine.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("path", "seq")).cast("long"))


def records(spark: SparkSession, path: str, cutoff_ms: int | None = None, through: int | None = None, skip_broken: bool = True, since: int | None = None) -> DataFrame:
    """(path, file, pos, end_offset, ts_ms, rec) of transcripts.

    cutoff_ms: reading stops before the first record with a later time, though earlier times may follow;
    through: only lines that end by this offset, which is exact where times aren't in order; since: only lines that start at this offset or later, in files that are at least as long, all
    of shorter ones. A broken line is skipped, or else kept with a null record.
    """
    read = lines(spark, path).withColumn("rec", F.try_parse_json("line"))
    read = read.withColumn("ts_ms", F.unix_millis(F.try_to_timestamp(F.try_variant_get("rec", "$.timestamp", "string"))))
    if since is not None:
        length = F.max("end_offset").over(Window.partitionBy("path"))
        read = read.withColumn("length", length).where((F.col("end_offset") > since) | (F.col("length") < since)).drop("length")
    if through is not None:
        read = read.where(F.col("end_offset") <= through)
    if cutoff_ms is not None:
        latest = F.max("ts_ms").over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        read = read.withColumn("latest", latest).where(F.col("latest").isNull() | (F.col("latest") <= cutoff_ms))
    if skip_broken:
        read = read.where("rec is not null")
    return read.select("path", base_name(F.col("path")).alias("file"), "pos", "end_offset", "ts_ms", F.to_json("rec").alias("rec"))


def sessions(records: DataFrame) -> DataFrame:
    """(session_id, path, files, fits): the session of each transcript, named by its first record that has one; files > 1 is an error of the caller's data.

    fits says whether the id has only letters, digits, `_` and `-`, and the file's name is the id (Claude) or ends with it (Codex); only such transcripts are imported by discovery. Subagents' have no row.
    """
    r = "rec"
    claude, codex = F.get_json_object(r, "$.sessionId"), F.get_json_object(r, "$.payload.id")
    meta = F.get_json_object(r, "$.type") == "session_meta"
    found = records.groupBy("path").agg(F.min_by(claude, F.when(claude.isNotNull(), F.col("pos"))).alias("claude"), F.min_by(codex, F.when(meta, F.col("pos"))).alias("codex"), F.max(F.get_json_object(r, "$.payload.source.subagent").isNotNull()).alias("child"))
    named = found.where("not coalesce(child, false)").withColumn("session_id", F.coalesce("claude", "codex")).where("session_id is not null")
    name = base_name(F.col("path"))
    own = F.concat("session_id", F.lit(".jsonl"))
    fits = F.col("session_id").rlike(r"\A[A-Za-z0-9_-]+\z") & F.when(F.col("claude").isNotNull(), name == own).otherwise(F.endswith(name, own))
    return named.select("path", "session_id", F.count("*").over(Window.partitionBy("session_id")).alias("files"), fits.alias("fits"))


def preferred(mirror: DataFrame, snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Records (path, ...) of each path from the mirror if it has the path, else the snapshot, else the live file."""
    second = snapshot.join(mirror.select("path").distinct(), "path", "left_anti")
    third = live.join(mirror.select("path").unionByName(snapshot.select("path")).distinct(), "path", "left_anti")
    return mirror.unionByName(second).unionByName(third)

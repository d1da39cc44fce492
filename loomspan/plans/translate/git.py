"""What git knows of the folder that a span was made in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...operators.tables import fitting


def enriched(ops: DataFrame, git: DataFrame | None) -> DataFrame:
    """ops (with a column cwd, null where nothing is looked up) without it, with the metadata of its folder.

    git: (cwd, git map of JSON texts), one row a folder. Its keys win over an operation's own. Inserts get them, and merges that have metadata; other merges stay as they are. A folder
    that git doesn't list, or lists without keys, changes nothing.
    """
    if git is None:
        return ops.drop("cwd")
    if "metadata" not in ops.columns:
        ops = ops.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    columns = [c for c in ops.columns if c != "cwd"]
    none = F.create_map().cast("map<string,string>")
    found = fitting(git.where(F.size("git") > 0).select("cwd", F.col("git").alias("_git")))
    takes = F.col("_git").isNotNull() & ((F.col("op") == "insert") | F.col("metadata").isNotNull())
    both = F.map_zip_with(F.coalesce("_git", none), F.coalesce("metadata", none), lambda k, x, y: F.coalesce(x, y))
    return ops.join(found, "cwd", "left").withColumn("metadata", F.when(takes, both).otherwise(F.col("metadata"))).select(*columns)


def in_folders(ops: DataFrame, events: DataFrame, cwd: Column, git: DataFrame | None, step: int = 10) -> DataFrame:
    """ops of the events numbered op_seq / step, enriched by these events' own folder."""
    if git is None:
        return ops
    at = events.select("session_id", F.col("seq").alias("_at"), cwd.alias("cwd")).where("cwd is not null")
    return enriched(ops.withColumn("_at", F.floor(F.col("op_seq") / step)).join(at, ["session_id", "_at"], "left").drop("_at"), git)

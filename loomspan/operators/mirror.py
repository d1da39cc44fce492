"""Mirrors of growing files: new bytes are copied in pieces by tasks, and only then is it noted how far each mirror reaches.

A mirror is a file named by session and source. What it may be read for is its mark, not its length: bytes beyond the mark are of a copy that was not noted. Pieces are written at
their place, so that a task that runs again writes the same bytes. A source that has become shorter gets a new mirror, of the next generation. Marks are
tables, one a version; the newest complete one counts.

Sources and mirrors lie on a file system that all executors reach by the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import mirror_name
from .routing import mirrored

MARKS = "session_id string, path string, generation long, file string, mirrored long"
PIECE = 64 << 20


def _versions(folder: str) -> list[int]:
    found = os.listdir(f"{folder}/marks") if os.path.isdir(f"{folder}/marks") else []
    return sorted(int(v) for v in found if v.isdigit() and os.path.exists(f"{folder}/marks/{v}/_SUCCESS"))


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, path, generation, file, mirrored): how far each mirror reaches."""
    versions = _versions(folder)
    return spark.read.schema(MARKS).parquet(f"{folder}/marks/{versions[-1]}") if versions else spark.createDataFrame([], MARKS)


def _copied(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(path, "rb") as source:
                    to = os.open(f"{folder}/{file}", os.O_WRONLY | os.O_CREAT, 0o644)
                    try:
                        source.seek(first)
                        while first < last and (block := source.read(min(1 << 20, last - first))):
                            os.pwrite(to, block, first)
                            first += len(block)
                        os.fsync(to)
                    finally:
                        os.close(to)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([max(0, last - first)], pa.int64())], names=["file", "missing"])

    return run


def append(spark: SparkSession, files: DataFrame, folder: str, piece: int = PIECE) -> DataFrame:
    """Brings the mirrors of files (session_id, path, size) up to date; the marks after that. Files that aren't listed keep theirs."""
    os.makedirs(folder, exist_ok=True)
    versions, old = _versions(folder), marks(spark, folder)
    key = ["session_id", "path"]
    now = files.select(*key, "size").join(old, key, "left").withColumns({"mirrored": F.coalesce("mirrored", F.lit(0)), "generation": F.coalesce("generation", F.lit(0).cast("long"))})
    plan = now.join(mirrored(now.withColumn("session_id", F.struct(*key))).select("session_id.*", "from_offset", "rebuilds"), key)
    plan = plan.withColumn("generation", F.col("generation") + F.col("rebuilds").cast("long"))
    plan = plan.withColumn("file", F.concat(F.regexp_replace(mirror_name(F.col("session_id"), F.col("path")), r"\.jsonl$", ""), F.lit("."), F.col("generation").cast("string"), F.lit(".jsonl")))
    pieces = plan.where("size > from_offset").select("path", "file", F.explode(F.sequence("from_offset", F.col("size") - 1, F.lit(piece).cast("long"))).alias("first"), "size").select("path", "file", "first", F.least(F.col("first") + piece, "size").alias("last"))
    done = pieces.repartition(F.col("file"), F.col("first")).mapInArrow(_copied(folder), "file string, missing long")
    if done.where("missing > 0").count():
        raise OSError("a file became shorter while it was mirrored")
    kept = old.join(files.select(*key), key, "left_anti")
    new = plan.select(*key, "generation", "file", F.col("size").alias("mirrored")).unionByName(kept)
    new.write.mode("overwrite").parquet(f"{folder}/marks/{(versions[-1] if versions else 0) + 1}")
    return marks(spark, folder)


def mirrored_lines(spark: SparkSession, folder: str, lines) -> DataFrame:
    """Lines of all mirrors up to their marks, under the paths of their sources. lines: reads a folder's files as (path, pos, line, end_offset, complete)."""
    at = marks(spark, folder).select(F.col("path").alias("source"), F.col("file"), "mirrored")
    read = lines(spark, folder).withColumn("file", F.regexp_extract("path", "([^/]*)$", 1)).join(at, "file").where("end_offset <= mirrored")
    return read.select(F.col("source").alias("path"), "pos", "line", "end_offset", "complete")

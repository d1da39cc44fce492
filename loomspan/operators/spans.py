"""Span operations and what folds them into spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a span operation besides session_id, op_seq and op (insert or merge).
OPS = "session_id string, route_key string, op_seq long, op string, span_id string, root_span_id string, parent_span_ids array<string>, name string, span_type string, start_ms long, end_ms long, input string, output string, metadata map<string,string>, metrics map<string,double>, error string, tags array<string>"


def last(column: str, when: Column | None = None) -> Column:
    """The last non-null value by op_seq."""
    seen = F.col(column).isNotNull() if when is None else when
    return F.max_by(column, F.when(seen, F.col("op_seq")))


def first_insert(column: str) -> Column:
    return F.min_by(column, F.when((F.col("op") == "insert") & F.col(column).isNotNull(), F.col("op_seq")))


def _merged(column: str, keeps_null: bool) -> Column:
    """An aggregate: maps merged key by key in the order of operations; a null value leaves an older one unless it is to be kept."""
    maps = F.transform(F.array_sort(F.collect_list(F.when(F.size(column) > 0, F.struct("op_seq", F.map_entries(column).alias("m"))))), lambda x: x["m"])

    def later(old: Column, new: Column) -> Column:
        given = F.map_from_entries(new)
        return F.map_zip_with(old, given, lambda k, x, y: F.when(F.map_contains_key(given, k), y).otherwise(x) if keeps_null else F.coalesce(y, x))

    whole = F.aggregate(F.slice(maps, 2, F.greatest(F.size(maps), F.lit(1))), F.map_from_entries(F.get(maps, F.lit(0))), later)
    if not keeps_null:
        whole = F.map_filter(whole, lambda k, v: v.isNotNull())
    return F.when(F.size(maps) > 0, F.map_from_entries(F.array_sort(F.map_entries(whole))))


def fold(ops: DataFrame, *keys: str) -> DataFrame:
    """One row for each span (of each of the further keys): the upsert of all its operations.

    Type, parents, root and start come from the first insert, the name is the last that isn't
    empty, input, output, error, end and tags are the last given, metadata is merged by key and
    metrics by key among numbers. Folding operations twice changes nothing.
    """
    return ops.groupBy(*keys, "span_id").agg(
        F.min("session_id").alias("session_id"),
        F.coalesce(first_insert("root_span_id"), F.min_by("root_span_id", "op_seq")).alias("root_span_id"),
        first_insert("parent_span_ids").alias("parent_span_ids"),
        last("name", F.col("name") != "").alias("name"),
        first_insert("span_type").alias("span_type"),
        first_insert("start_ms").alias("start_ms"),
        *(last(c).alias(c) for c in ("end_ms", "input", "output", "error")),
        last("tags", F.size("tags") > 0).alias("tags"),
        F.size(F.collect_set("op_seq")).cast("long").alias("n_ops"),
        _merged("metadata", True).alias("metadata"),
        _merged("metrics", False).alias("metrics"),
    )


def with_destination(spans: DataFrame, parent: str = "destination_parent", root: str = "destination_root") -> DataFrame:
    """Top spans hang below their destination, whose root is then the root of all spans."""
    return spans.withColumn("parent_span_id", F.coalesce(F.get("parent_span_ids", F.lit(0)), F.col(parent))).withColumn("root_span_id", F.coalesce(F.col(root), "root_span_id"))

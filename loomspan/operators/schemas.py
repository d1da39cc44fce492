"""What JSON texts hold: for each path the kinds of its values and the one type that fits them all.

Tasks count kinds by path, so that one shuffle adds up a few numbers for each path and task. Paths are written `a.b` for fields and `a[]` for the items of lists, `$` for the whole value.

A path's type is the kind of all its values that aren't null; whole numbers among others make `number`, any other mixture is `mixed`, and `null` is what has no other kind.
Defined cases: a null text isn't counted; one that isn't JSON counts as `broken` at `$`; fields that repeat in an object count once, the last; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("null", "boolean", "integer", "number", "string", "array", "object", "broken")


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(value)]


def walk(value) -> Iterator[tuple[str, str]]:
    """(path, kind) of a value and all that it holds."""
    todo = [("$", value)]
    while todo:
        path, v = todo.pop()
        yield path, _kind(v)
        if isinstance(v, dict):
            todo += [(k if path == "$" else f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{path}[]", x) for x in v]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[tuple[str, str]] = Counter()

    def out() -> pa.RecordBatch:
        rows = [(p, k, n) for (p, k), n in found.items()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "kind", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text is None:
                continue
            try:
                found.update(walk(json.loads(text)))
            except ValueError:
                found["$", "broken"] += 1
        if len(found) > 100_000:  # keys that are data
            yield out()
    yield out()


def _type(kinds: Column) -> Column:
    given = F.filter(kinds, lambda k: k != "null")
    numbers = F.forall(given, lambda k: k.isin("integer", "number"))
    return F.when(F.size(given) == 0, "null").when(F.size(given) == 1, F.get(given, F.lit(0))).when(numbers, "number").otherwise("mixed")


def inferred(rows: DataFrame, doc: Column) -> DataFrame:
    """(path, type, n, nulls, kinds): how often each path has a value, how often null, and its kinds in the order of KINDS."""
    counts = rows.select(doc.alias("doc")).mapInArrow(_counted, "path string, kind string, n long").groupBy("path").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in KINDS))
    kinds = F.filter(F.array(*(F.when(F.col(k) > 0, F.lit(k)) for k in KINDS)), lambda k: k.isNotNull())
    return counts.select("path", _type(kinds).alias("type"), sum((F.col(k) for k in KINDS[1:]), F.col("null")).alias("n"), F.col("null").alias("nulls"), kinds.alias("kinds"))

"""Filter interaction audit by an incidence matrix product.

Each document fails some of n filters: a mask of n bits. A part's masks are counted, of all its documents, the good and the toxic ones:
three histograms of 2**n numbers. Stacked as rows they are multiplied by integer matrices of 2**n rows and n! * n columns (32 by 600 for five
filters), which say for each mask, and each step of each order of the filters, whether such a document is kept, removed,
redundant (it fails the step's filter but was removed before) or fails that filter alone.

One filter, last of `checks`, asks for copies: it fails where a smaller id has the same text. Texts never move: rows of id, digest, part and
mask do. Rows of one id and text are added up first; of each text, only the rows of its smallest id pass.

Defined cases: a null text is empty, a null part is the empty string, and equal ids with different texts are documents of their own; repeated rows of an id don't make one another copies,
and all count; a null id has no labels, isn't a copy and makes none; of several labels of an id the largest of each counts, and a label that isn't 1 is as none; an empty table has no parts, so gives no rows;
further columns are ignored. Ties: copies are counted, not chosen among, but for the smallest id. A very long text is one row, whose words are counted in its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def capitals(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))


#: Failure conditions on a text and its words; the filter for copies follows them.
CHECKS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, found: F.size(found) < 200,
    "B": lambda text, found: 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
    "C": lambda text, found: 100 * capitals(text).cast("long") > 3 * F.length(text).cast("long"),
    "D": lambda text, found: F.rlike(text, F.lit("[#$%&*|]")),
}
COPIES = "E"


@dataclass
class Outcomes:
    """Matrices of 2**n masks by the steps of all orders; which filter each step has."""

    orders: list[str]
    filters: np.ndarray
    kept: np.ndarray
    removed: np.ndarray
    redundant: np.ndarray
    unique: np.ndarray


def outcomes(names: str) -> Outcomes:
    n = len(names)
    orders = [*permutations(range(n))]
    masks = np.arange(1 << n)[:, None]
    bits = np.array(orders).reshape(len(orders), n)
    before = np.cumsum(1 << bits, axis=1) - (1 << bits)
    at, earlier = (1 << bits).reshape(1, -1), before.reshape(1, -1)
    fails, gone = (masks & at) != 0, (masks & earlier) != 0
    as_int = lambda x: x.astype(np.int64)
    return Outcomes(["".join(names[i] for i in o) for o in orders], bits.reshape(-1), as_int(~fails & ~gone), as_int(fails & ~gone), as_int(fails & gone), as_int(masks == at))


def histograms(docs: DataFrame, labels: DataFrame, checks: dict[str, Callable[[Column, Column], Column]] | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, all, good, toxic): how many documents of a part fail just the filters of a mask. Bit i is the i-th check; copies have the last."""
    checks = checks or CHECKS
    t = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("words", words(F.col("text")))
    bits = [F.when(check(F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(0) for i, check in enumerate(checks.values())]
    rows = t.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", sum(bits[1:], bits[0]).alias("mask"))
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(to) for c, to in (("quality", "good"), ("toxic", "bad"))))
    # Null ids have no labels; they stay where they are instead of meeting in one task.
    known = rows.where("id IS NOT NULL").join(marks, "id", "left").fillna(0, ["good", "bad"])
    rows = known.unionByName(rows.where("id IS NULL").withColumns({"good": F.lit(0), "bad": F.lit(0)}))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    anonymous = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("anonymous")
    # Of each text: a row for each part and label, with the smallest id there and how many rows have it.
    texts = rows.groupBy("digest", "part", "mask", "good", "bad").agg(F.sum("n").alias("n"), first, anonymous)
    smallest = texts.groupBy("digest").agg(F.min("first.id").alias("smallest"))
    texts = texts.join(smallest, "digest")
    passes = F.col("anonymous") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    copy = F.lit(1 << len(checks))
    split = texts.select("part", "good", "bad", F.explode(F.array(F.struct(F.col("mask"), passes.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - passes).alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.where(n > 0).groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("all"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("bad")).alias("toxic"))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame, names: str) -> DataFrame:
    """Rows of histograms(), at most 2**n for a part, multiplied: (part, filter_order, step, ...) for each part, order and step."""
    n = len(names)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = outcomes(names)
        same = (m.filters[:, None] == m.filters[None, :]).astype(np.int64)
        orders = pa.array(np.repeat(np.array(m.orders, object), n))
        steps = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(m.orders)))
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stack = np.zeros((3, 1 << n), np.int64)
                for c in cells:
                    stack[:, c["mask"]] = c["all"], c["good"], c["toxic"]
                removed = stack @ m.removed
                got = (stack[0] @ m.kept, removed[0], stack[0] @ m.redundant, stack[0] @ m.unique, removed[1], removed[2], removed[0] @ same)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps)), orders, steps, *(pa.array(x) for x in got)], names=["part", "filter_order", "step", *COUNTS])

    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "all", "good", "toxic")).alias("cells"))
    return stacked.mapInArrow(multiplied, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))

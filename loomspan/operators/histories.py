"""Histories that model calls share: each item is stored once, a call names a prefix of its scope's items, and prefixes are joined out in bounded pieces.

Written into every call, histories grow with the square of a scope. Here a scope's items are numbered and cut into blocks of about PIECE bytes, in one window over
the scope, and a call keeps how many items come before it. Where its input is wanted whole, the call meets the blocks that it needs, by
(scope, block) and a range of calls, so that a long scope is dealt over many tasks: a block is sent once for SPREAD items of calls, and no row holds
more than a block. A digest of each prefix tells whether two calls, or two sessions, have seen the same.

Defined cases: null items are none of the history; an empty text is an item; a call with nothing before it has no piece; items that share a place are taken in the order of
their texts; an item longer than a piece is a piece of its own or ends one; no records give no rows. Names that start with `_h` are kept for columns of this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of items after which a block ends, and over how many items the calls lie that share one copy of a block.
PIECE, SPREAD = 256 * 1024, 64


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def _hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 15, "0")


def numbered(records: DataFrame, item: str, scope: list[str], by: list[str], piece: int = PIECE) -> DataFrame:
    """records whose item isn't null, with item_no (from 0), of_items (how many its scope has), bytes_before, block and prefix: a digest of 120 bits of the items up to this one, with their numbers."""
    order = [*by, item]
    rows = records.where(F.col(item).isNotNull())
    rows = rows.withColumn("item_no", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)).cast("long") - 1)
    rows = rows.withColumn("of_items", F.count("*").over(Window.partitionBy(*scope)))
    own = F.md5(F.concat_ws(":", F.col("item_no").cast("string"), item))
    rows = rows.withColumns({"_h1": _half(own, 1), "_h2": _half(own, 16)})
    so_far = Window.partitionBy(*scope).orderBy("item_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"bytes_before": F.sum(F.octet_length(item).cast("long")).over(so_far) - F.octet_length(item), "_h1": F.bit_xor("_h1").over(so_far), "_h2": F.bit_xor("_h2").over(so_far)})
    return rows.withColumns({"block": F.floor(F.col("bytes_before") / piece).cast("long"), "prefix": F.concat(_hex(F.col("_h1")), _hex(F.col("_h2")))}).drop("_h1", "_h2")


def blocks(items: DataFrame, item: str, scope: list[str]) -> DataFrame:
    """numbered items as rows (scope, block, first_no, last_no, of_items, prefix at its end, items): a few hundred KiB each, and the only place where texts stand."""
    held = F.array_sort(F.collect_list(F.struct("item_no", F.col(item).alias("item"))))
    return items.groupBy(*scope, "block").agg(F.min("item_no").alias("first_no"), F.max("item_no").alias("last_no"), F.max("of_items").alias("of_items"), F.max_by("prefix", "item_no").alias("prefix"), held.alias("items"))


def pieces(calls: DataFrame, items: DataFrame, item: str, scope: list[str], spread: int = SPREAD) -> DataFrame:
    """A row for each call and block that lies, at least in part, before it: the columns of calls, piece (from 0), n_items and text, the items joined by commas.

    calls: the scope, items_before and what names a call. items: numbered items.
    """
    place = items.select(*scope, (F.col("item_no") + 1).alias("items_before"), F.col("block").alias("_hlast"))
    asked = calls.join(place, [*scope, "items_before"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "_hlast"))).drop("_hlast").withColumn("_hpart", F.floor(F.col("items_before") / spread))
    # An item that begins beyond a whole block leaves that one's number unused; such pieces match nothing.
    copies = blocks(items, item, scope).withColumn("_hpart", F.explode(F.sequence(F.floor((F.col("first_no") + 1) / spread), F.floor(F.col("of_items") / spread))))
    met = asked.join(copies.select(*scope, "block", "_hpart", "items"), [*scope, "block", "_hpart"])
    seen = F.transform(F.filter("items", lambda x: x["item_no"] < F.col("items_before")), lambda x: x["item"])
    return met.select(*(F.col(c) for c in calls.columns), F.col("block").alias("piece"), F.size(seen).cast("long").alias("n_items"), F.array_join(seen, ",").alias("text"))


def written(rows: DataFrame, path: str, row_group: int = 32 * 1024 * 1024, piece: int = PIECE) -> None:
    """Pieces as Parquet whose row groups hold about `row_group` bytes before compression, so that a reader never needs more at once."""
    rows.write.option("parquet.block.row.count.limit", max(1, row_group // piece)).parquet(path)


def shared_prefixes(items: DataFrame, scope: list[str]) -> DataFrame:
    """Scopes whose first items are those of another scope, as forks of one session are: (scope, shared_items, sharers): the longest such prefix, and how many scopes have it."""
    known = items.groupBy("prefix").agg(F.count("*").alias("sharers")).where("sharers > 1")
    return items.select(*scope, "item_no", "prefix").join(known, "prefix").groupBy(*scope).agg((F.max("item_no") + 1).alias("shared_items"), F.max_by("sharers", "item_no").alias("sharers"))

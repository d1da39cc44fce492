"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every `window` consecutive words, the hashes of all `gram`-word grams in it are
taken and the smallest is kept as the window's fingerprint. Equal windows keep equal
fingerprints, so every shared span of at least `window` words shares one. Training
and test fingerprints are joined; in texts with a shared fingerprint, the windows that
kept it are compared word for word with the benchmark's (the extension of a hit), and
the words they cover are counted. Items of fewer than `window` words are one window of
their own length, winnowed alike.

Words are maximal runs of digits, letters a-z and characters from U+0080 on, after
A-Z are lower-cased. Fingerprints fold all letters' case, which only adds
candidates; the comparison that follows folds A-Z alone.

Defined cases: a null or wordless text has no words and no hits; a null or wordless
item has no window; items with a null id count as the empty id; equal texts get equal
results; repeated rows, null ids and further columns stay; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, stored, unused

WINDOW, GRAM = 10, 5
#: Rows up to which a side is broadcast (some 100 bytes each); beyond it, it is shuffled.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def folded(text: Column) -> Column:
    """The same number of words at the same places, with the case of all letters folded without regard to neighbours."""
    return F.filter(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("Σ"), F.lit("σ"))), NOT_WORD), lambda w: w != "")


def count_words(text: Column) -> Column:
    """The number of words: places where a word follows the start or a separator."""
    parts = F.split(F.coalesce(text, F.lit("")), NOT_WORD_ANY_CASE)
    return (F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def _slide(df: DataFrame, name: str, unit: str, size: int, join) -> DataFrame:
    """Adds `name`: join over each `size` consecutive elements of array `unit`, by doubling. The last size - 1 elements mean nothing."""
    have, step = unit, 1
    while step < size:
        by = min(step, size - step)
        new = name if step + by == size else f"{name}_{step + by}"
        df = df.withColumn(new, F.zip_with(have, F.slice(F.col(have), by + 1, F.greatest(F.size(have), F.lit(1))), join))
        have, step = new, step + by
    return df if have == name else df.withColumn(name, F.col(have))


def _hashed(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def fingerprints(df: DataFrame, lengths: list[int], gram: int = GRAM) -> DataFrame:
    """From array `folded`, adds arrays fp_L for each window length L: the fingerprint of the window that starts at each word."""
    kept = df.columns
    df = df.withColumn("_u", F.transform("folded", lambda w: F.xxhash64(w)))
    for g in sorted({min(gram, n) for n in lengths}):
        # A gram is hashed from overlapping halves, as a minimum is taken: equal words give equal hashes.
        df = _slide(df, f"_g{g}", "_u", g, _hashed)
    for n in lengths:
        g = min(gram, n)
        df = _slide(df, f"_w{n}", f"_g{g}", n - g + 1, _least)
        df = df.withColumn(f"fp_{n}", F.slice(F.col(f"_w{n}"), 1, F.greatest(F.size("folded") - (n - 1), F.lit(0))))
    return df.select(*kept, *(f"fp_{n}" for n in lengths))


def bench_windows(benchmark: DataFrame, item_id: str, text: str, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """Rows (item, n, fp, words) for each window of each item, and the lengths n that occur (window and shorter ones)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("words"), folded(F.col(text)).alias("folded")).where(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # at most `window` numbers
    if not lengths:
        return items.select("item", "n", F.lit(0).cast("long").alias("fp"), F.lit("").alias("gram")), []
    fps = fingerprints(items, lengths, gram)
    which = F.coalesce(*(F.when(F.col("n") == n, F.col(f"fp_{n}")) for n in lengths))
    return fps.select("item", "n", "words", F.posexplode(which).alias("s", "fp")).select("item", "n", "fp", F.array_join(F.slice("words", F.col("s") + 1, F.col("n")), " ").alias("gram")), lengths


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (k1, k2, n_hit, items) for each distinct text with a hit; k1 and k2 are the text's key(), items is sorted."""
    bench, lengths = bench_windows(benchmark, item_id, item_text, window, gram)
    if not lengths:
        return docs.select(*key(text)).withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}).where(F.lit(False))
    bench = stored(bench)
    size = bench.count()
    known = small(bench.select("n", "fp").distinct(), size, BROADCAST_ROWS)
    texts = docs.select(F.col(text).alias("text"), *key(text)).where(F.col("text") != "")
    seen = fingerprints(texts.select("k1", "k2", folded(F.col("text")).alias("folded")), lengths, gram)
    seen = seen.select("k1", "k2", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.array_distinct(f"fp_{n}").alias("fps")) for n in lengths))).alias("x")).select("k1", "k2", "x.n", F.explode("x.fps").alias("fp"))
    found = stored(seen.join(known, ["n", "fp"]).select("k1", "k2").distinct())
    near = small(found, found.count(), BROADCAST_ROWS)
    hit = stored(texts.join(near, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text")))
    # Where fingerprints of the benchmark stand: each place is looked up once, and only such places become words again.
    places = fingerprints(hit.select("k1", "k2", folded(F.col("text")).alias("folded")), lengths, gram)
    places = places.select("k1", "k2", F.explode(F.concat(*(F.transform(f"fp_{n}", _placed(n)) for n in lengths))).alias("x")).select("k1", "k2", "x.n", "x.s", "x.fp")
    at = places.join(known, ["n", "fp"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("n", "s")).alias("at"))
    spans = hit.join(at, ["k1", "k2"]).select("k1", "k2", words(F.col("text")).alias("words"), "at")
    spans = spans.select("k1", "k2", F.explode(F.transform("at", lambda x: F.struct(x.n.alias("n"), x.s.alias("s"), F.array_join(F.slice("words", x.s + 1, x.n), " ").alias("gram")))).alias("x")).select("k1", "k2", "x.n", "x.s", "x.gram")
    exact = spans.join(small(bench.select("n", "gram", "item").distinct(), size, BROADCAST_ROWS, wide=True), ["n", "gram"])
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.array_sort("spans"),
        start,
        lambda a, x: F.struct(F.greatest(a.end, x.s + x.n).alias("end"), (a.n + F.greatest(F.lit(0), x.s + x.n - F.greatest(a.end, x.s))).alias("n")),
        lambda a: a.n,
    )
    return exact.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "n")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")).select("k1", "k2", covered.alias("n_hit"), "items")


def _placed(n: int):
    return lambda fp, i: F.struct(F.lit(n).alias("n"), i.alias("s"), fp.alias("fp"))


def key(text: str) -> list[Column]:
    """128 bits of a text, in two columns."""
    return [F.xxhash64(F.lit(1), F.col(text)).alias("k1"), F.xxhash64(F.col(text), F.lit(2)).alias("k2")]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """Columns of docs but the text, and n_words, n_hit, items (sorted ids as strings); columns of docs with these names are replaced."""
    docs = docs.drop("n_words", "n_hit", "items")
    found = stored(hits(docs, benchmark, text, **more))
    one, two, n_hit, items = unused(docs, "k1", "k2", "n_hit", "items")
    found = small(found, found.count(), BROADCAST_ROWS, wide=True).toDF(one, two, n_hit, items)
    others = [c for c in docs.columns if c != text]
    keyed = docs.select(*others, count_words(F.col(text)).alias("n_words"), *(k.alias(n) for k, n in zip(key(text), (one, two), strict=True)))
    return keyed.join(found, [one, two], "left").select(*others, "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """The rows of docs without a hit, with all their columns."""
    one, two = unused(docs, "k1", "k2")
    found = stored(hits(docs, benchmark, text, **more).select("k1", "k2"))
    found = small(found, found.count(), BROADCAST_ROWS).toDF(one, two)
    return docs.withColumns(dict(zip((one, two), key(text), strict=True))).join(found, [one, two], "left_anti").select(*docs.columns)

"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed entry is a host and the beginning of a path; it stands for its host, all
subdomains and all paths that start so. A URL's canonical keys are its host and
parent domains, each with those beginnings of its path that have a listed length. Keys
pass a blocked Bloom filter, each key in one block of 256 bits, and those that
may be listed are joined exactly with the list, which removes false positives. The
longest listed entry decides.

Each distinct host and path is judged once and joined back, so a hot URL costs one row.
The filter's table and the list are broadcast if their rows are few, and shuffled otherwise.

Defined cases: a null URL and one without `://` have an empty host and path, which no entry with a host
fits; a URL that no entry fits is allowed; entries with a null host or path are ignored; of an entry listed
twice, block counts; null ids, repeated rows and further columns stay; empty tables work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import LOWER, UPPER
from .shared import small, stored, unused

#: Bits of the filter for each listed entry, bits set for a key, 64-bit words of a block.
BITS, HASHES, WORDS = 24, 6, 4
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "?", 1)).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(F.substring_index(rest, "#", 1), "?", 1), "/", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    whole = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    return F.coalesce(F.when(F.instr(whole, "/") > 0, F.substr(whole, F.instr(whole, "/"))), F.lit(""))


def _bits(host: str, path: str, blocks: int) -> list[Column]:
    """The block of a key, and its bits as words of the block."""
    at = F.pmod(F.xxhash64(host, path, F.lit(0)), F.lit(blocks)).alias("block")
    hashed = [F.pmod(F.xxhash64(host, path, F.lit(k + 1)), F.lit(64 * WORDS)) for k in range(HASHES)]
    words = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for h in hashed:
            word = word.bitwiseOR(F.when(F.floor(h / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long")))
        words.append(word.alias(f"w{w}"))
    return [at, *words]


def bloom(listed: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """(block, w0..) of listed keys (host, path), and the number of blocks."""
    blocks = max(1, -(-entries * BITS // (64 * WORDS)))
    return listed.select(*_bits("host", "path", blocks)).groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"f{w}") for w in range(WORDS))), blocks


def judge(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest entry that fits, else null) and verdict (that entry's, else allow).

    listed: rows (host, path, verdict), canonical: host in lower case. Columns of pages with the new names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    rules = listed.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = stored(rules)
    size = rules.count()
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())  # no more than a URL's longest path
    host, path, rule, verdict = "host", "path", "rule", "verdict"
    h, p = unused(pages, "_host_key", "_path_key")
    out = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    seen = out.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = seen.select("h", "p", F.explode(suffixes).alias("host"))
    starts = F.array_compact(F.array(*(F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in lengths))) if lengths else F.array().cast("array<string>")
    keys = keys.select("h", "p", "host", F.explode(starts).alias("path"))
    filters, blocks = bloom(rules, size)
    probe = keys.select("h", "p", "host", "path", *_bits("host", "path", blocks)).join(small(filters, min(size, blocks), BROADCAST_ROWS), "block")
    for w in range(WORDS):
        probe = probe.where(F.col(f"f{w}").bitwiseAND(F.col(f"w{w}")) == F.col(f"w{w}"))
    hits = probe.select("h", "p", "host", "path").join(small(rules, size, BROADCAST_ROWS, wide=True), ["host", "path"])
    longest = F.struct(F.length("host") + F.length("path"), F.length("host"), F.concat("host", "path").alias("rule"), "verdict")
    best = hits.groupBy("h", "p").agg(F.max(longest).alias("best")).select("h", "p", "best.rule", "best.verdict").toDF(h, p, rule, verdict)
    out = out.join(best, (out[host] == best[h]) & (out[path] == best[p]), "left").drop(h, p)
    return out.withColumn(verdict, F.coalesce(verdict, F.lit("allow")))


def rules(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "host string, path string, verdict string")

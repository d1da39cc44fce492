"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, embeddings, filters, html, licenses, lm, minhash, negatives, secrets, sharding, toxicity, urls
from .shared import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = minhash.groups(read(spark, sf_dir, "documents"), size=2, percent=80)
    return got.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return got.select("doc_id", toxicity.holds_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Host, path and verdict of the listed entries.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rules(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(read(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what labels call good; the background is every other document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.assign(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = secrets.scan(docs, secrets.fit(docs))

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["kind"] != "random")
    return got.select("doc_id", *map(counted, secrets.KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counted("random"))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filters.histograms(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return filters.audit(counts, "".join(filters.CHECKS) + filters.COPIES)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_embeddings": op3_embeddings,
    "op4_licenses": op4_licenses,
    "op5_html": op5_html,
    "op6_lm": op6_lm,
    "op7_shards": op7_shards,
    "op8_decontam": op8_decontam,
    "op9_toxicity": op9_toxicity,
    "op10_minhash": op10_minhash,
    "op11_secrets": op11_secrets,
    "op12_filters": op12_filters,
    "op13_negatives": op13_negatives,
}

#: Operators that SQL can express; the others are tested against brute force.
SQL: dict[str, str] = {
    "op2_urls": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
    "op3_embeddings": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.93),
f AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, f.b FROM r JOIN f ON r.b = f.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), d AS (SELECT a, count(*) AS n_links FROM f GROUP BY a)
SELECT m.a AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, m.a = component_id AS kept FROM m LEFT JOIN d USING (a)
""",
    "op8_decontam": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, s, dw.n, item FROM dw JOIN bw USING (n, gram)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
""",
    "op10_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 2) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
f AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, f.b FROM r JOIN f ON r.b = f.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
""",
    "op12_filters": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM d),
m AS (SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END) + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN again THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest([0, 1, 2, 3, 4]) AS b),
o AS (SELECT [v.b, w.b, x.b, y.b, z.b] AS bits FROM x v, x w, x, x y, x z WHERE len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5),
s AS (SELECT array_to_string(list_transform(bits, lambda b: chr(65 + b::INT)), '') AS filter_order, step, bits[step] AS b, list_sum(list_transform(bits[1 : step - 1], lambda b: (1 << b)::INT)) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
c AS (SELECT part, filter_order, step, b, h.*, (mask & (1 << b)::INT) <> 0 AS fails, (mask & coalesce(before, 0)::INT) <> 0 AS gone FROM s, h),
g AS (SELECT part, filter_order, step, b, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = (1 << b)::INT THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN bad ELSE 0 END)::BIGINT AS toxic_lost FROM c GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, b)::BIGINT AS shapley FROM g
""",
    "op13_negatives": r"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.id AS a, a.label, b.id AS b, b.label = a.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
k AS (SELECT a, b, s FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT k.a AS anchor_id, k.b AS positive_id, row_number() OVER (PARTITION BY k.a, k.b ORDER BY n.s DESC, n.b)::INTEGER AS rank, n.b AS negative_id, k.s AS positive_score, n.s AS negative_score
FROM k JOIN p n ON n.a = k.a AND NOT n.same AND 50 * k.s <= 100 * n.s AND 100 * n.s <= 95 * k.s QUALIFY rank <= 3
""",
}

"""The query surface: a table of logs, a SQL facade and summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schemas
from ..sources.stand_ins import ENV, envelopes, table
from .registry import query

_QUOTED = re.compile(r"('(?:[^']|'')*')")
_TRUNCATED = re.compile(r"\b(day|hour)\s*\(", re.I)
_COUNT = re.compile(r"\bcount\s*\(\s*\)", re.I)


def facade(sql: str) -> str:
    """SQL of the log dialect as Spark's: day() and hour() truncate, count() counts rows. Text in quotes is left alone."""
    parts = _QUOTED.split(sql)
    for i in range(0, len(parts), 2):
        parts[i] = _COUNT.sub("count(*)", _TRUNCATED.sub(lambda m: f"date_trunc('{m[1].upper()}', ", parts[i]))
    return "".join(parts)


def register(spark: SparkSession, logs: DataFrame, project: str = "project_id") -> None:
    """The view logs, and the table function project_logs(id)."""
    logs.createOrReplaceTempView("logs")
    if project in logs.columns:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION project_logs(wanted STRING) RETURNS TABLE RETURN SELECT * FROM logs WHERE {project} = wanted")


def run_sql(spark: SparkSession, logs: DataFrame, sql: str) -> DataFrame:
    register(spark, logs)
    return spark.sql(facade(sql))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as log rows."""
    e = envelopes(spark, sf_dir)
    return e.select(
        F.concat_ws("-", "session_id", F.col("seq").cast("string")).alias("id"),
        F.concat(F.lit("p"), (F.length("session_id") % 3).cast("string")).alias("project_id"),
        F.timestamp_millis("ts_ms").alias("created"),
        F.concat(F.lit("call "), "call_id").alias("input"),
        F.col("event").alias("output"),
        F.when(F.col("event") == "PostToolUse", F.lit("ok")).alias("expected"),
        F.create_map(F.lit("tokens"), F.col("seq").cast("double")).alias("metrics"),
        F.create_map(F.lit("model"), F.col("event"), F.lit("test_id"), F.col("session_id")).alias("metadata"),
        F.create_map(F.lit("quality"), F.col("value")).alias("scores"),
    )


LOGS = f"{ENV}, logs AS (SELECT session_id || '-' || seq AS id, 'p' || (length(session_id) % 3) AS project_id, ts_ms, make_timestamp(ts_ms * 1000) AS created, 'call ' || call_id AS input, event AS output, CASE WHEN event = 'PostToolUse' THEN 'ok' END AS expected, seq::DOUBLE AS tokens, event AS model, session_id AS test_id, value AS quality FROM env)"


@query(f"WITH {LOGS} SELECT epoch_ms(date_trunc('day', created)) AS day_ms, round(avg(quality), 6) AS quality, count(*) AS n FROM logs GROUP BY 1")
def sql_daily_avg(spark, sf_dir):
    return run_sql(spark, logs(spark, sf_dir), "SELECT unix_millis(day(created)) AS day_ms, round(avg(scores.quality), 6) AS quality, count() AS n FROM logs GROUP BY day(created)")


@query(f"WITH {LOGS} SELECT id, quality FROM logs ORDER BY quality DESC, id LIMIT 10")
def sql_top10(spark, sf_dir):
    return run_sql(spark, logs(spark, sf_dir), "SELECT id, scores.quality AS quality FROM logs ORDER BY scores.quality DESC, id LIMIT 10")


@query(f"WITH {LOGS} SELECT model, round(avg(quality), 6) AS quality, count(*) AS n FROM logs GROUP BY 1")
def sql_group_model(spark, sf_dir):
    return run_sql(spark, logs(spark, sf_dir), "SELECT metadata.model AS model, round(avg(scores.quality), 6) AS quality, count() AS n FROM logs GROUP BY metadata.model")


@query(f"WITH {LOGS} SELECT id FROM logs WHERE output ILIKE '%toolusefail%' AND quality > 50")
def sql_ilike(spark, sf_dir):
    return run_sql(spark, logs(spark, sf_dir), "SELECT id FROM logs WHERE output ILIKE '%toolusefail%' AND scores.quality > 50")


@query(f"WITH {LOGS} SELECT epoch_ms(date_trunc('hour', created)) AS hour_ms, count(*) AS n FROM logs WHERE created > (SELECT max(created) FROM logs) - INTERVAL 1 DAY GROUP BY 1")
def sql_hourly_filter(spark, sf_dir):
    return run_sql(spark, logs(spark, sf_dir), "SELECT unix_millis(hour(created)) AS hour_ms, count() AS n FROM logs WHERE created > (SELECT max(created) FROM logs) - interval 1 day GROUP BY hour(created)")


@query(f"WITH {LOGS}, c AS (SELECT test_id, count(*) AS n FROM logs GROUP BY 1) SELECT test_id, least(n, 100) AS n FROM c")
def sql_count_saturating(spark, sf_dir):
    """Counts of rows of which at most 100 are fetched."""
    return run_sql(spark, logs(spark, sf_dir), "SELECT metadata.test_id AS test_id, least(count(), 100) AS n FROM logs GROUP BY metadata.test_id")


@query(f"WITH {LOGS} SELECT id, output FROM logs WHERE project_id = 'p1'")
def sql_project_logs(spark, sf_dir):
    return run_sql(spark, logs(spark, sf_dir), "SELECT id, output FROM project_logs('p1')")


def fetched(logs: DataFrame, test_id: str | None = None, most: int = 100) -> DataFrame:
    """The columns that a log query gives, of at most `most` rows, the latest first, of one test if asked; their number is all that a count of them can say."""
    rows = logs if test_id is None else logs.where(F.col("metadata")["test_id"] == test_id)
    return rows.select("id", "created", "input", "output", "metadata", "scores").orderBy(F.desc("created"), "id").limit(most)


@query(f"WITH {LOGS} SELECT id, ts_ms AS created_ms, input, output, model, quality FROM logs WHERE test_id = 'u7' ORDER BY created DESC, id LIMIT 100")
def sql_latest_of_test(spark, sf_dir):
    return fetched(logs(spark, sf_dir), "u7").select("id", F.unix_millis(F.col("created").cast("timestamp")).alias("created_ms"), "input", "output", F.col("metadata")["model"].alias("model"), F.col("scores")["quality"].alias("quality"))


def clauses(logs: DataFrame, select: list[str] | None = None, filter: str | None = None, dimensions: list[str] | None = None, measures: list[str] | None = None, sort: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A query given by its clauses: columns, or dimensions with measures, each an expression of the log dialect."""
    rows = logs.where(facade(filter)) if filter else logs
    if measures:
        keys = [F.expr(facade(d)) for d in dimensions or ()]
        rows = rows.groupBy(*keys).agg(*(F.expr(facade(m)) for m in measures))
    elif select:
        rows = rows.select(*(F.expr(facade(c)) for c in select))
    if sort:
        rows = rows.orderBy(*(F.expr(s.removesuffix(" desc")).desc() if s.endswith(" desc") else F.expr(s) for s in sort))
    return rows if limit is None else rows.limit(limit)


@query(f"WITH {LOGS} SELECT model, round(avg(tokens), 6) AS tokens, count(*) AS n, count(expected) AS checked FROM logs WHERE quality > 20 GROUP BY 1 ORDER BY n DESC, model LIMIT 3")
def clause_query(spark, sf_dir):
    """The same surface by clauses."""
    return clauses(logs(spark, sf_dir), filter="scores.quality > 20", dimensions=["metadata.model AS model"], measures=["round(avg(metrics.tokens), 6) AS tokens", "count() AS n", "count(expected) AS checked"], sort=["n desc", "model"], limit=3)


def updated(rows: DataFrame, changes: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """rows with changes of the same id merged in, column by column: the latest value given counts, null leaves what was; ids that are new are added."""
    columns = [c for c in rows.columns if c != key]
    given = changes.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_{c}") for c in columns if c in changes.columns))
    both = rows.join(given, key, "full")
    return both.select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in columns))


@query("""WITH c AS (SELECT doc_id % 300 AS id, doc_id AS n, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN source END AS source FROM documents WHERE doc_id >= 100),
g AS (SELECT id, arg_max(lang, n) FILTER (lang IS NOT NULL) AS lang, arg_max(source, n) FILTER (source IS NOT NULL) AS source FROM c GROUP BY 1), r AS (SELECT doc_id AS id, lang, source FROM documents WHERE doc_id < 250)
SELECT coalesce(r.id, g.id) AS id, coalesce(g.lang, r.lang) AS lang, coalesce(g.source, r.source) AS source FROM r FULL JOIN g ON r.id = g.id""")
def dataset_update(spark, sf_dir):
    """Rows of a dataset after updates by id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changes = d.where("doc_id >= 100").select((F.col("doc_id") % 300).alias("id"), F.col("doc_id").alias("at"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"))
    return updated(d.where("doc_id < 250").select(F.col("doc_id").alias("id"), "lang", "source"), changes)


def summarize(rows: DataFrame, baseline: DataFrame, by: str, score: str) -> DataFrame:
    """Mean scores of an experiment beside those of its baseline."""
    mine = rows.groupBy(by).agg(F.avg(score).alias("score"), F.count("*").alias("n"))
    base = baseline.groupBy(by).agg(F.avg(score).alias("base"))
    return mine.join(base, by, "left").select(by, F.round("score", 6).alias("score"), F.round("base", 6).alias("base"), F.round(F.col("score") - F.col("base"), 6).alias("change"), "n")


@query(f"""WITH {LOGS}, a AS (SELECT model, avg(quality) AS s, count(*) AS n FROM logs WHERE project_id = 'p1' GROUP BY 1), b AS (SELECT model, avg(quality) AS s FROM logs WHERE project_id <> 'p1' GROUP BY 1)
SELECT model, round(a.s, 6) AS score, round(b.s, 6) AS base, round(a.s - b.s, 6) AS change, n FROM a LEFT JOIN b USING (model)""")
def experiment_summary(spark, sf_dir):
    rows = logs(spark, sf_dir).select("project_id", F.col("metadata")["model"].alias("model"), F.col("scores")["quality"].alias("quality"))
    return summarize(rows.where("project_id = 'p1'"), rows.where("project_id <> 'p1'"), "model", "quality")


@query(f"WITH {ENV}, s AS (SELECT session_id, count(*) FILTER (event = 'PostToolUse') AS passed, count(*) FILTER (event = 'PreToolUse') AS expected FROM env GROUP BY 1) SELECT session_id, round(CASE WHEN expected = 0 THEN 0 ELSE least(1, passed / expected) END, 6) AS score FROM s")
def scorer(spark, sf_dir):
    """min(1, made / expected) for each session."""
    s = envelopes(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("event") == "PostToolUse").alias("passed"), F.count_if(F.col("event") == "PreToolUse").alias("expected"))
    return s.select("session_id", F.round(F.when(F.col("expected") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("passed") / F.col("expected"))), 6).alias("score"))


@query("""SELECT doc_id::VARCHAR AS id, doc_id::VARCHAR AS span_id, doc_id::VARCHAR AS root_span_id, lang || ',' || source AS tags, n_chars::DOUBLE AS size FROM documents""")
def manual_log_row(spark, sf_dir):
    """Rows written by hand: tags split at commas and trimmed, scores read from JSON."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws(" , ", "lang", "source").alias("tags"), F.to_json(F.struct(F.col("n_chars").alias("size"))).alias("scores"))
    return manual_rows(d).select("id", "span_id", "root_span_id", F.array_join("tags", ",").alias("tags"), F.col("scores")["size"].alias("size"))


def manual_rows(rows: DataFrame) -> DataFrame:
    """rows (id, tags, scores and, where given, input, output, expected, metadata): each its own span and root. Scores or metadata that aren't JSON give a problem; empty texts count as not given."""
    texts = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("input", "output", "expected") if c in rows.columns]
    kinds = {c: (F.col(c) != "") & F.try_parse_json(c).isNull() for c in ("scores", "metadata") if c in rows.columns}
    problem = F.coalesce(*(F.when(bad, F.lit(f"Error: {c} must be valid JSON")) for c, bad in kinds.items()), F.lit(None).cast("string"))
    more = [F.from_json("metadata", "map<string,string>").alias("metadata")] if "metadata" in kinds else []
    return rows.select("id", F.col("id").alias("span_id"), F.col("id").alias("root_span_id"), *texts, F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(t)), lambda t: t != "").alias("tags"), F.from_json("scores", "map<string,double>").alias("scores"), *more, problem.alias("problem"))


@query("""WITH d AS (SELECT json_extract_string(props, '$.k')::BIGINT AS k, event_id % 3 AS m, value FROM events), n AS (SELECT count(*) AS n, count(*) FILTER (m = 0) AS n0, count(*) FILTER (m = 1) AS n1, count(*) FILTER (m = 2) AS n2 FROM d)
SELECT u.path, u.type, u.c AS n, u.nulls, u.kinds FROM (SELECT unnest([{'path': '$', 'type': 'object', 'c': n.n, 'nulls': 0, 'kinds': 'object'}, {'path': 'props', 'type': 'object', 'c': n.n, 'nulls': 0, 'kinds': 'object'}, {'path': 'props.k', 'type': 'integer', 'c': n.n, 'nulls': 0, 'kinds': 'integer'},
{'path': 'mark', 'type': 'mixed', 'c': n.n, 'nulls': n0, 'kinds': 'null,integer,string'}, {'path': 'list', 'type': 'array', 'c': n.n, 'nulls': 0, 'kinds': 'array'}, {'path': 'list[]', 'type': 'number', 'c': 2 * n.n, 'nulls': 0, 'kinds': 'integer,number'}]) AS u FROM n)""")
def log_schema(spark, sf_dir):
    """Paths of JSON rows with the types of their values."""
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 3
    mark = F.when(m == 1, F.lit("1")).when(m == 2, F.lit('"x"')).otherwise("null")
    doc = F.concat(F.lit('{"props":'), "props", F.lit(',"mark":'), mark, F.lit(',"list":[1,0.5]}'))
    got = schemas.inferred(e, doc)
    return got.select("path", "type", "n", "nulls", F.array_join("kinds", ",").alias("kinds"))


#: Rows that lists of projects and of experiments show if no number is asked for.
PROJECTS, EXPERIMENTS = 10, 100


def listed(rows: DataFrame, by: str, limit: int = PROJECTS, **equal: str) -> DataFrame:
    """The first rows of a list in the order of a column, of those with the given values."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(by).limit(limit)


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier ORDER BY s_suppkey LIMIT 10")
def project_list(spark, sf_dir):
    return listed(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")


@query("SELECT o_orderkey AS id, o_orderpriority AS name, o_orderstatus AS project_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def experiment_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("project_id"))
    return listed(o, "id", EXPERIMENTS, project_id="F")

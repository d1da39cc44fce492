"""Queries that make spans of events and fold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import file_name, span_id
from ..operators.spans import fold
from ..operators.tables import stored
from ..sources.stand_ins import ENV, envelopes, span_sql, table, transcripts, TRX
from .registry import query
from .translate.git import enriched


@query(f"WITH {ENV} SELECT session_id, seq, {span_sql('session_id', chr(39) + 'event:' + chr(39) + ' || seq')} AS span_id FROM env")
def span_ids(spark, sf_dir):
    e = envelopes(spark, sf_dir)
    return e.select("session_id", "seq", span_id(F.col("session_id"), F.concat(F.lit("event:"), F.col("seq").cast("string"))).alias("span_id"))


@query(f"""WITH {ENV}, r AS (SELECT session_id, {span_sql('session_id', "'root'")} AS root_span_id, min(ts_ms) AS start_ms FROM env GROUP BY session_id)
SELECT root_span_id AS span_id, root_span_id, NULL::VARCHAR AS parent_span_id, 'driver: ' || session_id AS name, 'task' AS span_type, start_ms, NULL::BIGINT AS end_ms FROM r
UNION ALL SELECT {span_sql('env.session_id', "'event:' || (seq - 1)")}, root_span_id, root_span_id, event, 'tool', ts_ms, ts_ms FROM env JOIN r USING (session_id)""")
def debug_spans(spark, sf_dir):
    """A root for each session and a span of no length for each event."""
    from .translate.debug import debug_ops

    ops = debug_ops(envelopes(spark, sf_dir).withColumns({"source": F.lit("driver"), "payload": F.lit(None).cast("string")}))
    return fold(ops).select("span_id", "root_span_id", F.get("parent_span_ids", F.lit(0)).alias("parent_span_id"), "name", "span_type", "start_ms", "end_ms")


def call_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of tool calls: an insert for each start, a merge for each stop."""
    e = envelopes(spark, sf_dir).where("event in ('PreToolUse', 'PostToolUse', 'PostToolUseFailure')")
    start, failed = F.col("event") == "PreToolUse", F.col("event") == "PostToolUseFailure"
    return e.select(
        "session_id",
        F.lit("r").alias("route_key"),
        F.col("seq").alias("op_seq"),
        F.when(start, "insert").otherwise("merge").alias("op"),
        span_id(F.col("session_id"), F.concat(F.lit("tool:"), F.col("call_id"))).alias("span_id"),
        span_id(F.col("session_id"), F.lit("root")).alias("root_span_id"),
        F.when(start, F.array(span_id(F.col("session_id"), F.lit("root")))).alias("parent_span_ids"),
        F.when(start, F.concat(F.lit("tool "), F.col("call_id"))).otherwise("").alias("name"),
        F.when(start, "tool").otherwise("task").alias("span_type"),
        F.when(start, F.col("ts_ms")).alias("start_ms"),
        F.when(~start, F.col("ts_ms")).alias("end_ms"),
        F.when(start, F.concat(F.lit("in "), F.col("seq").cast("string"))).alias("input"),
        F.when(~start, F.concat(F.lit("out "), F.col("seq").cast("string"))).alias("output"),
        F.create_map(F.lower("event"), F.col("seq").cast("string"), F.lit("last"), F.col("event")).alias("metadata"),
        F.create_map(F.lit("n"), F.col("seq").cast("double")).alias("metrics"),
        F.when(failed, F.lit("failed")).alias("error"),
        F.when(failed, F.array(F.lit("failed"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


FOLD = f"""ops AS (SELECT session_id, call_id, seq, event = 'PreToolUse' AS ins, event = 'PostToolUseFailure' AS failed, event, ts_ms FROM env WHERE event IN ('PreToolUse', 'PostToolUse', 'PostToolUseFailure')),
folded AS (SELECT {span_sql('session_id', "'tool:' || call_id")} AS span_id, {span_sql('session_id', "'root'")} AS root_span_id, session_id,
 arg_max('tool ' || call_id, seq) FILTER (ins) AS name, CASE WHEN bool_or(ins) THEN 'tool' END AS span_type, arg_min(ts_ms, seq) FILTER (ins) AS start_ms, arg_max(ts_ms, seq) FILTER (NOT ins) AS end_ms,
 arg_max('in ' || seq, seq) FILTER (ins) AS input, arg_max('out ' || seq, seq) FILTER (NOT ins) AS output, CASE WHEN bool_or(failed) THEN 'failed' END AS error, count(*) AS n_ops, call_id FROM ops GROUP BY session_id, call_id)"""


@query(f"WITH {ENV}, {FOLD} SELECT * EXCLUDE (call_id) FROM folded")
def upsert_fold(spark, sf_dir):
    return fold(call_ops(spark, sf_dir)).select("span_id", "root_span_id", "session_id", "name", "span_type", "start_ms", "end_ms", "input", "output", "error", "n_ops")


@query(f"WITH {ENV}, {FOLD} SELECT span_id, start_ms, end_ms, output, n_ops FROM folded")
def replay_idempotent(spark, sf_dir):
    """Operations that arrive twice give what they gave once."""
    ops = call_ops(spark, sf_dir)
    return fold(ops.unionByName(ops)).select("span_id", "start_ms", "end_ms", "output", "n_ops")


@query(f"""WITH {ENV}, {FOLD}, m AS (SELECT session_id, call_id, lower(event) AS k, arg_max(seq::VARCHAR, seq) AS v FROM ops GROUP BY ALL UNION ALL SELECT session_id, call_id, 'last', arg_max(event, seq) FROM ops GROUP BY ALL)
SELECT {span_sql('session_id', "'tool:' || call_id")} AS span_id, string_agg(k || '=' || v, ';' ORDER BY k) AS metadata FROM m GROUP BY session_id, call_id""")
def metadata_merge(spark, sf_dir):
    f = fold(call_ops(spark, sf_dir))
    return f.select("span_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat_ws("=", x.key, x.value)), ";").alias("metadata"))


@query(f"""WITH {ENV}, {FOLD} SELECT CASE WHEN start_ms IS NULL THEN 'late' WHEN end_ms IS NULL THEN 'open' ELSE 'closed' END AS state, coalesce(error, '') AS error, count(*) AS spans, sum(n_ops)::BIGINT AS ops FROM folded GROUP BY ALL""")
def tree_counts(spark, sf_dir):
    f = fold(call_ops(spark, sf_dir))
    state = F.when(F.col("start_ms").isNull(), "late").when(F.col("end_ms").isNull(), "open").otherwise("closed")
    return f.groupBy(state.alias("state"), F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("spans"), F.sum("n_ops").alias("ops"))


@query("""WITH e AS (SELECT c_custkey, c_name, c_nationkey FROM customer) SELECT c_custkey AS session_id, c_name AS cwd, n_name AS repository, n_regionkey::BIGINT AS branch FROM e LEFT JOIN nation ON n_nationkey = c_nationkey""")
def git_enrich(spark, sf_dir):
    """Spans with what a dimension knows of their folder."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    none = F.create_map().cast("map<string,string>")
    ops = c.select(F.col("c_custkey").alias("session_id"), F.lit("insert").alias("op"), F.col("c_name").alias("folder"), none.alias("metadata"), F.col("c_nationkey").cast("string").alias("cwd"))
    git = n.select(F.col("n_nationkey").cast("string").alias("cwd"), F.create_map(F.lit("repository"), F.col("n_name"), F.lit("branch"), F.col("n_regionkey").cast("string")).alias("git"))
    made = enriched(ops, git)
    return made.select("session_id", F.col("folder").alias("cwd"), F.col("metadata")["repository"].alias("repository"), F.col("metadata")["branch"].cast("long").alias("branch"))


def depths(parents: DataFrame, key: list[str], node: str, parent: str) -> DataFrame:
    """Nodes of forests (key.., node, parent or null) with depth, 1 at the top. Each round doubles how far a node looks up, so that rounds grow with the logarithm of the depth.

    A node whose parent isn't there counts as a top; nodes in a circle, or below one, get no row.
    """
    ids = parents.select(*key, F.col(node).alias(parent), F.lit(True).alias("there"))
    now = parents.join(ids, [*key, parent], "left").select(*key, node, F.when(F.col("there"), F.col(parent)).alias("up"), F.when(F.col("there"), 2).otherwise(1).cast("long").alias("depth"))
    before = None
    while True:
        now = stored(now)
        left = now.where("up is not null").count()
        if not left or left == before:
            return now.where("up is null").select(*key, node, "depth")
        before = left
        higher = now.select(*key, F.col(node).alias("up"), F.col("up").alias("further"), (F.col("depth") - 1).alias("more"))
        now = now.join(higher, [*key, "up"], "left").select(*key, node, F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


@query(f"""WITH RECURSIVE {TRX}, n AS (SELECT session_id, pos, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS own FROM trx),
p AS (SELECT session_id, pos, own, CASE WHEN own = 1 THEN -1 ELSE coalesce((SELECT max(m.pos) FROM n m WHERE m.session_id = n.session_id AND m.pos < n.pos AND m.own = 1), -1) END AS parent FROM n),
d(session_id, pos, depth) AS (SELECT session_id, pos, 1 FROM p WHERE parent = -1 UNION ALL SELECT p.session_id, p.pos, d.depth + 1 FROM p JOIN d ON p.session_id = d.session_id AND p.parent = d.pos)
SELECT session_id, pos, depth::BIGINT AS depth FROM d""")
def span_tree_depth(spark, sf_dir):
    """How deep each span of a tree lies: records below the user record before them."""
    from pyspark.sql import Window

    t = transcripts(spark, sf_dir)
    user = F.col("role") == "user"
    before = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.when(~user, F.max(F.when(user, F.col("pos"))).over(before))
    return depths(t.select("session_id", "pos", parent.alias("parent")), ["session_id"], "pos", "parent")


@query("""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS file FROM pages""")
def journal_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", file_name(F.col("url")).alias("file"))

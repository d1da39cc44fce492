"""Queries on transcripts to import, on what is forwarded, and on where it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import mirror_name, uuid5_sql
from ..operators import routing
from ..operators.spans import with_destination
from ..sources import files, imports
from ..sources.stand_ins import ENV, TRX, envelopes, span_sql, table, transcripts
from .registry import query
from .translate import claude

#: Made paths: a folder, a name that some share, an extension.
FILES = """files AS (SELECT '/logs/' || (page_id % 7) || '/roll-' || (page_id % 150) || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '.jsonl' END AS path FROM pages),
listed AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)\\.jsonl$', 1) AS session_id FROM files WHERE path LIKE '%.jsonl')"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("/logs/"), (page % 7).cast("string"), F.lit("/roll-"), (page % 150).cast("string"), F.when(page % 3 == 0, ".txt").otherwise(".jsonl")).alias("path"))


@query(f"WITH {FILES} SELECT session_id, path, count(*) OVER (PARTITION BY session_id) AS files, CASE WHEN count(*) OVER (PARTITION BY session_id) > 1 THEN 'multiple transcripts found' END AS problem FROM listed")
def transcript_discovery(spark, sf_dir):
    """Transcripts below folders, and sessions with more than one."""
    return imports.discovered(_files(spark, sf_dir))


@query(f"""WITH {FILES}, w AS (SELECT s_suppkey::VARCHAR || CASE WHEN s_suppkey % 10 = 0 THEN '/' ELSE '' END AS session_id FROM supplier),
h AS (SELECT w.session_id, count(*) AS n, min(path) AS path FROM w JOIN listed l ON l.session_id = w.session_id OR l.session_id LIKE '%-' || w.session_id GROUP BY 1)
SELECT w.session_id, CASE WHEN NOT regexp_full_match(w.session_id, '[A-Za-z0-9_-]+') THEN 'invalid' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN path END AS path FROM w LEFT JOIN h USING (session_id)""")
def transcript_resolve(spark, sf_dir):
    """The one transcript of each wanted session."""
    key = F.col("s_suppkey")
    wanted = table(spark, sf_dir, "supplier").select(F.concat(key.cast("string"), F.when(key % 10 == 0, "/").otherwise("")).alias("session_id"))
    return imports.resolved(wanted, _files(spark, sf_dir))


@query(f"""WITH {TRX}, f AS (SELECT session_id, pos AS agent FROM trx WHERE role = 'assistant'), r AS (SELECT session_id, max(pos) AS last FROM trx GROUP BY 1)
SELECT f.session_id, agent::VARCHAR AS agent, '/s/' || f.session_id || '/subagents/agent-' || agent || '.jsonl' AS path, CASE WHEN agent % 3 = 0 THEN last WHEN agent % 2 = 0 THEN agent ELSE agent - 1 END AS start_pos, CASE WHEN agent % 3 = 0 THEN last ELSE agent END AS record_pos, CASE WHEN agent % 3 > 0 AND agent % 2 = 1 THEN 'kind' || (agent - 1) END AS agent_type FROM f JOIN r USING (session_id)""")
def subagents_of_claude(spark, sf_dir):
    """Files of subagents with the results that name them and the calls that these answer: two in three are named, every other one by a known call."""
    t = transcripts(spark, sf_dir)
    pos = F.col("pos")
    called = F.struct(F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("Agent").alias("name"), F.concat(F.lit("t"), pos.cast("string")).alias("id"), F.struct(F.concat(F.lit("kind"), pos.cast("string")).alias("subagent_type")).alias("input"))).alias("content")).alias("message"))
    gave = F.struct(F.struct(pos.cast("string").alias("agentId")).alias("toolUseResult"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), (pos - 1).cast("string")).alias("tool_use_id"))).alias("content")).alias("message"))
    records = t.select("session_id", "pos", F.when((F.col("role") == "assistant") & (pos % 3 != 0), F.to_json(gave)).when(pos % 2 == 0, F.to_json(called)).otherwise("{}").alias("rec"))
    files = t.where("role = 'assistant'").select("session_id", F.concat(F.lit("/s/"), "session_id", F.lit("/subagents/agent-"), pos.cast("string"), F.lit(".jsonl")).alias("path"))
    return imports.claude_subagents(files, records)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || (c_custkey % 97) AS a, 's' || (c_nationkey * 7 % 97) AS b FROM customer WHERE c_custkey % 4 = 0),
r(root, node, d) AS (SELECT DISTINCT a, a, 0 FROM e UNION SELECT root, b, d + 1 FROM r JOIN e ON node = a WHERE d < 100)
SELECT root, node, min(d)::INT AS depth FROM r GROUP BY 1, 2""")
def subagents_of_codex(spark, sf_dir):
    """All agents below each transcript that spawned one, over any number of steps; circles end."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0")
    edges = c.select(F.concat(F.lit("s"), (F.col("c_custkey") % 97).cast("string")).alias("a"), F.concat(F.lit("s"), (F.col("c_nationkey") * 7 % 97).cast("string")).alias("b")).distinct()
    return imports.reached(edges.select(F.col("a").alias("root")).distinct(), edges)


@query(f"""WITH {TRX}, p AS (SELECT session_id, pos, 'agent-' || pos AS agent FROM trx WHERE role = 'assistant' AND pos > 0)
SELECT session_id, 'main' AS scope, 'c' || pos AS call, agent, 'kind' || (pos - 1) AS agent_type, (pos - 1) * 1000 AS start_ms, pos * 1000 AS result_ms FROM p""")
def codex_spawn_calls(spark, sf_dir):
    """Spawn calls with the answers that name the agents."""
    t = transcripts(spark, sf_dir)
    pos = F.col("pos")
    calls = t.where("pos > 0 and role = 'assistant'").select("session_id", (pos - 1).alias("pos"), ((pos - 1) * 1000).alias("ts_ms"), F.to_json(F.struct(F.struct(F.lit("function_call").alias("type"), F.lit("spawn_agent").alias("name"), F.concat(F.lit("c"), pos.cast("string")).alias("call_id"), F.to_json(F.struct(F.concat(F.lit("kind"), (pos - 1).cast("string")).alias("agent_type"))).alias("arguments")).alias("payload"))).alias("rec"))
    gave = t.where("role = 'assistant'").select("session_id", "pos", (pos * 1000).alias("ts_ms"), F.to_json(F.struct(F.struct(F.lit("function_call_output").alias("type"), F.concat(F.lit("c"), pos.cast("string")).alias("call_id"), F.to_json(F.struct(F.concat(F.lit("agent-"), pos.cast("string")).alias("agent_id"))).alias("output")).alias("payload"))).alias("rec"))
    return imports.spawn_calls(calls.unionByName(gave).withColumn("scope", F.lit("main")))


@query(f"""WITH {TRX} SELECT session_id, 'main' AS scope, arg_max(text, pos) FILTER (role = 'assistant') AS said, arg_max(text, pos) FILTER (role = 'assistant' AND pos % 3 = 0) AS error, arg_max(pos::VARCHAR, pos) FILTER (role = 'user') AS codex FROM trx GROUP BY 1""")
def last_words(spark, sf_dir):
    """What each transcript said last."""
    t = transcripts(spark, sf_dir)
    claude = F.struct(F.lit("assistant").alias("type"), (F.col("pos") % 3 == 0).alias("isApiErrorMessage"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("message"))
    codex = F.struct(F.struct(F.lit("task_complete").alias("type"), F.col("pos").alias("last_agent_message")).alias("payload"))
    rec = F.when(F.col("role") == "assistant", F.to_json(claude)).when(F.col("role") == "user", F.to_json(codex)).otherwise("{}")
    return imports.last_said(t.select("session_id", F.lit("main").alias("scope"), "pos", rec.alias("rec")))


@query(f"SELECT page_id, {uuid5_sql('''page_id::VARCHAR || chr(31) || url''')} || '.jsonl' AS file FROM pages")
def mirror_names(spark, sf_dir):
    """The file that mirrors a transcript for a session."""
    return table(spark, sf_dir, "pages").select("page_id", mirror_name(F.col("page_id").cast("string"), F.col("url")).alias("file"))


@query(f"""WITH {ENV}, e AS (SELECT *, session_id LIKE '%3' AS managed, seq % 2 = 0 AS by_hook, session_id NOT LIKE '%7' AS enabled, session_id LIKE '%5' AS at_turn_end FROM env)
SELECT session_id, seq, event = 'SessionEnd' OR (event IN ('Stop', 'SubagentStop') AND at_turn_end) AS flushes, event IN ('UserPromptSubmit', 'Stop', 'StopFailure', 'SubagentStop', 'SessionEnd') AS hydrates FROM e WHERE enabled AND NOT (managed AND NOT by_hook)""")
def forwarded_events(spark, sf_dir):
    """Events that are forwarded, and which of them flush or refer to a mirrored transcript."""
    e = envelopes(spark, sf_dir).withColumns({"managed": F.endswith("session_id", F.lit("3")), "by_hook": F.col("seq") % 2 == 0, "enabled": ~F.endswith("session_id", F.lit("7")), "source": F.lit("claude-code"), "flush_mode": F.when(F.endswith("session_id", F.lit("5")), routing.AT_TURN_END)})
    e = routing.forwarded(e)
    return e.select("session_id", "seq", routing.flushes().alias("flushes"), routing.hydrates().alias("hydrates"))


@query("""SELECT doc_id, CASE WHEN NOT contains(d, ':') THEN 'destination must be a kind and an id' WHEN split_part(d, ':', 2) = '' THEN 'destination id must not be empty' WHEN split_part(d, ':', 1) NOT IN ('project_logs', 'experiment') THEN 'unsupported destination' END AS problem,
CASE WHEN split_part(d, ':', 1) IN ('project_logs', 'experiment') AND split_part(d, ':', 2) <> '' THEN split_part(d, ':', 1) END AS kind, CASE WHEN split_part(d, ':', 1) IN ('project_logs', 'experiment') AND split_part(d, ':', 2) <> '' THEN split_part(d, ':', 2) END AS id
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'project_logs:' WHEN 1 THEN 'experiment:' WHEN 2 THEN 'other:' ELSE 'none' END || CASE WHEN doc_id % 5 > 0 AND doc_id % 4 < 3 THEN lang ELSE '' END AS d FROM documents)""")
def destinations(spark, sf_dir):
    """Where spans go: a kind and an id, or what is wrong with the text."""
    i = F.col("doc_id")
    text = F.concat(F.when(i % 4 == 0, "project_logs:").when(i % 4 == 1, "experiment:").when(i % 4 == 2, "other:").otherwise("none"), F.when((i % 5 > 0) & (i % 4 < 3), F.col("lang")).otherwise(""))
    d = table(spark, sf_dir, "documents").select("doc_id", routing.destination(text).alias("d"))
    return d.select("doc_id", "d.problem", "d.kind", "d.id")


@query(f"""WITH {ENV}, s AS (SELECT session_id, {span_sql('session_id', "'root'")} AS root FROM env GROUP BY 1)
SELECT root AS span_id, CASE WHEN session_id LIKE '%1' THEN 'far' ELSE root END AS root_span_id, CASE WHEN session_id LIKE '%1' THEN 'near' END AS parent_span_id FROM s
UNION ALL SELECT {span_sql('e.session_id', "'event:' || (seq - 1)")}, CASE WHEN e.session_id LIKE '%1' THEN 'far' ELSE root END, root FROM env e JOIN s ON e.session_id = s.session_id""")
def routed_spans(spark, sf_dir):
    """Spans below the destination of their session: its root is theirs, top spans get its parent."""
    from ..operators.spans import fold
    from .translate.debug import debug_ops

    ops = debug_ops(envelopes(spark, sf_dir).withColumns({"source": F.lit("driver"), "payload": F.lit(None).cast("string")}))
    spans = fold(ops)
    mine = F.endswith("session_id", F.lit("1"))
    spans = spans.withColumns({"destination_parent": F.when(mine, "near"), "destination_root": F.when(mine, "far")})
    return with_destination(spans).select("span_id", "root_span_id", "parent_span_id")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'file:' || url ELSE 'ephemeral:' || substr(sha256(url), 1, 12) || ':' || page_id END AS session_key FROM pages""")
def session_keys_of_pi(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", routing.pi_session(F.when(F.col("page_id") % 3 == 0, F.col("url")), F.col("page_id").cast("string"), F.col("url")).alias("session_key"))


@query(f"""WITH {ENV}, m AS (SELECT session_id, max(seq) * 10 AS size, (max(seq) * 7 + length(session_id) * 20) % 90 AS mirrored FROM env GROUP BY 1)
SELECT session_id, CASE WHEN size < mirrored THEN 0 ELSE mirrored END AS from_offset, size - CASE WHEN size < mirrored THEN 0 ELSE mirrored END AS new_bytes, size < mirrored AS rebuilds FROM m""")
def mirror_plan(spark, sf_dir):
    """Which bytes of each transcript its mirror lacks; a transcript that is shorter than its mirror is copied anew."""
    m = envelopes(spark, sf_dir).groupBy("session_id").agg((F.max("seq") * 10).alias("size"), ((F.max("seq") * 7 + F.length(F.first("session_id")) * 20) % 90).alias("mirrored"))
    return routing.mirrored(m)


@query(f"""WITH {TRX}, p AS (SELECT session_id, count(*) AS n, CASE WHEN session_id LIKE '%3' THEN 'mirror' WHEN session_id LIKE '%5' OR session_id LIKE '%3' THEN 'snapshot' ELSE 'live' END AS origin FROM trx GROUP BY 1)
SELECT '/p/' || session_id AS path, origin, n FROM p""")
def source_preference(spark, sf_dir):
    """Where each transcript is read: in its mirror, else in what the event brought along, else in the live file."""
    rows = transcripts(spark, sf_dir).select(F.concat(F.lit("/p/"), "session_id").alias("path"), "pos")
    in_mirror, in_snapshot = F.endswith("path", F.lit("3")), F.endswith("path", F.lit("5")) | F.endswith("path", F.lit("3"))
    best = files.preferred(*(rows.where(has).withColumn("origin", F.lit(name)) for name, has in (("mirror", in_mirror), ("snapshot", in_snapshot), ("live", F.lit(True)))))
    return best.groupBy("path", "origin").agg(F.count("*").alias("n"))


@query(f"""WITH {TRX}, x AS (SELECT session_id, pos AS seq, 'cmd' || (pos % 4) AS name FROM trx WHERE role = 'user'), l AS (SELECT session_id, 'cmd' || ((pos + 1) % 4) AS name, min(pos) AS listed FROM trx WHERE role = 'assistant' GROUP BY ALL),
k AS (SELECT x.* FROM x JOIN l USING (session_id, name) WHERE listed <= seq), f AS (SELECT session_id, name, min(seq) AS first FROM k GROUP BY ALL)
SELECT k.session_id, k.seq, string_agg(f.name, ',' ORDER BY f.first) AS names FROM k JOIN f ON f.session_id = k.session_id AND f.first <= k.seq GROUP BY ALL""")
def listed_skills(spark, sf_dir):
    """Commands of prompts that an earlier listing of the transcript has as skills, with those before them."""
    t = transcripts(spark, sf_dir)
    pos = F.col("pos")
    asked = F.to_json(F.struct(F.concat(F.lit("/cmd"), (pos % 4).cast("string")).alias("command_name"), F.lit("/t").alias("transcript_path")))
    events = t.where("role = 'user'").select("session_id", pos.alias("seq"), F.lit("UserPromptExpansion").alias("event"), (pos * 10).alias("ts_ms"), asked.alias("payload"))
    names = F.to_json(F.struct(F.struct(F.array(F.concat(F.lit("cmd"), ((pos + 1) % 4).cast("string"))).alias("names")).alias("attachment")))
    records = t.where("role = 'assistant'").select("session_id", F.lit("main").alias("scope"), "pos", (pos * 10).alias("ts_ms"), names.alias("rec"))
    return claude.skills(claude.prepared(events), records).select("session_id", "seq", F.array_join("names", ",").alias("names"))

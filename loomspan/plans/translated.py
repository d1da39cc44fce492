"""The translators over the driver's tables read as agent events, and SQL that says what spans these must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import fold
from ..sources.stand_ins import ENV, TRX, envelopes, span_sql, transcripts
from .registry import query
from .translate.claude import claude_ops
from .translate.codex import codex_ops
from .translate.opencode import opencode_ops
from .translate.pi import pi_ops

SHOWN = ("span_id", "root_span_id", "session_id", "name", "span_type", "start_ms", "end_ms", "error", "n_ops")


def _spans(ops: DataFrame, *more: Column) -> DataFrame:
    return fold(ops).select(*SHOWN, F.get("parent_span_ids", F.lit(0)).alias("parent_span_id"), *more)


def _id(key: str) -> str:
    return span_sql("session_id", key)


def _row(key: str, name: str, kind: str, start: str, end: str, ops: str, parent: str | None, error: str = "NULL::VARCHAR", more: str = "") -> str:
    """SELECT list of a span."""
    above = _id(parent) if parent else "NULL::VARCHAR"
    return f"""{_id(key)} AS span_id, {_id("'root'")} AS root_span_id, session_id, {name} AS name, '{kind}' AS span_type, ({start})::BIGINT AS start_ms, ({end})::BIGINT AS end_ms, {error} AS error, ({ops})::BIGINT AS n_ops, {above} AS parent_span_id{more}"""


CLAUDE = f"""WITH {ENV}, t AS (SELECT *, sum(CASE WHEN event = 'UserPromptSubmit' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS turn FROM env),
m AS (SELECT *, CASE WHEN event = 'UserPromptSubmit' THEN turn WHEN event = 'Stop' THEN -1 END AS mk FROM t),
o AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mark, last_value(mk IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM m),
e AS (SELECT *, CASE WHEN mark > 0 THEN mark END AS own, mk IS NOT NULL AND coalesce(was > 0, false) AS closes FROM o),
r AS (SELECT session_id, arg_min(ts_ms, seq) AS s FROM env GROUP BY 1),
c AS (SELECT session_id, was AS turn, min(seq) AS c, arg_min(ts_ms, seq) AS c_ms FROM e WHERE closes GROUP BY ALL),
a AS (SELECT session_id, call_id, min(seq) AS s, arg_min(own, seq) AS own, arg_min(ts_ms, seq) AS s_ms FROM e WHERE event = 'PreToolUse' AND own IS NOT NULL GROUP BY ALL),
b AS (SELECT session_id, call_id, min(seq) AS x, arg_min(coalesce(own, 0), seq) AS own2, arg_min(ts_ms, seq) AS x_ms, arg_min(event, seq) AS x_event FROM e WHERE event IN ('PostToolUse', 'PostToolUseFailure') GROUP BY ALL),
k AS (SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.call_id, b.call_id) AS call_id, coalesce(own, nullif(own2, 0)) AS turn, s, s_ms, x, x_ms, x_event FROM a FULL JOIN b ON a.session_id = b.session_id AND a.call_id = b.call_id),
l AS (SELECT k.*, c_ms, s IS NOT NULL AND (x IS NULL OR x > coalesce(c, 9e18)) AS late FROM k LEFT JOIN c ON c.session_id = k.session_id AND c.turn = k.turn AND s IS NOT NULL WHERE k.turn IS NOT NULL)
SELECT {_row("'root'", "'Claude Code: ' || session_id", "task", "s", "NULL", "1", None)} FROM r
UNION ALL SELECT {_row("'turn:' || turn::BIGINT", "'Turn ' || turn::BIGINT", "task", "ts_ms", "c_ms", "CASE WHEN c_ms IS NULL THEN 1 ELSE 2 END", "'root'")} FROM (SELECT * FROM e WHERE event = 'UserPromptSubmit') p LEFT JOIN c USING (session_id, turn)
UNION ALL SELECT {_row("'tool:' || call_id", "'Terminal: run ' || call_id", "tool", "coalesce(s_ms, x_ms)", "CASE WHEN late THEN c_ms ELSE x_ms END", "1", "'turn:' || turn::BIGINT", "CASE WHEN late AND c_ms IS NOT NULL THEN 'Turn ended before tool completion' WHEN NOT late AND x_event = 'PostToolUseFailure' THEN 'Tool execution failed' END")} FROM l"""


@query(CLAUDE)
def claude_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir)
    payload = F.to_json(F.struct(F.lit("Bash").alias("tool_name"), F.col("call_id").alias("tool_use_id"), F.struct(F.concat(F.lit("run "), "call_id").alias("command")).alias("tool_input"), F.concat(F.lit("/work/"), "session_id").alias("cwd"), F.col("seq").cast("string").alias("prompt")))
    return _spans(claude_ops(e.withColumn("payload", payload)))


def _asked(spark: SparkSession, sf_dir: str, user: list, assistant: list) -> DataFrame:
    """Transcript records as events: each user record gives those of `user`, each assistant record those of `assistant`."""
    t = transcripts(spark, sf_dir).where("role in ('user', 'assistant')")
    both = [F.array(*(F.struct(F.lit(n).alias("event"), F.to_json(p).alias("payload")) for n, p in events)) for events in (user, assistant)]
    t = t.select("session_id", "pos", F.posexplode(F.when(F.col("role") == "user", both[0]).otherwise(both[1])).alias("k", "e"))
    return t.select("session_id", (F.col("pos") * 10 + F.col("k") + 1).alias("seq"), "e.event", (F.col("pos") * 1000 + F.col("k")).alias("ts_ms"), "e.payload", F.lit(None).cast("string").alias("source_version"))


#: Records with the user record before them: its place u, its number, and the next one's place.
ASKED = f"""WITH {TRX}, q AS (SELECT * FROM trx WHERE role IN ('user', 'assistant')),
n AS (SELECT *, max(CASE WHEN role = 'user' THEN pos END) OVER w AS u, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS turn FROM q WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
g AS (SELECT *, lead(pos) OVER (PARTITION BY session_id ORDER BY pos) AS next FROM n WHERE role = 'user'),
f AS (SELECT session_id, min(pos * 1000) AS first_ms, max(pos * 1000 + CASE WHEN role = 'user' THEN 0 ELSE {{late}} END) AS last_ms, min(u) * 1000 AS asked_ms FROM n GROUP BY 1),
a AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY pos) AS k FROM n WHERE role = 'assistant' AND u IS NOT NULL)"""
PI = f"""{ASKED.format(late=1)}
SELECT {_row("'root'", "'Pi'", "task", "first_ms", "last_ms", "2", None)} FROM f
UNION ALL SELECT {_row("'turn:' || turn::BIGINT", "'Turn ' || turn::BIGINT", "task", "pos * 1000", "coalesce(next * 1000, last_ms)", "2", "'root'", "CASE WHEN next IS NULL THEN 'Interrupted before completion' END")} FROM g JOIN f USING (session_id)
UNION ALL SELECT {_row("'llm:' || turn::BIGINT || ':' || k", "'m'", "llm", "pos * 1000", "pos * 1000 + 1", "1", "'turn:' || turn::BIGINT")} FROM a"""


@query(PI)
def pi_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.struct(F.struct(F.lit("assistant").alias("role"), F.lit("m").alias("model"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"), F.struct(F.length("text").alias("input"), F.col("pos").alias("output")).alias("usage")).alias("message"))
    events = _asked(spark, sf_dir, [("before_agent_start", F.struct(F.col("text").alias("prompt")))], [("context", F.struct(F.col("pos"))), ("message_end", message)])
    return _spans(pi_ops(events, finalize=True))


OPENCODE = f"""{ASKED.format(late=0)}, d AS (SELECT * FROM f WHERE asked_ms IS NOT NULL)
SELECT * REPLACE ({_id("'session:' || session_id")} AS root_span_id) FROM (
SELECT {_row("'session:' || session_id", "'OpenCode'", "task", "asked_ms", "last_ms", "2", None)} FROM d
UNION ALL SELECT {_row("'turn:' || session_id || ':' || turn::BIGINT", "'Turn ' || turn::BIGINT", "task", "pos * 1000", "coalesce(next * 1000, last_ms)", "2", "'session:' || session_id")} FROM g JOIN d USING (session_id)
UNION ALL SELECT {_row("'llm:' || session_id || ':' || pos", "'unknown/unknown'", "llm", "pos * 1000", "pos * 1000 + 9", "1", "'turn:' || session_id || ':' || turn::BIGINT")} FROM a)"""


@query(OPENCODE)
def opencode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = F.col("session_id")
    asked = F.struct(F.struct(sid.alias("sessionID")).alias("input"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("parts")).alias("output"))
    info = F.struct(F.col("pos").cast("string").alias("id"), sid.alias("sessionID"), F.lit("assistant").alias("role"), F.struct((F.col("pos") * 1000).alias("created"), (F.col("pos") * 1000 + 9).alias("completed")).alias("time"))
    events = _asked(spark, sf_dir, [("chat.message", asked)], [("message.updated", F.struct(F.struct(info.alias("info")).alias("properties")))])
    return _spans(opencode_ops(events, finalize=True))


def _call(which: int) -> str:
    """A model call of an assistant record: before its tool, or after."""
    start = ["coalesce(lag(pos) OVER (PARTITION BY session_id, turn ORDER BY pos) * 1000 + 8, u * 1000 + 3)", "pos * 1000 + 7"][which]
    return _row(f"'llm:t' || u || ':' || (2 * k - {2 - which})", "'m1'", "llm", start, f"pos * 1000 + {[5, 8][which]}", "2", "'turn:t' || u", more=", length(text)::DOUBLE AS prompt_tokens")


CODEX = f"""{ASKED.format(late=0)}, h AS (SELECT session_id, min(pos) * 1000 AS s FROM trx GROUP BY 1)
SELECT {_row("'root'", "'codex: ' || session_id", "task", "s", "NULL", "2", None, more=", NULL::DOUBLE AS prompt_tokens")} FROM h
UNION ALL SELECT {_row("'turn:t' || pos", "'turn: t' || pos", "task", "pos * 1000 + 3", "next * 1000 + 2", "CASE WHEN next IS NULL THEN 2 ELSE 3 END", "'root'", more=", NULL::DOUBLE AS prompt_tokens")} FROM g
UNION ALL SELECT {_row("'tool:k' || pos", "'shell'", "tool", "pos * 1000 + 5", "pos * 1000 + 7", "2", "'turn:t' || u", "CASE WHEN length(text) % 5 = 0 THEN 'error: x' END", ", NULL::DOUBLE AS prompt_tokens")} FROM a
UNION ALL SELECT {_call(0)} FROM a UNION ALL SELECT {_call(1)} FROM a"""


def codex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts: each user record ends the turn before and starts one; each assistant record is a call of a tool, its output and an answer, with counts of tokens after each."""
    t = transcripts(spark, sf_dir)
    pos = F.col("pos")

    def made(k: int, kind: str, payload: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload"))).alias("rec"))

    def typed(k: int, kind: str, sub: str, *fields: Column) -> Column:
        return made(k, kind, F.struct(F.lit(sub).alias("type"), *fields))

    call = F.concat(F.lit("k"), pos.cast("string")).alias("call_id")
    counted = F.struct(F.struct(F.length("text").alias("input_tokens"), pos.alias("output_tokens")).alias("last_token_usage")).alias("info")
    first = F.array(made(0, "session_meta", F.struct(F.concat(F.lit("/work/"), "session_id").alias("cwd"))), made(1, "turn_context", F.struct(F.lit("m1").alias("model"))))
    user = F.array(typed(2, "event_msg", "task_complete"), typed(3, "event_msg", "task_started", F.concat(F.lit("t"), pos.cast("string")).alias("turn_id")), typed(4, "event_msg", "user_message", F.lit("go on").alias("message")))
    assistant = F.array(
        typed(5, "response_item", "function_call", call, F.lit("shell").alias("name"), F.lit("{}").alias("arguments")), typed(6, "event_msg", "token_count", counted),
        typed(7, "response_item", "function_call_output", call, F.when(F.length("text") % 5 == 0, "error: x").otherwise("ok").alias("output")),
        typed(8, "response_item", "message", F.lit("assistant").alias("role"), F.array(F.struct(F.col("text"))).alias("content")), typed(9, "event_msg", "token_count", counted))
    none = F.filter(first, lambda x: F.lit(False))
    begin = t.groupBy("session_id").agg(F.min("pos").alias("begin"))
    rows = t.join(begin, "session_id").select("session_id", "pos", F.explode(F.concat(F.when(pos == F.col("begin"), first).otherwise(none), F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(none))).alias("r"))
    return rows.select("session_id", F.lit("main").alias("scope"), (pos * 10 + F.col("r.k")).alias("pos"), (pos * 1000 + F.col("r.k")).alias("ts_ms"), "r.rec")


@query(CODEX)
def codex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the rollouts, without hooks."""
    records = codex_records(spark, sf_dir)
    events = spark.createDataFrame([], "session_id string, seq long, event string, ts_ms long, payload string")
    return _spans(codex_ops(events, records), F.col("metrics")["prompt_tokens"].alias("prompt_tokens"))

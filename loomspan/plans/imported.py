"""Imports of whole transcripts over the driver's conversations written as Claude's and Codex's files, and SQL that says what spans these must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stand_ins import TRX, transcripts
from .registry import query
from .translate.claude import claude_ops
from .translate.codex import codex_ops
from .translate.importing import claude_import, codex_import, growing
from .translated import _row, _spans

def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _line(path: Column, at: Column, ts: Column, rec: Column, when: Column | None = None) -> Column:
    """A record of a file, or null where it isn't written."""
    row = F.struct(path.alias("path"), at.cast("long").alias("pos"), (at * 100).cast("long").alias("end_offset"), ts.cast("long").alias("ts_ms"), F.to_json(rec).alias("rec"))
    return row if when is None else F.when(when, row)


def _files(t: DataFrame, *lines: Column) -> DataFrame:
    return t.select(F.explode(F.array_compact(F.array(*lines))).alias("l")).select("l.*")


def claude_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users ask, assistants answer; every fifth place is an error of the service. At every third place the assistant calls a subagent, which answers in a file of its own."""
    t, pos = transcripts(spark, sf_dir), F.col("pos")
    main, cwd, sid = _text("/p/", F.col("session_id"), ".jsonl"), _text("/work/", F.col("session_id")).alias("cwd"), F.col("session_id").alias("sessionId")
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    spawns = answer & (pos % 3 == 0)
    block = "struct<type:string,text:string,id:string,name:string,input:struct<subagent_type:string>>"
    said = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<subagent_type:string>").alias("input")).cast(block)
    used = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), _text("t", pos).alias("id"), F.lit("Agent").alias("name"), F.struct(F.lit("kind").alias("subagent_type")).alias("input")).cast(block)
    asked = F.struct(F.lit("user").alias("type"), sid, cwd, F.struct(F.col("text").alias("content")).alias("message"))
    message = F.struct(_text("m", pos).alias("id"), F.lit("m").alias("model"), F.when(spawns, F.array(said, used)).otherwise(F.array(said)).alias("content"))
    wrong = pos % 5 == 0
    answered = F.struct(F.lit("assistant").alias("type"), sid, cwd, F.when(wrong, F.lit(True)).alias("isApiErrorMessage"), F.when(wrong, _text("e", pos)).alias("error"), message.alias("message"))
    gave = F.struct(F.lit("user").alias("type"), sid, cwd, F.struct(_text("a", pos).alias("agentId")).alias("toolUseResult"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), _text("t", pos).alias("tool_use_id"))).alias("content")).alias("message"))
    told = F.struct(F.lit("assistant").alias("type"), sid, F.struct(_text("c", pos).alias("id"), F.lit("sub").alias("model"), F.array(said).alias("content")).alias("message"))
    agent_file = _text("/p/", F.col("session_id"), "/subagents/agent-a", pos, ".jsonl")
    noted = F.struct(F.lit("system").alias("type"), sid, cwd)
    return _files(t, _line(main, pos * 10, pos * 1000, asked, user), _line(main, pos * 10, pos * 1000, answered, answer), _line(main, pos * 10, pos * 1000, noted, ~user & ~answer), _line(main, pos * 10 + 1, pos * 1000 + 500, gave, spawns), _line(agent_file, F.lit(0), pos * 1000 + 800, told, spawns))


CLAUDE = f"""WITH {TRX}, n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS turn, role = 'assistant' AND pos % 3 = 0 AS spawns FROM trx),
f AS (SELECT session_id, min(pos) * 1000 AS first_ms, max(pos * 1000 + CASE WHEN spawns THEN 500 ELSE 0 END) AS last_ms FROM n GROUP BY 1),
t AS (SELECT session_id, turn, min(pos) * 1000 AS s, max(pos * 1000 + CASE WHEN spawns THEN 500 ELSE 0 END) FILTER (role IN ('user', 'assistant')) AS x, arg_max('e' || pos, pos) FILTER (role = 'assistant' AND pos % 5 = 0) AS error FROM n WHERE turn > 0 GROUP BY ALL),
c AS (SELECT *, greatest(turn, 1) AS own FROM n WHERE role = 'assistant')
SELECT {_row("'root'", "'Claude Code: ' || session_id", "task", "first_ms - 1", "last_ms + 1", "2", None)} FROM f
UNION ALL SELECT {_row("'turn:' || turn", "'Turn ' || turn", "task", "s", "x", "2", "'root'", "error")} FROM t
UNION ALL SELECT {_row("'main:llm:m' || pos", "'m'", "llm", "pos * 1000", "pos * 1000", "1", "'turn:' || own", "CASE WHEN pos % 5 = 0 THEN 'e' || pos END")} FROM c
UNION ALL SELECT {_row("'tool:t' || pos", "'Agent'", "tool", "pos * 1000", "pos * 1000 + 500", "1", "'turn:' || own")} FROM c WHERE spawns
UNION ALL SELECT {_row("'subagent:a' || pos", "'subagent: kind'", "task", "pos * 1000", "pos * 1000 + 800", "2", "'turn:' || turn")} FROM c WHERE spawns AND turn > 0
UNION ALL SELECT {_row("'subagent:a' || pos || ':llm:c' || pos", "'sub'", "llm", "pos * 1000 + 800", "pos * 1000 + 800", "1", "'subagent:a' || pos")} FROM c WHERE spawns AND turn > 0"""


@query(CLAUDE)
def claude_import_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, turns, calls, tools and subagents of Claude's files."""
    events, records = claude_import(claude_files(spark, sf_dir))
    return _spans(claude_ops(events.drop("turn"), records))


@query(f"""WITH {TRX}, n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS turn FROM trx), m AS (SELECT session_id, max(turn) AS last, max(pos * 1000 + CASE WHEN role = 'assistant' AND pos % 3 = 0 THEN 500 ELSE 0 END) AS last_ms, min(pos) * 1000 AS first_ms FROM n GROUP BY 1),
s AS (SELECT n.session_id, turn, bool_or(role = 'assistant' AND pos % 5 = 0) AS failed, min(pos) * 1000 AS s, max(pos * 1000 + CASE WHEN role = 'assistant' AND pos % 3 = 0 THEN 500 ELSE 0 END) FILTER (role IN ('user', 'assistant')) AS x, count(*) FILTER (role = 'assistant' AND pos % 3 = 0) AS agents FROM n WHERE turn > 0 GROUP BY ALL)
SELECT session_id, 'SessionStart' AS event, count(*) AS n, (min(first_ms) - 1)::BIGINT AS first_ms FROM m GROUP BY 1 UNION ALL SELECT session_id, 'ImportCheckpoint', 1, last_ms + 1 FROM m
UNION ALL SELECT session_id, 'UserPromptSubmit', count(*), min(s) FROM s GROUP BY 1
UNION ALL SELECT session_id, CASE WHEN failed THEN 'StopFailure' ELSE 'Stop' END, count(*), min(x) FROM s JOIN m USING (session_id) WHERE turn < last GROUP BY ALL
UNION ALL SELECT session_id, e, sum(agents)::BIGINT, (SELECT min(pos) FROM n WHERE n.session_id = g.session_id AND n.turn > 0 AND n.turn < g.last AND role = 'assistant' AND pos % 3 = 0) * 1000 + CASE e WHEN 'SubagentStop' THEN 800 ELSE 0 END
FROM (SELECT * FROM s JOIN m USING (session_id) WHERE turn < last AND agents > 0) g, (SELECT unnest(['SubagentStart', 'SubagentStop']) AS e) GROUP BY session_id, e, g.last""")
def transcript_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of growing files may tell already: all of the turns before the newest, of that the prompt, and a checkpoint."""
    events, _ = claude_import(claude_files(spark, sf_dir))
    return growing(events).groupBy("session_id", "event").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"))


def codex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user record ends the turn before and starts one. At every third place an assistant spawns an agent; every other one of these spawns another."""
    t, pos = transcripts(spark, sf_dir), F.col("pos")
    begin = t.groupBy("session_id").agg(F.min("pos").alias("begin"))
    t = t.join(begin, "session_id")
    user = F.col("role") == "user"
    spawns = (F.col("role") == "assistant") & (pos % 3 == 0)
    deeper = spawns & (pos % 6 == 0)
    main = _text("/h/sessions/roll-", F.col("session_id"), ".jsonl")
    child, grand = _text(F.col("session_id"), "x", pos), _text(F.col("session_id"), "y", pos)

    def rollout(agent: Column) -> Column:
        return _text("/h/sessions/", "2024/roll-", agent, ".jsonl")

    def typed(kind: str, sub: str, *fields: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.struct(F.lit(sub).alias("type"), *fields).alias("payload"))

    def meta(agent: Column) -> Column:
        return F.struct(F.lit("session_meta").alias("type"), F.struct(agent.alias("id"), F.struct(F.struct(F.col("session_id").alias("parent")).alias("subagent")).alias("source")).alias("payload"))

    def begins(turn: Column) -> Column:
        return typed("event_msg", "task_started", turn.alias("turn_id"))

    ends = typed("event_msg", "task_complete")

    def call(of: Column) -> Column:
        return typed("response_item", "function_call", of.alias("call_id"), F.lit("spawn_agent").alias("name"), F.lit('{"agent_type":"kind"}').alias("arguments"))

    def answer(of: Column, agent: Column) -> Column:
        return typed("response_item", "function_call_output", of.alias("call_id"), F.to_json(F.struct(agent.alias("agent_id"))).alias("output"))

    head = F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("session_id").alias("id"), _text("/work/", F.col("session_id")).alias("cwd")).alias("payload"))
    at = lambda k: pos * 100 + k
    ms = lambda k: pos * 1000 + k
    return _files(
        t, _line(main, at(0), ms(0), head, pos == F.col("begin")), _line(main, at(2), ms(2), ends, user), _line(main, at(3), ms(3), begins(_text("t", pos)), user), _line(main, at(5), ms(5), call(_text("k", pos)), spawns), _line(main, at(7), ms(7), answer(_text("k", pos), child), spawns),
        _line(rollout(child), at(6), ms(6), meta(child), spawns), _line(rollout(child), at(10), ms(10), begins(_text("c", pos)), spawns), _line(rollout(child), at(11), ms(11), call(_text("g", pos)), deeper), _line(rollout(child), at(12), ms(12), answer(_text("g", pos), grand), deeper), _line(rollout(child), at(20), ms(20), ends, spawns),
        _line(rollout(grand), at(13), ms(13), meta(grand), deeper), _line(rollout(grand), at(14), ms(14), begins(_text("d", pos)), deeper), _line(rollout(grand), at(15), ms(15), ends, deeper))


CODEX = f"""WITH {TRX}, n AS (SELECT *, max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session_id ORDER BY pos) AS u, role = 'assistant' AND pos % 3 = 0 AS spawns, role = 'assistant' AND pos % 6 = 0 AS deeper FROM trx),
f AS (SELECT session_id, min(pos) * 1000 AS first_ms, max(CASE WHEN role = 'user' THEN pos * 1000 + 3 WHEN spawns THEN pos * 1000 + 7 END) AS last_ms, max(u) IS NOT NULL AS asked FROM n GROUP BY 1),
g AS (SELECT *, lead(pos) OVER (PARTITION BY session_id ORDER BY pos) AS next FROM n WHERE role = 'user'),
c AS (SELECT * FROM n WHERE spawns), d AS (SELECT * FROM n WHERE deeper), l AS (SELECT session_id, u, max(pos) AS last FROM c WHERE u IS NOT NULL GROUP BY ALL)
SELECT {_row("'root'", "'codex: ' || session_id", "task", "first_ms", "greatest(coalesce(last_ms, 0), first_ms)", "2", None)} FROM f
UNION ALL SELECT {_row("'turn:t' || pos", "'turn: t' || pos", "task", "pos * 1000 + 3", "coalesce(next * 1000 + 2, last_ms)", "2", "'root'")} FROM g JOIN f USING (session_id)
UNION ALL SELECT {_row("'tool:k' || pos", "'spawn_agent'", "tool", "pos * 1000 + 5", "pos * 1000 + 7", "2", "'turn:t' || u")} FROM c WHERE u IS NOT NULL
UNION ALL SELECT {_row("'llm:t' || u || ':0'", "'llm'", "llm", "u * 1000 + 3", "last * 1000 + 5", "2", "'turn:t' || u")} FROM l
UNION ALL SELECT * REPLACE (coalesce(parent_span_id, root_span_id) AS parent_span_id) FROM (SELECT {_row("'subagent:' || session_id || 'x' || pos", "'subagent: ' || session_id || 'x' || pos", "task", "pos * 1000 + 6", "pos * 1000 + 20", "2", "'turn:t' || u")} FROM c)
UNION ALL SELECT {_row("'turn:c' || pos", "'turn: c' || pos", "task", "pos * 1000 + 10", "pos * 1000 + 20", "2", "'subagent:' || session_id || 'x' || pos")} FROM c
UNION ALL SELECT {_row("'tool:g' || pos", "'spawn_agent'", "tool", "pos * 1000 + 11", "pos * 1000 + 12", "2", "'turn:c' || pos")} FROM d
UNION ALL SELECT {_row("'llm:c' || pos || ':0'", "'llm'", "llm", "pos * 1000 + 10", "pos * 1000 + 11", "2", "'turn:c' || pos")} FROM d
UNION ALL SELECT {_row("'subagent:' || session_id || 'y' || pos", "'subagent: ' || session_id || 'y' || pos", "task", "pos * 1000 + 13", "pos * 1000 + 15", "2", "'turn:c' || pos")} FROM d
UNION ALL SELECT {_row("'turn:d' || pos", "'turn: d' || pos", "task", "pos * 1000 + 14", "pos * 1000 + 15", "2", "'subagent:' || session_id || 'y' || pos")} FROM d"""


@query(CODEX)
def codex_import_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, turns, spawn calls and the agents below them, over two steps, of Codex rollouts."""
    events, records = codex_import(codex_files(spark, sf_dir))
    return _spans(codex_ops(events.drop("turn"), records))

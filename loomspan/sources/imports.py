"""Finding transcripts to import and the subagents that they spawned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.tables import stored


def stem(path: Column) -> Column:
    """The file name of a path without its last extension."""
    return F.regexp_replace(S.base_name(path), r"(?<=.)\.[^.]*$", "")


def discovered(files: DataFrame, session: Column | None = None) -> DataFrame:
    """(session_id, path, files, problem) of listed files (path): transcripts are `.jsonl`, each path counts once.

    session: the session of a path, by default its file's name; paths without one are no transcripts. A session of several files has a problem, and so has each of its rows.
    """
    named = files.select("path").where(F.endswith("path", F.lit(".jsonl"))).distinct().withColumn("session_id", session if session is not None else stem(F.col("path"))).where("session_id is not null")
    n = F.count("*").over(Window.partitionBy("session_id"))
    return named.select("session_id", "path", n.alias("files"), F.when(n > 1, F.lit("multiple transcripts found")).alias("problem"))


def importable(found: DataFrame) -> DataFrame:
    """Discovered transcripts in the order of their paths; an error if there are none or a session has several."""
    counts = found.agg(F.count("*").alias("n"), F.first(F.when(F.col("problem").isNotNull(), F.col("session_id")), ignorenulls=True).alias("bad")).first()
    if not counts.n:
        raise ValueError("no transcripts found")
    if counts.bad is not None:
        raise ValueError(f"multiple transcripts found for session {counts.bad}")
    return found.select("session_id", "path").orderBy("path")


def resolved(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(session_id, status, path) of wanted sessions (session_id): found, missing, ambiguous or invalid.

    A transcript fits the id that its file's name is, or ends with. Names are cut at each hyphen, so that an id is looked up by equality.
    """
    fine = F.col("session_id").rlike(r"\A[A-Za-z0-9_-]+\z")
    parts = F.split("stem", "-")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))
    names = files.select("path").where(F.endswith("path", F.lit(".jsonl"))).distinct().withColumn("stem", stem(F.col("path"))).select("path", F.explode(F.array_distinct(tails)).alias("session_id"))
    hits = wanted.where(fine).select("session_id").distinct().join(names, "session_id").groupBy("session_id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    out = wanted.join(hits, "session_id", "left")
    status = F.when(~F.coalesce(fine, F.lit(False)), "invalid").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return out.select("session_id", status.alias("status"), F.when(F.col("n") == 1, F.col("path")).alias("path"))


def spawn_calls(records: DataFrame) -> DataFrame:
    """(session_id, scope, call, agent, agent_type, start_ms, result_ms) of Codex records: each spawn call with its answer, which must follow it."""
    r = F.col("rec")
    rows = records.withColumns({"kind": S.text_at(r, "payload.type"), "call": S.text_at(r, "payload.call_id")}).where("call is not null")
    calls = rows.where((F.col("kind") == "function_call") & (S.text_at(r, "payload.name") == "spawn_agent")).select("session_id", "scope", "call", F.col("pos").alias("called"), S.text_at(S.text_at(r, "payload.arguments"), "agent_type").alias("agent_type"), F.coalesce("ts_ms", F.lit(0)).alias("start_ms"))
    gave = rows.where("kind = 'function_call_output'").select("session_id", "scope", "call", F.col("pos").alias("answered"), S.text_at(S.text_at(r, "payload.output"), "agent_id").alias("agent"), F.col("ts_ms").alias("gave_ms")).where("agent is not null")
    both = gave.join(calls, ["session_id", "scope", "call"]).where("called < answered")
    latest = Window.partitionBy("session_id", "scope", "call", "answered").orderBy(F.desc("called"))
    both = both.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    return both.select("session_id", "scope", "call", "agent", "agent_type", "start_ms", F.coalesce("gave_ms", "start_ms").alias("result_ms"))


def reached(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth): all that is spawned below roots (root), through edges (a, b), each node of a root once, at its least depth. Circles end."""
    seen = stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    new, depth = seen, 0
    while True:
        depth += 1
        new = stored(new.join(edges, new["node"] == edges["a"]).select("root", F.col("b").alias("node")).distinct().join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not new.take(1):
            return seen
        seen = stored(seen.unionByName(new))


def claude_subagents(files: DataFrame, records: DataFrame) -> DataFrame:
    """(session_id, agent, path, start_pos, record_pos, agent_type) of listed files (session_id, path) named agent-<id>.jsonl.

    A file's place is that of the record that names its agent in a result, else the session's last; it starts with the call that this answers, if known.
    """
    r = F.col("rec")
    blocks = F.from_json(S.json_at(r, "message.content"), "array<struct<type:string,name:string,id:string,tool_use_id:string,input:string>>")
    rows = records.withColumns({"blocks": blocks, "agent": S.text_or_number_at(r, "toolUseResult.agentId")})
    answers = F.filter("blocks", lambda b: (b["type"] == "tool_result") & b["tool_use_id"].isNotNull())
    results = rows.where("agent is not null").groupBy("session_id", "agent").agg(F.max("pos").alias("record_pos"), F.max_by(F.get(answers, F.lit(0))["tool_use_id"], "pos").alias("call"))
    calls = rows.select("session_id", "pos", F.explode("blocks").alias("b")).where("b.type = 'tool_use' and b.name = 'Agent' and b.id is not null")
    calls = calls.groupBy("session_id", F.col("b.id").alias("call")).agg(F.max("pos").alias("called"), F.max_by(S.text_or_number_at(F.col("b.input"), "subagent_type"), "pos").alias("agent_type"))
    last = records.groupBy("session_id").agg(F.max("pos").alias("last_pos"))
    mine = files.withColumn("stem", stem(F.col("path"))).where(F.startswith("stem", F.lit("agent-")) & F.endswith("path", F.lit(".jsonl"))).select("session_id", F.substring("stem", 7, 1 << 20).alias("agent"), "path").distinct()
    out = mine.join(results, ["session_id", "agent"], "left").join(calls, ["session_id", "call"], "left").join(last, "session_id", "left")
    record = F.coalesce("record_pos", "last_pos", F.lit(0))
    return out.select("session_id", "agent", "path", F.coalesce("called", record).cast("long").alias("start_pos"), record.cast("long").alias("record_pos"), "agent_type")


def claude_said(rec: Column) -> tuple[Column, Column]:
    """The text and the error of an assistant record of Claude, or null."""
    content = S.json_at(rec, "message.content")
    blocks = F.from_json(F.when(F.startswith(content, F.lit("[")), content), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    answers = S.text_at(rec, "type") == "assistant"
    said = F.when(answers, F.coalesce(S.text_at(rec, "message.content"), F.when(joined != "", joined)))
    return said, F.when(answers & S.true_at(rec, "isApiErrorMessage"), F.coalesce(S.text_or_number_at(rec, "error"), said, F.lit("Claude API error")))


def codex_said(rec: Column) -> Column:
    """The last message that a record which ends a Codex turn names, as JSON."""
    return F.when(S.text_at(rec, "payload.type") == "task_complete", S.json_at(rec, "payload.last_agent_message"))


def last_said(records: DataFrame) -> DataFrame:
    """(session_id, scope, said, error, codex): the last assistant text and error of Claude records, and the last message that ended a Codex turn."""
    said, error = claude_said(F.col("rec"))
    rows = records.withColumns({"said": said, "error": error, "codex": codex_said(F.col("rec"))})
    return rows.groupBy("session_id", "scope").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("said", "error", "codex")))

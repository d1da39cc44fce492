"""Transcripts without hooks: the events that a session would have sent are made from its files, and translated with its records.

records: (path, pos, end_offset, ts_ms, rec) of all files below some folder, subagents' files among them. Both imports give (events, records) as
the translators take them: a session's own records in scope `main`, those of each subagent in scope `subagent:<id>`, all under the session that is imported.

Events are ordered by what they mean, not by their times, which need not grow along a file: start, then turn by turn, then end. A turn lasts from its
prompt to the latest of its user and assistant records; other records, which may stand ahead of older ones, don't count.

Defined cases: a session is named by the first record that says so, else by its file; broken lines and files without records are errors of `checked`;
a subagent whose place lies before the first prompt, or that no file holds, is left out; one that several calls name is taken where it is reached first. Nothing is collected: sessions are partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import scalars as S
from ...operators.tables import stored
from ...sources import imports
from .attach import CLAUDE, CODEX

#: Files of Claude's subagents: below the folder of their session's file.
SUBAGENT = r"^(.*)/subagents/(?:.*/)?agent-([^/]+)\.jsonl$"
#: Below these folders all rollouts of Codex are looked for (fixed values).
HOMES = r"^(.*?/(?:sessions|archived_sessions))/"
BOUNDARIES = ("task_started", "task_complete", "turn_aborted")
LAST = 1 << 40


def checked(records: DataFrame) -> DataFrame:
    """records, or an error if one of their lines isn't JSON, or if there are none."""
    found = records.agg(F.count("*").alias("n"), F.min(F.when(F.col("rec").isNull(), F.concat_ws(" line ", "path", (F.col("pos") + 1).cast("string")))).alias("broken")).first()
    if found.broken is not None:
        raise ValueError(f"parse transcript {found.broken}")
    if not found.n:
        raise ValueError("transcripts are empty")
    return records


def _bounds(rows: DataFrame, *keys: str) -> DataFrame:
    """The first and last time of each file, 0 where it has none."""
    return rows.groupBy(*keys).agg(F.coalesce(F.min("ts_ms"), F.lit(0)).alias("first_ms"), F.coalesce(F.max("ts_ms"), F.lit(0)).alias("last_ms"))


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("pos")))


def _event(rows: DataFrame, name: str | Column, ts: Column, rank: Column, *fields: Column) -> DataFrame:
    """rows: session_id, version, turn, part."""
    kind = F.lit(name) if isinstance(name, str) else name
    return rows.select("session_id", "version", "turn", rank.alias("rank"), "part", kind.alias("event"), ts.alias("ts_ms"), F.to_json(F.struct("session_id", kind.alias("hook_event_name"), *fields)).alias("payload"))


def _numbered(parts: list[DataFrame], source: str) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("turn", "rank", "part", "ts_ms")
    every = reduce(DataFrame.unionByName, parts).withColumn("seq", F.row_number().over(order).cast("long"))
    return every.select(F.lit(source).alias("source"), "session_id", "seq", "event", "ts_ms", "payload", F.col("version").alias("source_version"), "turn")


def claude_import(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (with the turn they belong to) and records of all sessions that Claude's transcripts hold."""
    r = "rec"
    owner, agent = F.regexp_extract("path", SUBAGENT, 1), F.regexp_extract("path", SUBAGENT, 2)
    said, error = imports.claude_said(r)
    content = S.json_at(r, "message.content")
    blocks = F.from_json(F.when(F.startswith(content, F.lit("[")), content), "array<struct<type:string>>")
    kind = S.text_at(r, "type")
    real = (kind == "user") & ~F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))
    rows = stored(records.select("path", "pos", "end_offset", "ts_ms", "rec", F.when(owner != "", F.concat(owner, F.lit(".jsonl"))).otherwise(F.col("path")).alias("main"), F.when(agent != "", agent).alias("agent"), F.coalesce(real, F.lit(False)).alias("real"), F.coalesce(kind.isin("user", "assistant"), F.lit(False)).alias("talks"), said.alias("said"), error.alias("error"), S.text_or_number_at(r, "cwd").alias("cwd"), S.text_at(r, "sessionId").alias("named"), S.text_or_number_at(r, "version").alias("version")))
    mine = rows.where("agent is null")
    heads = mine.groupBy("path").agg(F.coalesce(_first(F.col("named")), F.first(imports.stem(F.col("path")))).alias("session_id"), _first(F.col("version")).alias("version"), _first(F.col("cwd")).alias("home"), F.coalesce(F.min("ts_ms"), F.lit(0)).alias("first_ms"), F.coalesce(F.max("ts_ms"), F.lit(0)).alias("last_ms"))
    placed = mine.withColumn("turn", F.coalesce(F.sum(F.col("real").cast("long")).over(Window.partitionBy("path").orderBy("pos")), F.lit(0)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    turns = placed.where("turn > 0").groupBy("path", "turn").agg(F.min("pos").alias("from_pos"), F.min_by("ts_ms", "pos").alias("asked_ms"), F.max(F.when(F.col("talks"), F.col("ts_ms"))).alias("talked_ms"), _first(F.col("cwd")).alias("cwd"), F.min_by(S.json_at(r, "message.content"), "pos").alias("prompt"), last("said"), last("error"))
    path = F.col("path").alias("transcript_path")
    none = F.lit("").alias("part")
    t = turns.join(heads, "path").select("*", none).withColumns({"cwd": F.coalesce("cwd", "home"), "start_ms": F.coalesce("asked_ms", "first_ms")}).withColumn("stop_ms", F.coalesce("talked_ms", "start_ms"))
    began, ended = heads.select("*", F.lit(0).cast("long").alias("turn"), none), heads.select("*", F.lit(LAST).alias("turn"), none)
    failed = F.when(F.col("error").isNotNull(), "StopFailure").otherwise("Stop")
    prompts = _event(t, "UserPromptSubmit", F.col("start_ms"), F.lit(0), path, F.col("cwd"), F.try_parse_json("prompt").alias("prompt"))
    stops = _event(t, failed, F.col("stop_ms"), F.lit(2), path, F.col("cwd"), F.col("said").alias("last_assistant_message"), F.col("error"))
    start = _event(began, "SessionStart", F.col("first_ms") - 1, F.lit(0), path, F.col("home").alias("cwd"), F.lit("import").alias("source"))
    end = _event(ended, "SessionEnd", F.col("last_ms") + 1, F.lit(9), path, F.col("home").alias("cwd"), F.lit("transcript_import").alias("reason"))
    # Subagents stand in the turn of the record that names them.
    files = rows.where("agent is not null").select(F.col("main").alias("session_id"), "path").distinct()
    found = imports.claude_subagents(files, mine.select(F.col("path").alias("session_id"), "pos", "rec")).withColumnRenamed("session_id", "main").withColumnRenamed("path", "agent_path")
    theirs = _bounds(rows.where("agent is not null"), "path").select(F.col("path").alias("agent_path"), F.col("first_ms").alias("child_first"), F.col("last_ms").alias("child_last"))
    spoke = rows.where("agent is not null").groupBy(F.col("path").alias("agent_path")).agg(last("said"))
    at = placed.select(F.col("path").alias("main"), "pos", "ts_ms", "turn")
    began_at, named_at = at.select("main", F.col("pos").alias("start_pos"), F.col("ts_ms").alias("call_ms")), at.select("main", F.col("pos").alias("record_pos"), F.col("ts_ms").alias("result_ms"), "turn")
    a = found.join(theirs, "agent_path").join(spoke, "agent_path").join(began_at, ["main", "start_pos"], "left").join(named_at, ["main", "record_pos"]).where("turn > 0").join(heads.select(F.col("path").alias("main"), "session_id", "version"), "main")
    a = stored(a.withColumns({"from_ms": F.least(F.coalesce("call_ms", "child_first"), "child_first"), "to_ms": F.greatest(F.coalesce("result_ms", "child_last"), "child_last")}))
    names = (F.col("main").alias("transcript_path"), F.col("agent").alias("agent_id"), F.col("agent_type"), F.col("agent_path").alias("agent_transcript_path"))
    opened = _event(a.withColumn("part", F.concat("agent_path", F.lit("\u0001"))), "SubagentStart", F.col("from_ms"), F.lit(1), *names)
    closed = _event(a.withColumn("part", F.concat("agent_path", F.lit("\u0002"))), "SubagentStop", F.col("to_ms"), F.lit(1), *names, F.col("said").alias("last_assistant_message"))
    own = mine.join(heads.select("path", "session_id"), "path").select("session_id", F.lit("main").alias("scope"), "pos", "ts_ms", "rec")
    children = rows.where("agent is not null").join(a.select("session_id", F.col("agent_path").alias("path"), F.concat(F.lit("subagent:"), "agent").alias("scope")), "path").select("session_id", "scope", "pos", "ts_ms", "rec")
    return _numbered([start, prompts, opened, closed, stops, end], CLAUDE), own.unionByName(children)


def codex_import(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and records of all sessions that Codex rollouts hold, with the subagents that their spawn calls lead to, over any number of steps."""
    r = "rec"
    is_meta = S.text_at(r, "type") == "session_meta"
    home = F.regexp_extract("path", HOMES, 1)
    rows = stored(records.select("path", "pos", "ts_ms", "rec", F.when(home != "", home).otherwise(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).alias("home"), F.when(is_meta, S.text_at(r, "payload.id")).alias("named"), F.when(is_meta, S.text_at(r, "payload.cli_version")).alias("version"), F.when(is_meta, S.json_at(r, "payload.source.subagent").isNotNull()).alias("child"), F.coalesce(S.text_at(r, "payload.type").isin(*BOUNDARIES), F.lit(False)).alias("boundary"), imports.codex_said(r).alias("said")))
    said = F.max_by("said", F.when(F.col("said").isNotNull(), F.col("pos"))).alias("said")
    heads = stored(rows.groupBy("path").agg(F.first("home").alias("home"), F.coalesce(_first(F.col("named")), F.first(imports.stem(F.col("path")))).alias("session_id"), _first(F.col("version")).alias("version"), F.coalesce(_first(F.col("child")), F.lit(False)).alias("child"), F.coalesce(F.min("ts_ms"), F.lit(0)).alias("first_ms"), F.coalesce(F.max("ts_ms"), F.lit(0)).alias("last_ms"), said))
    # A spawned agent's file is the first below the same home whose name ends with the agent's id.
    calls = imports.spawn_calls(rows.select(F.col("path").alias("session_id"), F.lit("main").alias("scope"), "pos", "ts_ms", "rec")).select(F.col("session_id").alias("path"), "call", "agent", "agent_type", "start_ms", "result_ms").join(heads.select("path", "home"), "path")
    ids = calls.select("home", F.col("agent").alias("session_id")).distinct()
    tails = heads.select("home", "path", F.split(imports.stem(F.col("path")), "-").alias("parts"))
    tails = tails.select("home", "path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "-")))).alias("session_id"))
    files = ids.join(tails, ["home", "session_id"]).groupBy("home", F.col("session_id").alias("agent")).agg(F.min("path").alias("child_path"))
    edges = stored(calls.join(files, ["home", "agent"]).where("path <> child_path"))
    roots = heads.where("not child")
    below = imports.reached(roots.select(F.col("path").alias("root")), edges.select(F.col("path").alias("a"), F.col("child_path").alias("b")).distinct()).where("depth > 0")
    # Of several calls that name an agent, the one that is reached first, and then is first, counts.
    ways = below.select("root", F.col("node").alias("child_path"), "depth").join(edges, "child_path").join(_files_of(below, roots), ["root", "path"]).where("up_depth < depth")
    pick = Window.partitionBy("root", "child_path").orderBy("up_depth", "result_ms", "path", "call")
    ways = ways.withColumn("_n", F.row_number().over(pick)).where("_n = 1")
    child = heads.select(F.col("path").alias("child_path"), F.col("first_ms").alias("child_first"), F.col("last_ms").alias("child_last"), F.col("said").alias("child_said"))
    above = heads.select(F.col("path").alias("root"), "session_id", "version")
    owner = ways.select("root", F.col("child_path").alias("path"), F.col("agent").alias("parent_agent"))
    a = stored(ways.join(child, "child_path").join(above, "root").join(owner, ["root", "path"], "left").withColumn("turn", F.lit(2).cast("long")))
    by_depth = F.format_string("%010d %020d %s", "depth", "start_ms", "agent")
    told = _event(a.withColumn("part", by_depth), "PostToolUse", F.col("result_ms"), F.lit(0), F.col("path").alias("transcript_path"), F.lit("spawn_agent").alias("tool_name"), F.col("call").alias("tool_use_id"), F.struct(F.col("agent").alias("agent_id")).alias("tool_response"), F.col("parent_agent").alias("agent_id"))
    opened = _event(a.withColumn("part", F.concat(by_depth, F.lit("\u0001"))), "SubagentStart", F.least("child_first", "start_ms"), F.lit(0), F.col("agent").alias("agent_id"), "agent_type", F.col("child_path").alias("transcript_path"))
    back = F.format_string("%010d %s", F.lit(1 << 30) - F.col("depth"), "agent")
    closed = _event(a.withColumn("part", back), "SubagentStop", F.greatest("child_last", "result_ms"), F.lit(1), F.col("agent").alias("agent_id"), F.col("child_path").alias("agent_transcript_path"), F.try_parse_json("child_said").alias("last_agent_message"))
    none = F.lit("").alias("part")
    path = F.col("path").alias("transcript_path")
    start = _event(roots.select("*", F.lit(0).cast("long").alias("turn"), none), "SessionStart", F.col("first_ms"), F.lit(0), path, F.lit("import").alias("source"))
    marks = rows.where("boundary and ts_ms is not null").select("path", "ts_ms").distinct().join(roots, "path").where("ts_ms > first_ms and ts_ms < last_ms")
    marks = _event(marks.select("*", F.lit(1).cast("long").alias("turn"), none), "ImportCheckpoint", F.col("ts_ms"), F.lit(0), path)
    stop = _event(roots.select("*", F.lit(LAST).alias("turn"), none), "Stop", F.col("last_ms"), F.lit(9), path, F.try_parse_json("said").alias("last_agent_message"))
    own = rows.join(roots.select("path", "session_id"), "path").select("session_id", F.lit("main").alias("scope"), "pos", "ts_ms", "rec")
    theirs = rows.join(a.select("session_id", F.col("child_path").alias("path"), F.concat(F.lit("subagent:"), "agent").alias("scope")), "path").select("session_id", "scope", "pos", "ts_ms", "rec")
    return _numbered([start, marks, told, opened, closed, stop], CODEX), own.unionByName(theirs)


def _files_of(below: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, up_depth): all files of a root, itself among them."""
    return below.select("root", F.col("node").alias("path"), F.col("depth").alias("up_depth")).unionByName(roots.select(F.col("path").alias("root"), "path", F.lit(0).alias("up_depth")))


def growing(events: DataFrame) -> DataFrame:
    """Imported events of transcripts that still grow: of Claude's newest turn only the prompt, which stays open, and no end; of Codex the start and the checkpoints. The last event stands in as a checkpoint.

    When a transcript is finished, all events are translated; spans keep their ids, so that what was told before is only completed.
    """
    newest = F.max(F.when(F.col("turn") < LAST, F.col("turn"))).over(Window.partitionBy("session_id"))
    ends = F.col("turn") == LAST
    early = (F.col("source") == CLAUDE) & ((F.col("turn") < F.col("newest")) | (F.col("event") == "UserPromptSubmit"))
    stays = ends | F.col("event").isin("SessionStart", "ImportCheckpoint") | early
    return events.withColumn("newest", newest).where(stays).withColumn("event", F.when(ends, F.lit("ImportCheckpoint")).otherwise(F.col("event"))).drop("newest")

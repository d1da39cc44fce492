"""Claude events and transcript records as span operations.

events: session_id, seq, event, ts_ms, payload. records: session_id, scope (`main` or `subagent:<id>`), pos, ts_ms, rec.

Hooks own the life of sessions, turns, subagents and tools; transcripts add model calls and the tools that no hook
reported. Streamed rows with one request id are one call. A record belongs to the turn of the real user record before it, so
rows that arrive after a stop stay with the turn they were written in. A call's input names the records before it
(scope and place) instead of holding them, as histories would grow with the square of a session.

A turn's or subagent's records are taken in segments, one a request. A tool that a hook began and none ended is closed with its owner, after the first segment has been taken:
if the transcript has the tool in that segment, what it says of it (name, input, output) stays under the closing error; in a later segment it is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import scalars as S
from ...functions.ids import span_id
from ...operators.tables import stored
from .debug import as_ops
from .git import enriched
from .pi import _text

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:variant,is_error:boolean>>"
MISSING = "{} ended before tool completion"


def _id(*parts: Column | str) -> Column:
    return span_id(F.col("session_id"), F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts)))


def prepared(events: DataFrame) -> DataFrame:
    """Events with agent, tool, call and the turn that is open."""
    p, kind = "payload", F.col("event")
    every = Window.partitionBy("session_id").orderBy("seq")
    now, past = every.rowsBetween(Window.unboundedPreceding, 0), every.rowsBetween(Window.unboundedPreceding, -1)
    ends = kind.isin("Stop", "StopFailure", "SessionEnd")
    e = events.withColumn("turn", F.sum((kind == "UserPromptSubmit").cast("int")).over(now))
    mark = F.when(kind == "UserPromptSubmit", F.col("turn")).when(ends, F.lit(-1))
    e = e.withColumn("mark", F.last(mark, ignorenulls=True).over(now)).withColumn("was", F.last(mark, ignorenulls=True).over(past))
    e = e.withColumn("open_turn", F.when(F.col("mark") > 0, F.col("mark"))).withColumn("closes", (ends | (kind == "UserPromptSubmit")) & F.coalesce(F.col("was") > 0, F.lit(False)))
    e = e.withColumn("cwd", F.last(S.text_or_number_at(p, "cwd"), ignorenulls=True).over(now))
    # Between places where pending skills are taken or dropped.
    clears = (kind == "UserPromptSubmit") | (kind.isin("Stop", "StopFailure") & F.col("closes"))
    e = e.withColumn("stretch", F.coalesce(F.sum(clears.cast("int")).over(past), F.lit(0)))
    e = e.withColumns({"agent": S.text_or_number_at(p, "agent_id"), "tool": S.text_or_number_at(p, "tool_name"), "args": F.coalesce(S.json_at(p, "tool_input"), F.lit("{}"))})
    acts = kind.isin("PreToolUse", "PostToolUse", "PostToolUseFailure", "PermissionDenied") & F.col("tool").isNotNull()
    given = S.text_or_number_at(p, "tool_use_id")
    e = e.withColumn("acts", acts).withColumn("nameless", F.sum((acts & given.isNull()).cast("int")).over(now))
    return e.withColumn("call", F.when(acts, F.coalesce(given, F.concat_ws(":", _text(F.coalesce("open_turn", F.lit(0))), _text(F.col("nameless"))))))


def _roots(e: DataFrame, records: DataFrame | None, hosts: DataFrame | None) -> DataFrame:
    p = "payload"
    plugin = "source_version" if "source_version" in e.columns else F.lit(None).cast("string")
    first = e.groupBy("session_id").agg(F.min_by(plugin, "seq").alias("plugin"), F.max_by("cwd", "seq").alias("cwd"), F.min("seq").alias("seq"), F.min_by("payload", "seq").alias("payload"), F.min_by("ts_ms", "seq").alias("start_ms"), F.min_by("ts_ms", F.when(F.col("event") == "SessionEnd", F.col("seq"))).alias("gone_ms"), F.min(F.when(F.col("event") == "SessionEnd", F.col("seq"))).alias("gone_seq"))
    cwd = F.coalesce(S.text_or_number_at(p, "cwd"), F.lit(""))
    facts = {}
    if hosts is not None:
        facts = {k: S.quoted(F.col(k)) for k in ("hostname", "username", "os")}
        first = first.join(hosts.select("session_id", *facts), "session_id", "left")
    meta = S.known_entries(session_id=S.quoted("session_id"), workspace=S.quoted(cwd), source=F.lit('"claude-code"'), **facts, trace_claude_code_version=S.quoted("plugin"), session_source=S.quoted(S.text_or_number_at(p, "source")), model=S.quoted(S.text_or_number_at(p, "model")))
    opened = first.select("session_id", (F.col("seq") * 10).alias("op_seq"), F.lit("insert").alias("op"), _id("root").alias("span_id"), F.array().cast("array<string>").alias("parent_span_ids"), F.concat(F.lit("Claude Code: "), S.workspace_name(cwd)).alias("name"), F.lit("task").alias("span_type"), "start_ms", S.quoted(F.concat(F.lit("Session: "), S.workspace_name(cwd))).alias("input"), meta.alias("metadata"), F.coalesce(S.text_or_number_at(p, "cwd"), F.lit("")).alias("cwd"))
    closed = first.where("gone_seq is not null").select("session_id", (F.col("gone_seq") * 10 + 9).alias("op_seq"), F.lit("merge").alias("op"), _id("root").alias("span_id"), F.col("gone_ms").alias("end_ms"))
    out = opened.unionByName(closed, allowMissingColumns=True)
    if records is None:
        return out
    # The version that the transcript names first.
    version = S.text_or_number_at("rec", "version")
    named = records.where("scope = 'main'").groupBy("session_id").agg(F.min_by(version, F.when(version.isNotNull(), F.col("pos"))).alias("version")).where("version is not null")
    told = first.join(named, "session_id").select("session_id", (F.col("seq") * 10 + 1).alias("op_seq"), F.lit("merge").alias("op"), _id("root").alias("span_id"), S.known_entries(claude_code_version=S.quoted("version")).alias("metadata"), "cwd")
    return out.unionByName(told, allowMissingColumns=True)


def skills(e: DataFrame, records: DataFrame | None) -> DataFrame:
    """(session_id, seq, stretch, was_open, names): prompt expansions that name a skill, with all names since what was pending was last taken or dropped, in order, each once.

    A name is given with the event, or is that of a command which a listing before the event has. Prompts take what is pending; a stop drops it.
    """
    p, kind = "payload", F.col("event")
    asked = F.coalesce(S.text_or_number_at(p, "expansion_type"), S.text_or_number_at(p, "type"), F.lit("slash_command")) == "slash_command"
    direct = F.coalesce(S.text_or_number_at(p, "skill_name"), S.text_or_number_at(p, "skillName"), S.text_at(p, "skill.name"), S.text_or_number_at(p, "skill"))
    command = F.coalesce(*(S.text_or_number_at(p, k) for k in ("command_name", "command", "slash_command", "name")))
    x = e.where((kind == "UserPromptExpansion") & asked).select("session_id", "seq", "ts_ms", "stretch", "open_turn", "cwd", S.clean_skill(direct).alias("direct"), S.clean_skill(command).alias("command"), S.text_or_number_at(p, "transcript_path").alias("path"))
    known = F.col("direct")
    if records is not None:
        listed = records.where("scope = 'main'").select("session_id", F.explode(F.from_json(S.json_at("rec", "attachment.names"), "array<string>")).alias("command"), F.coalesce("ts_ms", F.lit(-(1 << 60))).alias("listed"))
        listed = listed.groupBy("session_id", "command").agg(F.min("listed").alias("listed"))
        x = x.join(listed, ["session_id", "command"], "left")
        known = F.coalesce("direct", F.when(F.col("path").isNotNull() & (F.col("listed") <= F.col("ts_ms")), F.col("command")))
    x = x.withColumn("name", known).where("name <> ''")
    so_far = Window.partitionBy("session_id", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    named = x.select("session_id", "seq", "stretch", "open_turn", "cwd", F.array_distinct(F.collect_list("name").over(so_far)).alias("names"))
    prompts = e.where("event = 'UserPromptSubmit'").select("session_id", "stretch", F.col("seq").alias("prompt_seq"))
    return named.join(prompts, ["session_id", "stretch"], "left")


def _loaded(names: Column) -> Column:
    return S.known_entries(loaded_skill_names=F.when(F.size(names) > 0, F.to_json(names)), loaded_skills=F.when(F.size(names) > 0, F.to_json(F.transform(names, lambda x: F.struct(x.alias("name"))))))


def _turns(e: DataFrame, records: DataFrame | None) -> DataFrame:
    p, kind = "payload", F.col("event")
    named_skills = skills(e, records)
    pending = named_skills.where("prompt_seq is not null").groupBy("session_id", F.col("prompt_seq").alias("seq")).agg(F.max_by("names", "seq").alias("names"))
    opened = e.where("event = 'UserPromptSubmit'").join(pending, ["session_id", "seq"], "left").select("session_id", (F.col("seq") * 10 + 2).alias("op_seq"), F.lit("insert").alias("op"), _id("turn", _text(F.col("turn"))).alias("span_id"), F.array(_id("root")).alias("parent_span_ids"), F.concat(F.lit("Turn "), _text(F.col("turn"))).alias("name"), F.lit("task").alias("span_type"), F.col("ts_ms").alias("start_ms"), S.json_at(p, "prompt").alias("input"), F.when(F.size("names") > 0, _loaded(F.col("names"))).alias("metadata"), "cwd")
    said = F.when(kind.isin("Stop", "StopFailure"), F.coalesce(S.json_at(p, "last_assistant_message"), S.json_at(p, "output")))
    closed = e.where("closes").select("session_id", (F.col("seq") * 10 + 1).alias("op_seq"), F.lit("merge").alias("op"), _id("turn", _text(F.col("was"))).alias("span_id"), F.col("ts_ms").alias("end_ms"), said.alias("output"), F.when(kind == "StopFailure", F.coalesce(S.tool_error(p), F.lit("Claude Code turn failed"))).alias("error"))
    named = named_skills.where("open_turn is not null").select("session_id", (F.col("seq") * 10 + 3).alias("op_seq"), F.lit("merge").alias("op"), _id("turn", _text(F.col("open_turn"))).alias("span_id"), _loaded(F.col("names")).alias("metadata"), "cwd")
    return opened.unionByName(closed, allowMissingColumns=True).unionByName(named, allowMissingColumns=True)


def _agents(e: DataFrame) -> DataFrame:
    p = "payload"
    kind = F.coalesce(S.text_or_number_at(p, "agent_type"), F.lit("agent"))
    parent = F.when(F.col("turn") > 0, _id("turn", _text(F.coalesce("open_turn", "turn")))).otherwise(_id("root"))
    first = e.where("agent is not null").withColumn("_n", F.row_number().over(Window.partitionBy("session_id", "agent").orderBy("seq"))).where("_n = 1")
    opened = first.select("session_id", (F.col("seq") * 10 + 3).alias("op_seq"), F.lit("insert").alias("op"), _id("subagent", F.col("agent")).alias("span_id"), F.array(parent).alias("parent_span_ids"), F.concat(F.lit("subagent: "), kind).alias("name"), F.lit("task").alias("span_type"), F.col("ts_ms").alias("start_ms"), S.known_entries(agent_id=S.quoted("agent"), agent_type=S.quoted(kind)).alias("metadata"), "cwd")
    closed = e.where("event = 'SubagentStop' and agent is not null").select("session_id", (F.col("seq") * 10 + 5).alias("op_seq"), F.lit("merge").alias("op"), _id("subagent", F.col("agent")).alias("span_id"), F.col("ts_ms").alias("end_ms"), S.json_at(p, "last_assistant_message").alias("output"))
    return opened.unionByName(closed, allowMissingColumns=True)


def _tools(e: DataFrame) -> DataFrame:
    p, kind = "payload", F.col("event")
    e = e.withColumn("owner", F.coalesce(F.concat(F.lit("a"), F.col("agent")), F.concat(F.lit("t"), _text(F.col("open_turn")))))
    approval = F.when(kind == "PermissionDenied", "denied").otherwise("approved")
    error = F.coalesce(S.tool_error(p), F.when(kind == "PostToolUseFailure", F.coalesce(F.nullif(S.text_at(p, "tool_response.output"), F.lit("")), F.lit("Tool execution failed"))))
    asks = {f"permission_{k}": S.quoted(F.coalesce(S.text_or_number_at(p, f"permission_{k}"), S.text_at(p, f"permission.{k}"))) for k in ("id", "type", "title")}
    skill = F.when(F.col("tool") == "Skill", F.coalesce(*(S.text_or_number_at("args", k) for k in ("name", "skill", "skill_name", "skillName"))))
    is_skill = F.col("tool") == "Skill"
    meta = S.known_entries(tool_name=S.quoted("tool"), tool_approval=S.quoted(approval), tool_call_id=S.quoted("call"), **asks, tool_kind=F.when(is_skill, F.lit('"skill"')), skill_name=S.quoted(skill), skill_load_trigger=F.when(is_skill, F.lit('"explicit"')))
    acts = e.where("acts").withColumns({"meta": meta, "error": error, "label": S.tool_name(F.col("tool"), "args"), "gave": F.coalesce(S.json_at(p, "tool_response"), S.json_at(p, "output"), S.json_at(p, "error")), "took": F.coalesce(S.whole_at(p, "duration_ms"), F.lit(0))})
    first = Window.partitionBy("session_id", "call").orderBy("seq")
    pre = acts.where("event = 'PreToolUse' and owner is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("session_id", "call", F.col("seq").alias("s"), "owner", "label", "args", F.col("ts_ms").alias("start_ms"), "meta", "cwd")
    post = acts.where("event <> 'PreToolUse'").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("session_id", "call", F.col("seq").alias("x"), F.col("owner").alias("owner2"), F.col("label").alias("label2"), F.col("args").alias("args2"), F.col("ts_ms").alias("end_ms"), F.col("meta").alias("meta2"), "error", "gave", "took", F.col("cwd").alias("cwd2"))
    # An owner that ends takes its open tools with it.
    over = e.where("closes").select("session_id", F.concat(F.lit("t"), _text(F.col("was"))).alias("owner"), F.col("seq").alias("c"), F.col("ts_ms").alias("c_ms"), F.when(F.col("event") == "SessionEnd", F.lit(MISSING.format("Session"))).otherwise(MISSING.format("Turn")).alias("c_error"))
    over = over.unionByName(e.where("event = 'SubagentStop' and agent is not null").select("session_id", F.concat(F.lit("a"), F.col("agent")).alias("owner"), F.col("seq").alias("c"), F.col("ts_ms").alias("c_ms"), F.lit(MISSING.format("Subagent")).alias("c_error")))
    shut = pre.select("session_id", "call", "owner", "s").join(over, ["session_id", "owner"]).where("c > s").groupBy("session_id", "call").agg(F.min("c").alias("c"), F.min_by("c_ms", "c").alias("c_ms"), F.min_by("c_error", "c").alias("c_error"))
    both = pre.join(post, ["session_id", "call"], "full").join(shut, ["session_id", "call"], "left")
    both = both.withColumn("late", F.col("s").isNotNull() & (F.col("x").isNull() | (F.col("x") > F.coalesce("c", F.lit(1 << 60))))).withColumn("owner", F.coalesce("owner", "owner2")).where("owner is not null")
    own = F.when(F.startswith("owner", F.lit("a")), _id("subagent", F.substring("owner", 2, 1 << 20))).otherwise(_id("turn", F.substring("owner", 2, 1 << 20)))
    return both.select(
        "session_id", (F.coalesce("s", "x") * 10 + 4).alias("op_seq"), F.lit("insert").alias("op"), _id("tool", F.col("call")).alias("span_id"), F.array(own).alias("parent_span_ids"), F.coalesce("label", "label2").alias("name"), F.lit("tool").alias("span_type"),
        F.coalesce("start_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("took"))).alias("start_ms"), F.when(F.col("late"), F.col("c_ms")).otherwise(F.col("end_ms")).alias("end_ms"), F.coalesce("args", "args2").alias("input"), F.when(~F.col("late"), F.col("gave")).alias("output"),
        F.when(F.col("late"), F.col("c_error")).otherwise(F.col("error")).alias("error"), F.when(F.col("late") | F.col("meta2").isNull(), F.col("meta")).otherwise(F.col("meta2")).alias("metadata"), F.coalesce("cwd2", "cwd").alias("cwd"), F.when(F.col("late"), F.col("c")).alias("c"))


def parsed(records: DataFrame) -> DataFrame:
    """Records with type, blocks, request id and the turn they belong to."""
    r = "rec"
    content = S.json_at(r, "message.content")
    out = records.withColumns({"type": S.text_at(r, "type"), "blocks": F.when(F.startswith(content, F.lit("[")), F.from_json(content, BLOCKS)), "request_id": F.coalesce(S.text_or_number_at(r, "message.id"), S.text_or_number_at(r, "requestId"), S.text_or_number_at(r, "uuid"))})
    real = (F.col("type") == "user") & ~F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    order = Window.partitionBy("session_id", "scope").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("turn", F.greatest(F.lit(1), F.sum(real.cast("int")).over(order)))


def _parent() -> Column:
    return F.when(F.col("scope") == "main", _id("turn", _text(F.col("turn")))).otherwise(_id(F.col("scope")))


def calls(records: DataFrame) -> DataFrame:
    """One row for each model call of a transcript."""
    r = "rec"
    rows = parsed(records).where("type = 'assistant' and request_id is not null")
    wrong = S.true_at(r, "isApiErrorMessage")
    said = F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    used = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), F.lit("function").alias("type"), F.struct(b["name"].alias("name"), F.coalesce(b["input"], F.lit("null")).alias("arguments")).alias("function")))
    reason = F.when(wrong, F.coalesce(S.text_or_number_at(r, "error"), F.get(said, F.lit(0)), F.lit("Claude API error")))
    count = {"n_in": "input_tokens", "n_out": "output_tokens", "n_write": "cache_creation_input_tokens", "n_read": "cache_read_input_tokens", "n_5m": "cache_creation.ephemeral_5m_input_tokens", "n_1h": "cache_creation.ephemeral_1h_input_tokens"}
    rows = rows.withColumns({"said": said, "used": used, "reason": reason, "status": F.when(wrong, S.whole_at(r, "apiErrorStatus")), "model": S.text_or_number_at(r, "message.model"), **{k: F.coalesce(S.whole_at(r, f"message.usage.{v}"), F.lit(0)) for k, v in count.items()}})

    def listed(c: str) -> Column:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: F.coalesce(x[c], F.array()))
        return F.array_distinct(F.flatten(parts))

    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))

    return rows.groupBy("session_id", "scope", "request_id").agg(
        F.min("pos").alias("pos"), F.min_by("turn", "pos").alias("turn"), F.coalesce(F.min_by("ts_ms", "pos"), F.lit(0)).alias("start_ms"), newest("ts_ms").alias("last_ms"), F.coalesce(newest("model"), F.lit("claude")).alias("model"),
        listed("said").alias("texts"), listed("used").alias("tool_calls"), newest("reason").alias("error"), newest("status").alias("status"), *(F.max(k).alias(k) for k in count))


def _models(records: DataFrame) -> DataFrame:
    c = calls(records)
    usage = S.claude_usage(*(F.col(k) for k in ("n_in", "n_read", "n_5m", "n_1h", "n_write", "n_out")))
    split = (F.col("n_5m") > 0) | (F.col("n_1h") > 0)
    metrics = {k: v for k, v in usage.items() if k != "prompt_cache_creation_tokens"} | {"prompt_cache_creation_5m_tokens": F.when(split, F.col("n_5m")), "prompt_cache_creation_1h_tokens": F.when(split, F.col("n_1h")), "prompt_cache_creation_tokens": F.when(~split, F.col("n_write"))}
    answer = F.struct(F.lit("assistant").alias("role"), F.array_join("texts", "\n").alias("content"), F.when(F.size("tool_calls") > 0, F.col("tool_calls")).alias("tool_calls"))
    return c.select(
        "session_id", (F.lit(1 << 50) + F.col("pos") * 10).alias("op_seq"), F.lit("insert").alias("op"), _id(F.col("scope"), "llm", F.col("request_id")).alias("span_id"), F.array(_parent()).alias("parent_span_ids"), F.col("model").alias("name"), F.lit("llm").alias("span_type"),
        "start_ms", F.coalesce("last_ms", "start_ms").alias("end_ms"), F.to_json(F.struct("scope", F.col("pos").alias("records_before"))).alias("input"), F.to_json(answer).alias("output"), "error",
        S.known_entries(model=S.quoted("model"), request_id=S.quoted("request_id"), api_error_status=_text(F.col("status"))).alias("metadata"),
        F.map_filter(F.create_map(*(x for k, v in metrics.items() for x in (F.lit(k), v.cast("double")))), lambda k, v: v.isNotNull()).alias("metrics"), "scope", "turn")


def _recovered(e: DataFrame, records: DataFrame, tools: DataFrame) -> DataFrame:
    """Tools that the transcript has and no hook reported, or none ended before the first segment of their turn or subagent was taken. tools: those of the hooks."""
    every = parsed(records)
    segment = Window.partitionBy("session_id", "scope", F.when(F.col("scope") == "main", F.col("turn")))
    first = F.min_by("request_id", F.when((F.col("type") == "assistant") & F.col("request_id").isNotNull(), F.col("pos"))).over(segment)
    rows = every.withColumn("first", (F.col("request_id") == first)).select("session_id", "scope", "turn", "pos", "ts_ms", "type", "first", F.explode("blocks").alias("b"))
    used = rows.where("type = 'assistant' and b.type = 'tool_use' and b.id is not null").groupBy("session_id", F.col("b.id").alias("call")).agg(F.min("pos").alias("pos"), *(F.min_by(c, "pos").alias(c) for c in ("scope", "turn", "ts_ms", "first")), F.min_by("b", "pos").alias("b"))
    gave = rows.where("type = 'user' and b.type = 'tool_result'").groupBy("session_id", F.col("b.tool_use_id").alias("call")).agg(F.max_by("b", "pos").alias("r"), F.max_by("ts_ms", "pos").alias("end_ms"))
    seen = e.where("acts and (agent is not null or open_turn is not null)").select("session_id", "call").distinct().withColumn("seen", F.lit(True))
    # Closed by the end of their owner, which took the first segment just before; a prompt takes none of an open turn's.
    takes = e.where("event <> 'UserPromptSubmit'").select("session_id", F.col("seq").alias("c"))
    shut = tools.where("c is not null").select("session_id", F.get_json_object(F.col("metadata")["tool_call_id"], "$").alias("call"), "c", F.col("end_ms").alias("shut_ms"), F.col("error").alias("shut_error")).join(takes, ["session_id", "c"])
    t = used.join(gave, ["session_id", "call"], "left").join(seen, ["session_id", "call"], "left").join(shut, ["session_id", "call"], "left").where("seen is null or (c is not null and first)")
    name, args = F.coalesce("b.name", F.lit("Tool")), F.coalesce("b.input", F.lit("{}"))
    start = F.coalesce("ts_ms", F.lit(0))
    return t.select(
        "session_id", F.coalesce(F.col("c") * 10 + 6, F.lit(1 << 50) + F.col("pos") * 10 + 1).alias("op_seq"), F.lit("insert").alias("op"), _id("tool", F.col("call")).alias("span_id"), F.array(_parent()).alias("parent_span_ids"), S.tool_name(name, args).alias("name"), F.lit("tool").alias("span_type"),
        start.alias("start_ms"), F.coalesce("shut_ms", "end_ms", start).alias("end_ms"), args.alias("input"), F.to_json(F.col("r.content")).alias("output"), F.coalesce("shut_error", F.when(F.col("r.is_error"), F.lit("Tool execution failed"))).alias("error"),
        S.known_entries(tool_name=S.quoted(name), tool_approval=F.lit('"approved"'), tool_call_id=S.quoted("call"), recovered_from_transcript=F.lit("true")).alias("metadata"), "scope", "turn")


def _in_turns(ops: DataFrame, e: DataFrame) -> DataFrame:
    """ops of records (scope, turn) with the folder that was current when their turn, or their subagent, ended; else the session's last."""
    ended = e.where("closes").groupBy("session_id", F.lit("main").alias("scope"), F.col("was").cast("long").alias("turn")).agg(F.min_by("cwd", "seq").alias("cwd"))
    gone = e.where("event = 'SubagentStop' and agent is not null").groupBy("session_id", F.concat(F.lit("subagent:"), "agent").alias("scope")).agg(F.max_by("cwd", "seq").alias("agent_cwd"))
    final = e.groupBy("session_id").agg(F.max_by("cwd", "seq").alias("last_cwd"))
    out = ops.withColumn("turn", F.col("turn").cast("long")).join(ended, ["session_id", "scope", "turn"], "left").join(gone, ["session_id", "scope"], "left").join(final, "session_id", "left")
    return out.withColumn("cwd", F.coalesce("cwd", "agent_cwd", "last_cwd")).drop("scope", "turn", "agent_cwd", "last_cwd")


def claude_ops(events: DataFrame, records: DataFrame | None = None, git: DataFrame | None = None, hosts: DataFrame | None = None) -> DataFrame:
    """Span operations of Claude hooks, and of transcript records where given.

    git: (cwd, git map of JSON texts), what is known of folders. hosts: (session_id, hostname, username, os), where each session ran.
    """
    e = stored(prepared(events))
    tools = _tools(e)
    parts = [_roots(e, records, hosts), _turns(e, records), _agents(e)]
    if records is not None:
        tools = stored(tools)
        made = [_models(records), _recovered(e, records, tools)]
        parts += [_in_turns(p, e) if git is not None else p.drop("scope", "turn") for p in made]
    parts.append(tools.drop("c"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return as_ops(enriched(out, git).withColumn("root_span_id", _id("root")))

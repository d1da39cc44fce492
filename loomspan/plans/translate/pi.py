"""Pi events as span operations.

events: session_id, seq, event, ts_ms, payload (JSON), source_version. State is expressed as windows over a session:

- a segment ends where pending calls are forgotten (a prompt, the end of an agent or a shutdown);
- contexts queue up model calls and answers take the first one; answers that find the queue
  empty are counted by the running maximum of answers minus contexts, so the n-th
  successful answer takes the n-th context of its segment;
- providers and first tokens belong to the last context, if it still waits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import scalars as S
from ...functions.ids import span_id
from ...operators.tables import stored
from .debug import as_ops
from .git import in_folders

MODELS = ("responseModel", "routedModel", "resolvedModel", "actualModel", "concreteModel", "outputModel", "model")


def _text(c: Column) -> Column:
    return c.cast("string")


def prepared(events: DataFrame) -> DataFrame:
    """Events with their turn, segment, queue and root."""
    every = Window.partitionBy("session_id").orderBy("seq")
    now, past = every.rowsBetween(Window.unboundedPreceding, 0), every.rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("ev", F.coalesce(S.json_at("payload", "event"), F.col("payload")))
    prompt, shutdown = F.col("event") == "before_agent_start", F.col("event") == "session_shutdown"
    close = shutdown | ((F.col("event") == "agent_end") & ~S.true_at("ev", "willRetry"))
    message = F.coalesce(S.json_at("ev", "message"), F.col("ev"))
    e = e.withColumn("turn", F.sum(F.when(prompt, 1).otherwise(0)).over(now).cast("long")).withColumn("segment", F.sum(F.when(prompt | close, 1).otherwise(0)).over(now))
    e = e.withColumn("mark", F.last(F.when(prompt, F.col("turn")).when(close, F.lit(-1)), ignorenulls=True).over(now))
    e = e.withColumn("open_turn", F.when(F.col("mark") > 0, F.col("mark"))).withColumn("was_open", F.last(F.when(prompt, F.col("turn")).when(close, F.lit(-1)), ignorenulls=True).over(past))
    e = e.withColumn("life", F.coalesce(F.sum(F.when(shutdown, 1).otherwise(0)).over(past), F.lit(0)))
    level = F.when(F.col("event") == "thinking_level_select", F.struct(S.text_at("ev", "level").alias("level")))
    e = e.withColumn("level", F.last(level, ignorenulls=True).over(now)["level"]).withColumns({"close": close, "prompt": prompt, "shutdown": shutdown, "message": message})
    e = e.withColumn("answer", (F.col("event") == "message_end") & F.coalesce(S.text_at("message", "role") == "assistant", F.lit(False)) & F.col("open_turn").isNotNull())
    queue = Window.partitionBy("session_id", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("pushed", F.sum(F.when(F.col("event") == "context", 1).otherwise(0)).over(queue)).withColumn("asked", F.sum(F.when(F.col("answer"), 1).otherwise(0)).over(queue))
    e = e.withColumn("failed", F.greatest(F.lit(0), F.max(F.col("asked") - F.col("pushed")).over(queue)))
    e = e.withColumn("taken", F.col("asked") - F.col("failed"))
    in_turn = Window.partitionBy("session_id", "turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("llm", F.sum(F.when(F.col("answer"), 1).otherwise(0)).over(in_turn))


def _roots(e: DataFrame, root: Column) -> DataFrame:
    p = "payload"
    first = e.groupBy("session_id", "life").agg(F.min("seq").alias("seq"), F.min_by("ts_ms", "seq").alias("start_ms"), F.min_by("payload", "seq").alias("payload"), F.min_by("source_version", "seq").alias("version"))
    meta = S.known_entries(session_id=S.quoted("session_id"), source=F.lit('"pi"'), pi_version=S.quoted("version"), extension_version=S.json_at(p, "extension_version"), native_session_id=S.json_at(p, "native_session_id"), session_file=S.json_at(p, "session_file"))
    opened = first.select("session_id", (F.col("seq") * 10).alias("op_seq"), F.lit("insert").alias("op"), root.alias("span_id"), F.array().cast("array<string>").alias("parent_span_ids"), F.lit("Pi").alias("name"), F.lit("task").alias("span_type"), "start_ms", meta.alias("metadata"))
    tools = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = e.withColumn("tools", F.sum(F.when((F.col("event") == "tool_execution_end") & F.col("open_turn").isNotNull(), 1).otherwise(0)).over(tools))
    totals = F.create_map(F.lit("total_turns"), _text(F.col("turn")), F.lit("total_tool_calls"), _text(F.col("tools")))
    closed = counted.where("shutdown").select("session_id", (F.col("seq") * 10 + 9).alias("op_seq"), F.lit("merge").alias("op"), root.alias("span_id"), F.col("ts_ms").alias("end_ms"), totals.alias("metadata"))
    return opened.unionByName(closed, allowMissingColumns=True)


def _turn_id(turn: Column) -> Column:
    return span_id(F.col("session_id"), F.concat(F.lit("turn:"), _text(turn)))


def _turns(e: DataFrame, root: Column) -> DataFrame:
    prompt = S.text_at("ev", "prompt")
    skills = F.to_json(F.coalesce(S.prefixed_skills(prompt, "/skill:"), F.array().cast("array<string>")))
    opened = e.where("prompt").select("session_id", (F.col("seq") * 10 + 2).alias("op_seq"), F.lit("insert").alias("op"), _turn_id(F.col("turn")).alias("span_id"), F.array(root).alias("parent_span_ids"), F.concat(F.lit("Turn "), _text(F.col("turn"))).alias("name"), F.lit("task").alias("span_type"), F.col("ts_ms").alias("start_ms"), S.json_at("ev", "prompt").alias("input"), S.known_entries(turn_number=_text(F.col("turn")), loaded_skill_names=skills, thinking_level=S.quoted("level")).alias("metadata"))
    closed = e.where("(prompt or close) and was_open > 0").select("session_id", (F.col("seq") * 10 + 1).alias("op_seq"), F.lit("merge").alias("op"), _turn_id(F.col("was_open")).alias("span_id"), F.col("ts_ms").alias("end_ms"))
    return opened.unionByName(closed, allowMissingColumns=True)


def _answers(e: DataFrame) -> DataFrame:
    key = ["session_id", "segment", "context"]
    contexts = e.where("event = 'context'").select("session_id", "segment", F.col("pushed").alias("context"), F.col("ts_ms").alias("asked_ms"), F.coalesce(S.json_at("ev", "messages"), F.lit("[]")).alias("waited_for"))
    kind = F.coalesce(S.text_at("ev", "assistantMessageEvent.type"), F.when(S.json_at("ev", "assistantMessageEvent.type").isNull(), S.text_at("ev", "type")))
    first = (F.col("event") == "message_update") & kind.isin("text_delta", "thinking_delta", "text", "thinking")
    sides = e.where("event in ('before_provider_request', 'message_update') and pushed > taken").groupBy("session_id", "segment", F.col("pushed").alias("context")).agg(
        F.min(F.when(first, F.col("ts_ms"))).alias("first_ms"), F.max_by("ev", F.when(F.col("event") == "before_provider_request", F.col("seq"))).alias("request"))
    before = F.lag("failed", 1, 0).over(Window.partitionBy("session_id", "segment").orderBy("seq"))
    found = e.withColumn("missed", F.col("failed") > before).where("answer").withColumn("context", F.when(~F.col("missed"), F.col("taken")))
    a = found.join(contexts, key, "left").join(sides, key, "left")
    m = F.col("message")
    usage = S.pi_usage(*(S.whole_at(m, f"usage.{k}") for k in ("input", "cacheRead", "cacheWrite", "cacheWrite1h", "output", "reasoning", "totalTokens")))
    metrics = {k: v.cast("double") for k, v in usage.items()} | {"time_to_first_token": (F.col("first_ms") - F.col("asked_ms")) / 1000, "cost": S.number_at(m, "usage.cost")}
    model = F.coalesce(*(S.text_at(m, k) for k in MODELS))
    error = F.when(S.text_at(m, "stopReason").isin("error", "aborted"), S.text_at(m, "errorMessage"))
    return a.select(
        "session_id", (F.col("seq") * 10 + 3).alias("op_seq"), F.lit("insert").alias("op"), span_id(F.col("session_id"), F.concat_ws(":", F.lit("llm"), _text(F.col("turn")), _text(F.col("llm")))).alias("span_id"), F.array(_turn_id(F.col("open_turn"))).alias("parent_span_ids"),
        F.coalesce(model, F.lit("llm")).alias("name"), F.lit("llm").alias("span_type"), F.coalesce("asked_ms", "ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), F.coalesce("waited_for", F.lit("[]")).alias("input"), assistant(m).alias("output"),
        S.known_entries(model=S.quoted(model), provider=S.json_at(m, "provider"), api=S.json_at(m, "api"), stop_reason=S.json_at(m, "stopReason"), thinking_level=S.quoted("level"), provider_request=F.col("request"), response_id=S.json_at(m, "responseId")).alias("metadata"),
        F.map_filter(F.create_map(*(x for k, v in metrics.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull()).alias("metrics"), error.alias("error"))


def assistant(message: Column) -> Column:
    """A list with the answer: its texts joined, its thoughts, its tool calls with arguments as text."""
    parts = F.from_json(S.json_at(message, "content"), "array<struct<type:string,text:string,thinking:string,id:string,name:string,arguments:string>>")
    parts = F.coalesce(parts, F.from_json(F.lit("[]"), "array<struct<type:string,text:string,thinking:string,id:string,name:string,arguments:string>>"))

    def joined(kind: str, field: str) -> Column:
        return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == kind) & p[field].isNotNull()), lambda p: p[field]), "")

    calls = F.transform(F.filter(parts, lambda p: p["type"] == "toolCall"), lambda p: F.struct(p["id"].alias("id"), F.lit("function").alias("type"), F.struct(p["name"].alias("name"), F.coalesce(p["arguments"], F.lit("null")).alias("arguments")).alias("function")))
    thought = joined("thinking", "thinking")
    reasoning = F.when(thought != "", F.array(F.struct(F.lit("reasoning").alias("id"), thought.alias("content"))))
    return F.to_json(F.array(F.struct(F.lit("assistant").alias("role"), joined("text", "text").alias("content"), reasoning.alias("reasoning"), F.when(F.size(calls) > 0, calls).alias("tool_calls"))))


def _tools(e: DataFrame) -> DataFrame:
    t = e.where("event in ('tool_execution_start', 'tool_execution_end')").withColumn("call", S.text_at("ev", "toolCallId"))
    start = F.col("event") == "tool_execution_start"
    t = t.where(~start | F.col("call").isNotNull()).where(start | F.col("open_turn").isNotNull()).withColumn("call", F.coalesce("call", F.lit("")))
    w = Window.partitionBy("session_id", "segment", "call").orderBy("seq")
    name = F.coalesce(S.text_at("ev", "toolName"), F.lit("tool"))
    begun = F.when(start, F.struct(F.col("ts_ms").alias("ts"), name.alias("name"), F.coalesce(S.json_at("ev", "args"), F.lit("null")).alias("args")))
    t = t.withColumn("begun", F.lag(begun).over(w)).where(~start)
    tool, args = F.coalesce("begun.name", name), F.coalesce("begun.args", F.lit("null"))
    path = F.coalesce(*(S.text_at(args, k) for k in ("path", "filePath", "file_path")))
    skill = F.when((tool == "read") & F.endswith(F.lower(path), F.lit("/skill.md")), F.element_at(F.split(path, "/"), -2))
    failed = S.true_at("ev", "isError")
    result = S.json_at("ev", "result")
    whole = F.when(F.startswith(result, F.lit('"')), S.first_line(S.text_at("ev", "result")))
    reason = F.coalesce(whole, S.text_at("ev", "result.error"), S.text_at("ev", "result.message"), F.lit("Tool execution failed"))
    return t.select(
        "session_id", (F.col("seq") * 10 + 4).alias("op_seq"), F.lit("insert").alias("op"), span_id(F.col("session_id"), F.concat_ws(":", F.lit("tool"), _text(F.col("turn")), F.col("call"))).alias("span_id"), F.array(_turn_id(F.col("open_turn"))).alias("parent_span_ids"),
        F.coalesce(F.concat(F.lit("skill: "), skill), tool).alias("name"), F.lit("tool").alias("span_type"), F.coalesce("begun.ts", "ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), args.alias("input"), result.alias("output"),
        S.known_entries(tool_name=S.quoted(F.when(skill.isNotNull(), F.lit("skill")).otherwise(tool)), original_tool_name=S.quoted(tool), tool_call_id=S.quoted("call"), tool_approval=F.lit('"approved"'), tool_outcome=F.when(failed, F.lit('"error"')).otherwise('"success"'), skill_name=S.quoted(skill)).alias("metadata"),
        F.when(failed, reason).alias("error"))


def _special(e: DataFrame, root: Column, begin: str, end: str, name: str, tag: str, needs: Column, fires: Column) -> DataFrame:
    s = e.where((F.col("event") == end) | F.col("shutdown") | ((F.col("event") == begin) & needs))
    w = Window.partitionBy("session_id").orderBy("seq")
    begun = F.when(F.col("event") == begin, F.struct(F.col("ts_ms").alias("ts"), F.col("ev").alias("ev")))
    s = s.withColumn("begun", F.lag(begun).over(w)).where(F.col("event") == end).where(fires | F.col("begun").isNotNull())
    key = F.coalesce(F.concat(F.lit(f"{tag}:"), _text(F.col("begun.ts"))), F.concat(F.lit(f"special:{name}:"), _text(F.col("ts_ms"))))
    return s.select(
        "session_id", (F.col("seq") * 10 + 5).alias("op_seq"), F.lit("insert").alias("op"), span_id(F.col("session_id"), key).alias("span_id"), F.array(root).alias("parent_span_ids"), F.lit(name).alias("name"), F.lit("task").alias("span_type"),
        F.coalesce("begun.ts", "ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), F.coalesce("begun.ev", F.lit("null")).alias("input"), F.col("ev").alias("output"), F.create_map(F.lit("event_type"), S.quoted(F.lit(end))).alias("metadata"), F.array(F.lit(tag)).alias("tags"))


def pi_ops(events: DataFrame, finalize: bool = False, git: DataFrame | None = None) -> DataFrame:
    """Span operations of Pi events; finalize closes what is still open at the last event, in no folder. git: (cwd, git map of JSON texts)."""
    root = span_id(F.col("session_id"), F.lit("root"))
    e = stored(prepared(events))
    parts = [
        _roots(e, root), _turns(e, root), _answers(e), _tools(e),
        _special(e, root, "session_before_compact", "session_compact", "Compaction", "compaction", F.lit(True), F.lit(True)),
        _special(e, root, "session_before_tree", "session_tree", "Branch Summary", "branch-summary", S.true_at("ev", "preparation.userWantsSummary"), S.json_at("ev", "summaryEntry").isNotNull()),
    ]
    parts = [in_folders(p, events, S.text_at("payload", "cwd"), git) for p in parts]
    if finalize:
        tools = F.count_if((F.col("event") == "tool_execution_end") & F.col("open_turn").isNotNull())
        last = e.groupBy("session_id").agg(F.max("ts_ms").alias("end_ms"), F.max("seq").alias("seq"), F.max("turn").alias("turn"), tools.alias("tools"), F.max_by("mark", "seq").alias("mark"), F.max_by("shutdown", "seq").alias("shutdown"))
        parts.append(last.where("mark > 0").select("session_id", (F.col("seq") * 10 + 10).alias("op_seq"), F.lit("merge").alias("op"), _turn_id(F.col("mark")).alias("span_id"), "end_ms", F.lit("Interrupted before completion").alias("error")))
        parts.append(last.where("not shutdown").select("session_id", (F.col("seq") * 10 + 11).alias("op_seq"), F.lit("merge").alias("op"), root.alias("span_id"), "end_ms", F.create_map(F.lit("total_turns"), _text(F.col("turn")), F.lit("total_tool_calls"), _text(F.col("tools"))).alias("metadata")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return as_ops(out.withColumn("root_span_id", root))

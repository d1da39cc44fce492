"""OpenCode events as span operations.

events: session_id (of the daemon), seq, event, ts_ms, payload. State is kept by native session: a *life* runs from
the event that opens a native session to the one that removes it, and numbers its turns anew. A child session (one
whose first creation names a parent) is removed when idle, others when deleted or failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import scalars as S
from ...functions.ids import span_id
from ...operators.tables import stored
from .debug import as_ops
from .git import in_folders
from .pi import _text

KEY = ["session_id", "sid", "life"]


def failure(doc: Column) -> Column:
    """An error value as text: its first line, or its message and name."""
    whole = F.when(F.startswith(doc, F.lit('"')), S.first_line(F.try_variant_get(F.try_parse_json(doc), "$", "string")))
    name = F.coalesce(S.text_at(doc, "name"), F.lit("UnknownError"))
    message = F.coalesce(S.text_at(doc, "data.message"), S.text_at(doc, "message"), name)
    return F.coalesce(whole, F.when(doc.isNotNull(), F.concat(message, F.lit("\n\ntype: "), name)), F.lit("UnknownError"))


def _native(doc: Column) -> Column:
    return F.coalesce(*(S.text_at(doc, p) for p in ("input.sessionID", "sessionID", "properties.sessionID", "properties.info.id", "part.sessionID")))


def _id(kind: str, *parts: Column) -> Column:
    return span_id(F.col("session_id"), F.concat_ws(":", F.lit(kind), *parts))


def prepared(events: DataFrame) -> DataFrame:
    """Events with native session, life, open turn and, where they have them, message part, message and call."""
    p = "payload"
    kind = F.col("event")
    e = events.withColumns({"part": F.coalesce(S.json_at(p, "properties.part"), S.json_at(p, "part")), "info": F.coalesce(S.json_at(p, "properties.info"), S.json_at(p, "info")), "props": F.coalesce(S.json_at(p, "properties"), p)})
    created = kind == "session.created"
    sid = (
        F.when(created, F.coalesce(S.text_at("info", "id"), _native(p)))
        .when(kind == "message.part.updated", S.text_at("part", "sessionID"))
        .when(kind == "message.updated", S.text_at("info", "sessionID"))
        .when(kind.startswith("permission."), _native(F.col("props")))
        .otherwise(_native(p))
    )
    e = e.withColumn("sid", sid).where("sid is not null")
    whole = Window.partitionBy("session_id", "sid")
    now = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    past = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("parent_sid", F.min_by(S.text_at("info", "parentID"), F.when(created, F.col("seq"))).over(whole))
    e = e.withColumn("removes", kind.isin("session.deleted", "session.error") | ((kind == "session.idle") & F.col("parent_sid").isNotNull()))
    e = e.withColumn("life", F.coalesce(F.sum(F.col("removes").cast("int")).over(past), F.lit(0)))
    life = Window.partitionBy(*KEY)
    opens = created | (kind == "chat.message")
    e = e.withColumn("opened_at", F.min(F.when(opens, F.col("seq"))).over(life)).where("opened_at <= seq")
    e = e.withColumn("opens", F.col("opened_at") == F.col("seq"))
    chat = kind == "chat.message"
    now = life.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    past = life.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("turn", F.sum(chat.cast("int")).over(now))
    mark = F.when(chat, F.col("turn")).when(F.col("removes") | (kind == "session.idle"), F.lit(-1))
    e = e.withColumn("mark", F.last(mark, ignorenulls=True).over(now)).withColumn("was", F.last(mark, ignorenulls=True).over(past))
    e = e.withColumn("open_turn", F.when(F.col("mark") > 0, F.col("mark")))
    takes = (chat | F.col("removes") | (kind == "session.idle")) & F.coalesce(F.col("was") > 0, F.lit(False))
    e = e.withColumn("takes", takes).withColumn("taken", F.coalesce(F.sum(takes.cast("int")).over(past), F.lit(0)))
    finished = F.when((kind == "message.part.updated") & (S.text_at("part", "type") == "text") & S.json_at("part", "time.end").isNotNull(), S.text_at("part", "text"))
    e = e.withColumn("finished", F.last(finished, ignorenulls=True).over(Window.partitionBy(*KEY, "taken").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.from_json(S.json_at(F.coalesce(S.json_at(p, "output"), p), "parts"), "array<struct<type:string,text:string>>")
    asked = F.when(chat, F.coalesce(F.array_join(F.transform(F.filter(texts, lambda x: (x["type"] == "text") & x["text"].isNotNull()), lambda x: x["text"]), "\n"), F.lit("")))
    system = F.when(kind == "experimental.chat.system.transform", F.struct(F.array_join(F.from_json(S.json_at(p, "output.system"), "array<string>"), "\n\n").alias("text")))
    return e.withColumn("asked", F.last(asked, ignorenulls=True).over(now)).withColumn("system", F.last(system, ignorenulls=True).over(now)["text"])


def _roots(e: DataFrame) -> DataFrame:
    """(session_id, sid, life) with the span that opens it, its parents and the root of its tree."""
    lives = e.where("opens").select(*KEY, F.col("seq").alias("at"), "ts_ms", F.when(F.col("event") == "session.created", F.col("parent_sid")).alias("parent_sid"), F.coalesce(S.text_at("info", "title"), F.lit("Subagent")).alias("title"))
    # What each child's parent had open when the child was created.
    states = e.select("session_id", "sid", F.col("seq").alias("at"), F.struct(F.when(~F.col("removes"), F.col("life")).alias("life"), "open_turn").alias("state"), F.lit(None).cast("string").alias("child"))
    asks = lives.where("parent_sid is not null").select("session_id", F.col("parent_sid").alias("sid"), "at", F.lit(None).cast(states.schema["state"].dataType).alias("state"), F.col("sid").alias("child"))
    w = Window.partitionBy("session_id", "sid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    known = states.unionByName(asks).withColumn("state", F.last("state", ignorenulls=True).over(w)).where("child is not null").select("session_id", F.col("child").alias("sid"), "at", F.col("sid").alias("p_sid"), F.col("state.life").alias("p_life"), F.col("state.open_turn").alias("p_turn"))
    lives = lives.join(known, ["session_id", "sid", "at"], "left")
    found = F.col("p_life").isNotNull()
    return lives.select(
        *KEY, "at", "ts_ms", "parent_sid", _id("session", F.col("sid")).alias("span_id"), F.when(found, F.col("p_sid")).alias("p_sid"), "p_life",
        F.when(found & F.col("p_turn").isNotNull(), F.array(_id("turn", F.col("p_sid"), _text(F.col("p_turn"))))).otherwise(F.array().cast("array<string>")).alias("parent_span_ids"),
        F.when(F.col("parent_sid").isNull(), F.lit("OpenCode")).when(found, S.subagent_name(F.col("title"))).otherwise("Subagent").alias("name"))


def _tops(roots: DataFrame) -> DataFrame:
    """(session_id, sid, life, root_span_id): the top of the chain of parents above each life of a native session.

    Each round doubles how far a life looks up. A parent's life began before its child's, so that no chain is a circle.
    """
    tops = roots.select(*KEY, F.coalesce("p_sid", "sid").alias("t_sid"), F.coalesce("p_life", "life").alias("t_life"), F.col("p_life").isNotNull().alias("moved"))
    while True:
        tops = stored(tops)
        if not tops.where("moved").take(1):
            return tops.select(*KEY, _id("session", F.col("t_sid")).alias("root_span_id"))
        up = tops.select("session_id", F.col("sid").alias("t_sid"), F.col("life").alias("t_life"), F.col("t_sid").alias("u_sid"), F.col("t_life").alias("u_life"))
        more = tops.join(up, ["session_id", "t_sid", "t_life"])
        tops = more.select(*KEY, F.col("u_sid").alias("t_sid"), F.col("u_life").alias("t_life"), ((F.col("u_sid") != F.col("t_sid")) | (F.col("u_life") != F.col("t_life"))).alias("moved"))


def opencode_ops(events: DataFrame, finalize: bool = False, git: DataFrame | None = None) -> DataFrame:
    """Span operations of OpenCode events; finalize closes what is still open at the last event, in no folder. git: (cwd, git map of JSON texts)."""
    e = stored(prepared(events))
    roots = stored(_roots(e))
    parts = [in_folders(p, events, F.coalesce(S.text_at("payload", "directory"), S.text_at("payload", "worktree")), git) for p in (_opened(roots), _turns(e), _messages(e), _calls(e), _closed(e))]
    if finalize:
        parts += _finals(e)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return as_ops(out.join(_tops(roots), KEY))


def _opened(roots: DataFrame) -> DataFrame:
    child = F.col("parent_sid").isNotNull()
    meta = S.known_entries(session_id=S.quoted("sid"), source=F.lit('"opencode"'), parent_session_id=F.when(child, S.quoted("parent_sid")), is_subagent=F.when(child, F.lit("true")))
    return roots.select(*KEY, (F.col("at") * 10).alias("op_seq"), F.lit("insert").alias("op"), "span_id", "parent_span_ids", "name", F.lit("task").alias("span_type"), F.col("ts_ms").alias("start_ms"), meta.alias("metadata"))


def _turns(e: DataFrame) -> DataFrame:
    p = "payload"
    skills = F.to_json(F.coalesce(S.prefixed_skills(F.col("asked"), "/skills:", "/skills"), F.array().cast("array<string>")))
    model = F.coalesce(S.json_at(p, "input.model.modelID"), S.json_at(p, "model.modelID"))
    opened = e.where("event = 'chat.message'").select(*KEY, (F.col("seq") * 10 + 2).alias("op_seq"), F.lit("insert").alias("op"), _id("turn", F.col("sid"), _text(F.col("turn"))).alias("span_id"), F.array(_id("session", F.col("sid"))).alias("parent_span_ids"), F.concat(F.lit("Turn "), _text(F.col("turn"))).alias("name"), F.lit("task").alias("span_type"), F.col("ts_ms").alias("start_ms"), F.when(F.col("asked") != "", S.quoted("asked")).alias("input"), S.known_entries(turn_number=_text(F.col("turn")), model=model, loaded_skill_names=skills).alias("metadata"))
    error = F.when(F.col("event") == "session.error", failure(F.coalesce(S.json_at(p, "properties.error"), S.json_at(p, "error"))))
    closed = e.where("takes").select(*KEY, (F.col("seq") * 10 + 1).alias("op_seq"), F.lit("merge").alias("op"), _id("turn", F.col("sid"), _text(F.col("was"))).alias("span_id"), F.col("ts_ms").alias("end_ms"), S.quoted("finished").alias("output"), error.alias("error"))
    return opened.unionByName(closed, allowMissingColumns=True)


def _messages(e: DataFrame) -> DataFrame:
    i = "info"
    done = e.where("event = 'message.updated'").where((S.text_at(i, "role") == "assistant") & S.json_at(i, "time.completed").isNotNull()).withColumn("mid", S.text_at(i, "id")).where("mid is not null")
    first = Window.partitionBy(*KEY, "turn", "mid").orderBy("seq")
    done = done.withColumn("_n", F.row_number().over(first)).where("_n = 1 and open_turn is not null")
    part = "part"
    kind = S.text_at(part, "type")
    seen = e.where("event = 'message.part.updated'").select(*KEY, "turn", F.coalesce(S.text_at(part, "messageID"), F.lit("")).alias("mid"), F.col("seq").alias("p_seq"), kind.alias("kind"), S.text_at(part, "text").alias("text"), F.coalesce(S.text_at(part, "callID"), F.lit("")).alias("call"), F.coalesce(S.text_at(part, "tool"), F.lit("tool")).alias("tool"), S.json_at(part, "state.input").alias("args"))
    near = done.select(*KEY, "turn", "mid", F.col("seq").alias("at")).join(seen, [*KEY, "turn", "mid"]).where("p_seq < at")
    texts = near.groupBy(*KEY, "turn", "mid").agg(F.max_by("text", F.when((F.col("kind") == "text") & F.col("text").isNotNull(), F.col("p_seq"))).alias("said"), F.max_by("text", F.when((F.col("kind") == "reasoning") & F.col("text").isNotNull(), F.col("p_seq"))).alias("thought"))
    tools = near.where("kind = 'tool' and args is not null").groupBy(*KEY, "turn", "mid", "call").agg(F.min("p_seq").alias("o"), F.max_by("tool", "p_seq").alias("tool"), F.max_by("args", "p_seq").alias("args"))
    call = F.struct("o", F.struct(F.col("call").alias("id"), F.lit("function").alias("type"), F.struct(F.col("tool").alias("name"), F.col("args").alias("arguments")).alias("function")).alias("c"))
    tools = tools.groupBy(*KEY, "turn", "mid").agg(F.array_sort(F.collect_list(call))["c"].alias("tool_calls"))
    m = done.join(texts, [*KEY, "turn", "mid"], "left").join(tools, [*KEY, "turn", "mid"], "left")
    usage = S.opencode_usage(*(S.whole_at(i, f"tokens.{k}") for k in ("input", "cache.read", "cache.write", "output", "reasoning")))
    provider, model = F.coalesce(S.text_at(i, "providerID"), F.lit("unknown")), F.coalesce(S.text_at(i, "modelID"), F.lit("unknown"))
    said = F.struct(F.lit("assistant").alias("role"), F.coalesce("said", F.lit("")).alias("content"), F.col("tool_calls"), F.when(F.col("thought").isNotNull(), F.array(F.struct(F.lit("reasoning").alias("id"), F.col("thought").alias("content")))).alias("reasoning"))
    asked = F.filter(F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in (("system", "system"), ("user", "asked")))), lambda x: x["content"].isNotNull())
    error = S.json_at(i, "error")
    return m.select(
        *KEY, (F.col("seq") * 10 + 3).alias("op_seq"), F.lit("insert").alias("op"), _id("llm", F.col("sid"), F.col("mid")).alias("span_id"), F.array(_id("turn", F.col("sid"), _text(F.col("open_turn")))).alias("parent_span_ids"), F.concat_ws("/", provider, model).alias("name"), F.lit("llm").alias("span_type"),
        F.coalesce(S.whole_at(i, "time.created"), "ts_ms").alias("start_ms"), F.coalesce(S.whole_at(i, "time.completed"), "ts_ms").alias("end_ms"), F.to_json(asked).alias("input"), F.to_json(F.array(said)).alias("output"),
        S.known_entries(model=S.quoted(model), provider=S.quoted(provider), message_id=S.quoted("mid")).alias("metadata"), F.create_map(*(x for k, v in usage.items() for x in (F.lit(k), v.cast("double")))).alias("metrics"), F.when(error.isNotNull(), failure(error)).alias("error"))


def _calls(e: DataFrame) -> DataFrame:
    p, q, part = "payload", "props", "part"
    kind = F.col("event")
    reply = F.coalesce(S.text_at(q, "response"), S.text_at(q, "status"))
    denies = kind.isin("permission.asked", "permission.replied") & F.coalesce(reply.isin("reject", "denied", "deny"), F.lit(False)) & F.col("open_turn").isNotNull()
    named = F.coalesce(S.text_at(p, "input.callID"), S.text_at(p, "callID"))
    step = F.when(kind == "tool.execute.before", "before").when(kind == "tool.execute.after", "after").when(denies, "deny").when((kind == "message.part.updated") & (S.text_at(part, "type") == "tool"), "part")
    call = F.when(kind == "tool.execute.before", named).when(kind == "tool.execute.after", F.coalesce(named, F.lit(""))).when(denies, F.coalesce(S.text_at(q, "callID"), S.text_at(q, "id"), F.lit(""))).otherwise(F.coalesce(S.text_at(part, "callID"), F.lit("")))
    c = e.withColumn("step", step).withColumn("call", call).where("step is not null and call is not null")
    w = Window.partitionBy(*KEY, "call").orderBy("seq")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    verdict = F.last(F.when(F.col("step").isin("deny", "after"), F.col("step")), ignorenulls=True).over(past)
    c = c.withColumn("dropped", (F.col("step") == "after") & F.coalesce(verdict == "deny", F.lit(False)))
    c = c.withColumn("ends", ((F.col("step") == "after") & ~F.col("dropped") & F.col("open_turn").isNotNull()) | (F.col("step") == "deny"))
    c = c.withColumn("round", F.coalesce(F.sum(F.col("ends").cast("int")).over(past), F.lit(0)))
    r = Window.partitionBy(*KEY, "call", "round").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    state = S.text_at(part, "state.status")
    is_part = F.col("step") == "part"
    c = c.withColumns({
        "begun": F.last(F.when(F.col("step") == "before", F.col("ts_ms")), ignorenulls=True).over(r),
        "args": F.last(F.when(F.col("step") == "before", S.json_at(p, "output.args")), ignorenulls=True).over(r),
        "gave": F.last(F.when(is_part & (state == "completed"), S.json_at(part, "state.output")), ignorenulls=True).over(r),
        "broke": F.last(F.when(is_part & (state == "error"), failure(S.json_at(part, "state.error"))), ignorenulls=True).over(r),
    }).where("ends")
    denied = F.col("step") == "deny"
    tool = F.coalesce(F.when(denied, S.text_at(q, "tool")).otherwise(F.coalesce(S.text_at(p, "input.tool"), S.text_at(p, "tool"))), F.lit("tool"))
    skill = F.when((tool == "skill") & ~denied, S.text_at("args", "name"))
    name = F.when(denied, tool).when(tool == "skill", F.coalesce(F.concat(F.lit("skill: "), skill), F.lit("skill"))).otherwise(F.coalesce(S.text_at(p, "result.title"), tool))
    outcome = F.when(denied, F.lit('"denied"')).when(F.col("broke").isNotNull(), F.lit('"error"')).otherwise('"success"')
    meta = S.known_entries(tool_name=S.quoted(tool), call_id=S.quoted("call"), tool_outcome=outcome, tool_approval=F.when(denied, F.lit('"denied"')), tool_kind=F.when((tool == "skill") & ~denied, F.lit('"skill"')), skill_name=S.quoted(skill))
    return c.select(
        *KEY, (F.col("seq") * 10 + 4).alias("op_seq"), F.lit("insert").alias("op"), _id("tool", F.col("sid"), F.col("call")).alias("span_id"), F.array(_id("turn", F.col("sid"), _text(F.col("open_turn")))).alias("parent_span_ids"), name.alias("name"), F.lit("tool").alias("span_type"),
        F.coalesce("begun", "ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), F.col("args").alias("input"), F.when(~denied, F.coalesce("gave", S.json_at(p, "result.output"), S.json_at(p, "output"))).alias("output"), F.when(denied, F.lit("Permission denied")).otherwise(F.col("broke")).alias("error"), meta.alias("metadata"))


def _closed(e: DataFrame) -> DataFrame:
    p = "payload"
    ended = F.sum(F.when((F.col("event") == "tool.execute.after") & F.col("open_turn").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    error = F.when(F.col("event") == "session.error", failure(F.coalesce(S.json_at(p, "properties.error"), S.json_at(p, "error"))))
    return e.withColumn("tools", ended).where("removes").select(*KEY, (F.col("seq") * 10 + 5).alias("op_seq"), F.lit("merge").alias("op"), _id("session", F.col("sid")).alias("span_id"), F.col("ts_ms").alias("end_ms"), F.create_map(F.lit("total_turns"), _text(F.col("turn")), F.lit("total_tool_calls"), _text(F.col("tools"))).alias("metadata"), error.alias("error"))


def _finals(e: DataFrame) -> list[DataFrame]:
    last = e.groupBy("session_id").agg(F.max("ts_ms").alias("now"))
    tools = F.count_if((F.col("event") == "tool.execute.after") & F.col("open_turn").isNotNull())
    open_ = e.groupBy(*KEY).agg(F.max("seq").alias("seq"), F.max("turn").alias("turn"), F.max_by("mark", "seq").alias("mark"), F.max("removes").alias("gone"), F.max_by("finished", "seq").alias("finished"), F.max_by("takes", "seq").alias("took"), tools.alias("tools")).where("not gone").join(last, "session_id")
    turns = open_.where("mark > 0").select(*KEY, (F.col("seq") * 10 + 8).alias("op_seq"), F.lit("merge").alias("op"), _id("turn", F.col("sid"), _text(F.col("mark"))).alias("span_id"), F.col("now").alias("end_ms"), F.when(~F.col("took"), S.quoted("finished")).alias("output"))
    roots = open_.select(*KEY, (F.col("seq") * 10 + 9).alias("op_seq"), F.lit("merge").alias("op"), _id("session", F.col("sid")).alias("span_id"), F.col("now").alias("end_ms"), F.create_map(F.lit("total_turns"), _text(F.col("turn")), F.lit("total_tool_calls"), _text(F.col("tools"))).alias("metadata"))
    return [turns, roots]

"""Codex hooks and rollouts as span operations.

events: session_id, seq, event, ts_ms, payload. records: session_id, scope (`main` or `subagent:<id>`), pos, ts_ms (null where a record has none), rec.

A scope is one ordered stream: records by place and, after all that are no later, the hooks that end something in it. State is expressed as windows over it:

- starts and ends of turns are few; one pass over them alone, in their order, says which turn each opens or ends and which is the latest open one after it, and that is carried forward to the records between;
- a model call runs from the first output after the one before it was cut off (by a token count, by a compaction or with its turn) to the next cut;
- a call starts where the latest child of its turn ended, a running maximum, or with its turn;
- a tool call is joined with the first output of its id, or ends with its turn;
- a compaction begins a new epoch of the history: calls then see its replacement and what follows.

A call's input names its scope, epoch and the items of the history before it. codex_inputs gives these inputs in bounded pieces of items that are stored once;
histories=True writes them into the spans, which grows with the square of an epoch. One turn of a session is one task's window, as order demands.

Defined cases: a turn id that is started again while it is open counts once; a turn end without id ends the latest open turn, one with an id that isn't open ends none;
records before the first turn belong to none; malformed records are skipped; a scope of a subagent that no hook announced is skipped; no events give no operations but those of records.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import scalars as S
from ...functions.ids import span_id
from ...operators.histories import PIECE, numbered, pieces
from ...operators.tables import stored
from .debug import as_ops
from .git import enriched
from .pi import _text

#: Records of a tool call and of its output (fixed values).
CALLS = ("function_call", "custom_tool_call", "tool_search_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output", "tool_search_output")
SPAWN = "spawn_agent"
MISSING = "Tool output missing before turn ended"
#: Why a call has no usage (fixed values).
NO_USAGE, ODD_USAGE, NO_COUNT = "codex_token_count_missing_usage", "codex_token_count_unrecognized_usage", "codex_transcript_missing_token_count"
#: Where paths stand in arguments, and which of them lead to a skill (fixed values).
PLACES = ("path", "file_path", "filePath", "file", "command", "cmd", "resource")
SKILL_DOC = r"""(?i)([^\s"']*SKILL\.md)"""
SKILL_SCRIPT = r"""(?i)([^\s"']*[\\/]scripts[\\/][^\s"']+)"""
#: What stands for a summary that a compaction doesn't give (fixed values).
NO_HISTORY, SEALED, NO_SUMMARY = "[unavailable]", "[summary unavailable — encrypted by Codex]", "[no summary]"

SCOPE = ["session_id", "scope"]
TURN = [*SCOPE, "tid"]


def _id(*parts: Column | str) -> Column:
    return span_id(F.col("session_id"), F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts)))


def _order(*keys: str):
    return Window.partitionBy(*keys).orderBy("ord")


def _past(*keys: str):
    return _order(*keys).rowsBetween(Window.unboundedPreceding, -1)


def _now(*keys: str):
    return _order(*keys).rowsBetween(Window.unboundedPreceding, 0)


def _joined(texts: Column) -> Column:
    """A JSON list of JSON texts."""
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def stream(events: DataFrame, records: DataFrame) -> DataFrame:
    """Records and the hooks that end turns or scopes, in one order (ord) of each scope, with what they say."""
    r, e = "rec", "payload"
    p = S.json_at(r, "payload")
    high = F.max("ts_ms").over(Window.partitionBy(*SCOPE).orderBy("pos"))
    rows = records.withColumns({"at": F.coalesce(high, F.lit(-1)), "hook": F.lit(0), "kind": S.text_at(r, "type"), "p": p})
    rows = rows.select(*SCOPE, "at", "hook", "pos", "ts_ms", "kind", F.when(F.col("kind").isin("event_msg", "response_item"), S.text_at("p", "type")).alias("sub"), "p").where("kind is not null")
    agent = S.text_at(e, "agent_id")
    ends = (F.col("event").isin("Stop", "PostCompact") & agent.isNull()) | ((F.col("event") == "SubagentStop") & agent.isNotNull())
    hooks = events.where(ends).select("session_id", F.coalesce(F.concat(F.lit("subagent:"), agent), F.lit("main")).alias("scope"), F.col("ts_ms").alias("at"), F.lit(1).alias("hook"), F.col("seq").alias("pos"), "ts_ms", F.lit("hook").alias("kind"), F.col("event").alias("sub"), F.col("payload").alias("p"))
    both = rows.unionByName(hooks)
    known = events.where(F.col("event") == "SubagentStart").select("session_id", F.concat(F.lit("subagent:"), agent).alias("scope")).where("scope is not null").distinct()
    both = both.where("scope = 'main'").unionByName(both.join(known, SCOPE, "left_semi"))
    out = both.withColumn("ord", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("at", "hook", "pos")).cast("long"))
    return out.withColumn("ts_ms", F.coalesce("ts_ms", F.when(F.col("at") >= 0, F.col("at")), F.lit(0)))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of scopes, each in order, with what they do: `open` or `close` a turn, or `ask` for one that is open; and the latest open turn after them.

    One pass: open turns are kept in the order in which they were opened, and each is found by its id.
    """
    scope, running = None, {}
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        out: list[tuple] = []
        for session, name, at, what, tid, ts, said in rows:
            if (session, name) != scope:
                scope, running = (session, name), {}
            if what == "open" and tid not in running:
                running[tid] = True
                acts = [tid]
            elif what == "all":
                acts, running = list(running), {}
            elif what == "close" and running and (tid is None or tid in running):
                gone = next(reversed(running)) if tid is None else tid
                del running[gone]
                acts = [gone]
            else:
                acts = [tid] if what == "ask" and tid in running else []
            now = next(reversed(running), None)
            out += [(session, name, at, "close" if what == "all" else what, t, what == "all", ts, said if what == "close" else None, now) for t in acts]
        columns = [*zip(*out, strict=True)] if out else [()] * len(MATCHED)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, MATCHED.values(), strict=True)], names=list(MATCHED))


MATCHED = {"session_id": pa.string(), "scope": pa.string(), "ord": pa.int64(), "what": pa.string(), "tid": pa.string(), "every": pa.bool_(), "ts_ms": pa.int64(), "said": pa.string(), "now": pa.string()}


def _marks(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (tid, o, c, start_ms, end_ms, said), and of each mark (ord): the latest open turn after it (state.now), and the turn that a call asked for, if it is open (asked_for)."""
    begins = (F.col("kind") == "event_msg") & (F.col("sub") == "task_started")
    ends = ((F.col("kind") == "event_msg") & (F.col("sub") == "task_complete")) | F.col("sub").isin("Stop", "PostCompact")
    asks = (F.col("kind") == "response_item") & F.col("sub").isin(*CALLS)
    given = F.when(asks, S.text_at("p", "metadata.turn_id")).otherwise(S.text_at("p", "turn_id"))
    said = F.coalesce(S.text_at("p", "last_agent_message"), S.text_at("p", "last_assistant_message"))
    what = F.when(begins, "open").when(F.col("sub") == "SubagentStop", "all").when(ends, "close").when(asks & given.isNotNull(), "ask")
    m = s.withColumns({"what": what, "given": given}).where("what is not null")
    nameless = F.sum(F.when((F.col("what") == "open") & F.col("given").isNull(), 1).otherwise(0)).over(_now(*SCOPE))
    tid = F.coalesce("given", F.when(F.col("what") == "open", F.concat(F.lit("turn-"), _text(nameless))))
    m = m.select(*SCOPE, "ord", "what", tid.alias("tid"), "ts_ms", F.when(F.col("what") == "close", said).alias("said"))
    done = m.repartition(*SCOPE).sortWithinPartitions(*SCOPE, "ord").mapInArrow(_matched, "session_id string, scope string, ord long, what string, tid string, every boolean, ts_ms long, said string, now string")
    done = stored(done)
    acts = done.where("what <> 'ask'")
    n = F.row_number().over(Window.partitionBy(*TURN, "what").orderBy("ord"))
    # What ends with its scope ends when the scope's last turn did.
    last = F.last(F.when((F.col("what") == "close") & ~F.col("every"), F.col("ts_ms")), ignorenulls=True).over(_past(*SCOPE))
    acts = acts.withColumns({"n": n, "ts_ms": F.when(F.col("every"), F.coalesce(last, "ts_ms")).otherwise(F.col("ts_ms"))})
    opened = acts.where("what = 'open'").select(*TURN, "n", F.col("ord").alias("o"), F.col("ts_ms").alias("start_ms"))
    closed = acts.where("what = 'close'").select(*TURN, "n", F.col("ord").alias("c"), F.col("ts_ms").alias("end_ms"), "said")
    after = done.groupBy(*SCOPE, "ord").agg(F.first(F.when(F.col("what") != "ask", F.struct("now")), ignorenulls=True).alias("state"), F.first(F.when(F.col("what") == "ask", F.col("tid")), ignorenulls=True).alias("asked_for"))
    # Only the first life of an id has children of its own; a later one merges into the same span.
    return opened.join(closed, [*TURN, "n"], "left").where("n = 1").drop("n"), after


def _arguments(p: Column) -> Column:
    return F.coalesce(S.json_at(p, "arguments"), S.json_at(p, "input"))


def message_text(p: Column) -> Column:
    """The texts of a message's parts, joined."""
    parts = F.from_json(S.json_at(p, "content"), "array<struct<text:string>>")
    return F.coalesce(F.array_join(F.transform(F.filter(parts, lambda x: x["text"].isNotNull()), lambda x: x["text"]), ""), F.lit(""))


def as_object(args: Column) -> Column:
    """Arguments as the JSON text of an object: one itself, or one written in a string."""
    inner = F.when(F.startswith(args, F.lit('"')), F.try_variant_get(F.try_parse_json(args), "$", "string")).otherwise(args)
    return F.when(F.schema_of_variant(F.try_parse_json(inner)).startswith("OBJECT"), inner)


def skill_of(tool: Column, args: Column) -> tuple[Column, Column, Column]:
    """Whether a call loads a skill, the skill's name and its path: by `skills.read`, a SKILL.md or a file in a `scripts` folder."""
    whole = F.when(F.startswith(args, F.lit('"')), F.try_variant_get(F.try_parse_json(args), "$", "string"))
    body = as_object(args)
    places = F.array_compact(F.array(whole, *(S.text_at(body, k) for k in PLACES)))
    found = F.transform(places, lambda x: F.struct(F.regexp_extract(x, SKILL_DOC, 1).alias("doc"), F.regexp_extract(x, SKILL_SCRIPT, 1).alias("script")))
    first = F.get(F.filter(found, lambda x: (x["doc"] != "") | (x["script"] != "")), F.lit(0))
    path = F.when(first["doc"] != "", first["doc"]).otherwise(F.when(first["script"] != "", first["script"]))
    folder = F.when(first["doc"] != "", S.parent_name(path, 1)).otherwise(S.parent_name(path, 2))
    read = (tool == "skills.read") & body.isNotNull()
    named = F.coalesce(S.text_at(body, "name"), F.when(S.json_at(body, "name").isNull(), S.text_at(body, "package")))
    name = F.when(read, named).otherwise(F.when(folder != "", folder))
    return F.coalesce(read | path.isNotNull(), F.lit(False)), name, F.when(~F.coalesce(read, F.lit(False)), path)


def permission_of(args: Column) -> Column:
    """What a call asks leave for, as JSON, or null."""
    body = as_object(args)
    wanted = S.text_at(body, "sandbox_permissions")
    parts = S.known_entries(sandbox_permissions=S.quoted(wanted), justification=S.quoted(S.text_at(body, "justification")), prefix_rule=S.json_at(body, "prefix_rule"))
    return F.when(wanted != "", _object(parts))


def _object(entries: Column) -> Column:
    """A JSON object of a map of JSON texts with plain keys."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(entries), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"])), ","), F.lit("}"))


def prepared(events: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stream with open turns, model, epoch, history items, skills and cuts; and turns."""
    s = stored(stream(events, records))
    turns, open_after = _marks(s)
    turns = stored(turns)
    p = "p"
    is_item, is_msg = F.col("kind") == "response_item", F.col("kind") == "event_msg"
    s = s.join(open_after, [*SCOPE, "ord"], "left").withColumn("current", F.last("state", ignorenulls=True).over(_past(*SCOPE))["now"])
    context = F.col("kind") == "turn_context"
    s = s.withColumns({
        "model": F.last(F.when(context, S.text_at(p, "model")), ignorenulls=True).over(_now(*SCOPE)),
        "cwd": F.last(F.when(F.col("kind").isin("session_meta", "turn_context"), S.text_at(p, "cwd")), ignorenulls=True).over(_now(*SCOPE)),
        "compacts": (F.col("kind") == "compacted") & F.col("current").isNotNull(),
        "role": F.when(is_item & (F.col("sub") == "message"), F.coalesce(S.text_at(p, "role"), F.lit("user"))),
        "text": F.when(is_item & (F.col("sub") == "message"), message_text(p)),
        "is_call": is_item & F.col("sub").isin(*CALLS), "is_output": is_item & F.col("sub").isin(*OUTPUTS), "is_thought": is_item & (F.col("sub") == "reasoning"),
        "call": F.when(is_item & F.col("sub").isin(*CALLS, *OUTPUTS), S.text_at(p, "call_id")),
    })
    s = s.withColumn("counts", is_msg & (F.col("sub") == "token_count")).withColumn("tool", F.when(F.col("is_call"), F.coalesce(S.text_at(p, "name"), F.regexp_replace("sub", "(_call)+$", ""))))
    thoughts = F.from_json(S.json_at(p, "summary"), "array<struct<text:string>>")
    thoughts = F.transform(F.filter(thoughts, lambda x: x["text"] != ""), lambda x: F.struct(F.lit("summary_text").alias("type"), x["text"].alias("text")))
    args = _arguments(p)
    written = F.coalesce(F.when(F.startswith(args, F.lit('"')), F.try_variant_get(F.try_parse_json(args), "$", "string")), args, F.lit("null"))
    called = F.concat(F.lit('{"role":"assistant","content":null,"tool_calls":['), F.to_json(F.struct(F.coalesce("call", F.lit("")).alias("id"), F.lit("function").alias("type"), F.struct(F.col("tool").alias("name"), written.alias("arguments")).alias("function"))), F.lit("]}"))
    gave = F.coalesce(S.json_at(p, "output"), S.json_at(p, "result"), F.lit("null"))
    content = F.coalesce(F.when(F.startswith(gave, F.lit('"')), F.try_variant_get(F.try_parse_json(gave), "$", "string")), gave)
    s = s.withColumns({"args": F.when(F.col("is_call"), args), "gave": F.when(F.col("is_output"), F.coalesce(S.json_at(p, "output"), S.json_at(p, "result"))), "item": F.when(F.col("text") != "", F.to_json(F.struct("role", F.col("text").alias("content")))).when(F.col("is_thought") & (F.size(thoughts) > 0), F.to_json(F.struct(F.lit("reasoning").alias("type"), thoughts.alias("summary")))).when(F.col("is_call"), called).when(F.col("is_output"), F.to_json(F.struct(F.lit("tool").alias("role"), content.alias("content"), F.coalesce("call", F.lit("")).alias("tool_call_id"))))})
    # A call's own turn, if it is open; other output belongs to the latest open one.
    named = F.when(S.text_at(p, "metadata.turn_id").isNotNull(), F.col("asked_for")).otherwise(F.col("current"))
    own = F.when(F.col("is_call"), F.when(F.col("call").isNotNull(), named)).otherwise(F.col("current"))
    outputs = F.col("is_thought") | ((F.col("role") == "assistant") & (F.col("text") != "")) | (F.col("is_call") & own.isNotNull())
    s = s.withColumns({"tid": own, "speaks": F.coalesce(outputs, F.lit(False))})
    # Epochs of the history.
    kept = F.when(F.col("compacts") & S.json_at(p, "replacement_history").startswith("["), S.json_at(p, "replacement_history"))
    s = s.withColumn("replaced", kept).withColumn("epoch", F.coalesce(F.sum(F.when(F.col("replaced").isNotNull(), 1).otherwise(0)).over(_past(*SCOPE)), F.lit(0)))
    s = s.withColumn("base", F.last("replaced", ignorenulls=True).over(_past(*SCOPE)))
    s = s.withColumn("items", F.count("item").over(_past(*SCOPE, "epoch")) + F.coalesce(F.size(F.from_json("base", "array<string>")), F.lit(0)))
    # Skills that prompts have named in a turn so far.
    said = F.coalesce(S.text_at(p, "message"), S.text_at(p, "text"), S.text_at(p, "prompt"))
    s = s.withColumn("asked", F.when(is_msg & (F.col("sub") == "user_message"), said))
    names = S.mentioned_skills(F.coalesce("asked", F.when(F.col("role") == "user", F.col("text"))))
    s = s.withColumn("skills", F.array_distinct(F.flatten(F.collect_list(F.when(F.col("current").isNotNull() & (F.size(names) > 0), names)).over(_now(*SCOPE, "current")))))
    # Where a model call is cut off.
    ends = turns.where("c is not null").select(*SCOPE, F.col("c").alias("ord"), F.col("tid").alias("ended"))
    ends = ends.groupBy(*SCOPE, "ord").agg(F.collect_list("ended").alias("ended"))
    s = s.join(ends, [*SCOPE, "ord"], "left")
    hard = F.col("counts") | F.col("compacts") | (F.col("sub") == "SubagentStop")
    s = s.withColumn("hard", F.coalesce(hard, F.lit(False)))
    s = s.withColumn("stretch", F.coalesce(F.sum(F.when(F.col("hard"), 1).otherwise(0)).over(_past(*SCOPE)), F.lit(0)))
    speaker = F.coalesce(F.last(F.when(F.col("speaks"), F.col("tid")), ignorenulls=True).over(_past(*SCOPE, "stretch")), F.last(F.when(F.col("compacts"), F.col("current")), ignorenulls=True).over(_past(*SCOPE)))
    s = s.withColumn("cut", F.col("hard") | F.coalesce(F.array_contains("ended", speaker), F.lit(False)))
    return s.withColumn("run", F.coalesce(F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(_past(*SCOPE)), F.lit(0)).cast("long")), turns


def _scope_root() -> Column:
    return F.when(F.col("scope") == "main", _id("root")).otherwise(_id(F.col("scope")))


def _seq(step: int) -> Column:
    return (F.col("ord") * 20 + step).alias("op_seq")


def _roots(events: DataFrame, s: DataFrame, turns: DataFrame) -> DataFrame:
    p, e = "p", "payload"
    first = s.where("kind = 'session_meta'").withColumn("_n", F.row_number().over(_order(*SCOPE))).where("_n = 1")
    start = events.where("event = 'SessionStart'").groupBy("session_id").agg(F.max_by("payload", "seq").alias("started"))
    path = events.where(S.text_at(e, "agent_id").isNull() & S.text_at(e, "transcript_path").isNotNull()).groupBy("session_id").agg(F.min_by(S.text_at(e, "transcript_path"), "seq").alias("path"))
    m = first.where("scope = 'main'").join(start, "session_id", "left").join(path, "session_id", "left")
    folder = S.text_at(p, "cwd")
    name = F.coalesce(F.concat(F.lit("codex: "), S.base_name(folder)), F.lit("codex session"))
    meta = S.known_entries(session_id=S.quoted(S.text_at(p, "id")), cwd=S.quoted(folder), cli_version=S.quoted(S.text_at(p, "cli_version")), source=S.quoted(S.text_at("started", "source")), permission_mode=S.quoted(S.text_at("started", "permission_mode")), transcript_path=S.quoted("path"), model=S.quoted("model"))
    given = F.to_json(F.struct("model", folder.alias("cwd"), S.text_at("started", "source").alias("source")), {"ignoreNullFields": "false"})
    opened = m.select("session_id", _seq(0), F.lit("insert").alias("op"), _id("root").alias("span_id"), F.expr("cast(array() as array<string>)").alias("parent_span_ids"), name.alias("name"), F.lit("task").alias("span_type"), F.col("ts_ms").alias("start_ms"), given.alias("input"), meta.alias("metadata"), "cwd")
    # Subagents hang below the turn whose call spawned them, if the answer came before they began.
    begun = events.where((F.col("event") == "SubagentStart") & S.text_at(e, "agent_id").isNotNull()).select("session_id", S.text_at(e, "agent_id").alias("agent"), "seq", S.text_at(e, "agent_type").alias("agent_type"), S.text_at(e, "transcript_path").alias("agent_path"))
    begun = begun.groupBy("session_id", "agent").agg(F.min("seq").alias("seq"), F.min_by("agent_type", "seq").alias("agent_type"), F.min_by("agent_path", "seq").alias("agent_path"))
    answer = S.json_at(e, "tool_response")
    inner = F.when(F.startswith(answer, F.lit('"')), F.try_variant_get(F.try_parse_json(answer), "$", "string")).otherwise(answer)
    told = events.where((F.col("event") == "PostToolUse") & (S.text_at(e, "tool_name") == SPAWN)).select("session_id", S.text_at(inner, "agent_id").alias("agent"), S.text_at(e, "tool_use_id").alias("call"), F.col("seq").alias("told"))
    calls = s.where((F.col("tool") == SPAWN) & F.col("tid").isNotNull()).groupBy("session_id", "call").agg(F.min_by("tid", "ord").alias("from_turn"))
    spawned = told.join(calls, ["session_id", "call"]).join(begun.select("session_id", "agent", "seq"), ["session_id", "agent"]).where("told < seq").groupBy("session_id", "agent").agg(F.max_by("from_turn", "told").alias("from_turn"))
    a = first.where("scope <> 'main'").withColumn("agent", F.substring("scope", len("subagent:") + 1, 1 << 20)).join(begun.drop("seq"), ["session_id", "agent"]).join(spawned, ["session_id", "agent"], "left")
    known = S.known_entries(agent_id=S.quoted("agent"), agent_type=S.quoted("agent_type"), transcript_path=S.quoted("agent_path"))
    agents = a.select("session_id", _seq(0), F.lit("insert").alias("op"), _scope_root().alias("span_id"), F.array(F.coalesce(F.when(F.col("from_turn").isNotNull(), _id("turn", F.col("from_turn"))), _id("root"))).alias("parent_span_ids"), F.concat(F.lit("subagent: "), "agent").alias("name"), F.lit("task").alias("span_type"), F.col("ts_ms").alias("start_ms"), known.alias("metadata"), "cwd")
    made = first.select(*SCOPE, F.col("ord").alias("made"), F.when(F.col("scope") == "main", F.struct(folder.alias("cwd"))).alias("main"))
    models = s.where(F.col("kind") == "turn_context").where(S.text_at(p, "model").isNotNull()).join(made, SCOPE).where("ord > made").join(start, "session_id", "left")
    seen = F.when(F.col("scope") == "main", F.to_json(F.struct("model", F.col("main.cwd").alias("cwd"), S.text_at("started", "source").alias("source")), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct("model")))
    changed = models.select("session_id", _seq(1), F.lit("merge").alias("op"), _scope_root().alias("span_id"), seen.alias("input"), S.known_entries(model=S.quoted("model")).alias("metadata"), "cwd")
    # The first stop ends the root, a subagent's stop its scope, where their last turn ended.
    last = F.max_by("end_ms", "c")
    stops = s.where((F.col("kind") == "hook") & F.col("sub").isin("Stop", "SubagentStop")).groupBy(*SCOPE).agg(F.min("ord").alias("ord"), F.min_by("ts_ms", "ord").alias("ts_ms")).join(made.select(*SCOPE, "made"), SCOPE).where("made < ord")
    by_name = turns.where("c is not null").join(stops.select(*SCOPE, F.col("ord").alias("stop")), SCOPE).where((F.col("c") < F.col("stop")) | ((F.col("c") == F.col("stop")) & (F.col("scope") == "main"))).groupBy(*SCOPE).agg(last.alias("last_ms"))
    closed = stops.join(by_name, SCOPE, "left").select("session_id", _seq(15), F.lit("merge").alias("op"), _scope_root().alias("span_id"), F.coalesce("last_ms", "ts_ms").alias("end_ms"))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [opened, agents, changed, closed])


def _turns(s: DataFrame, turns: DataFrame) -> DataFrame:
    at = s.select(*SCOPE, F.col("ord").alias("o"), "model", "cwd")
    opened = turns.join(at, [*SCOPE, "o"]).select("session_id", (F.col("o") * 20 + 2).alias("op_seq"), F.lit("insert").alias("op"), _id("turn", F.col("tid")).alias("span_id"), F.array(_scope_root()).alias("parent_span_ids"), F.concat(F.lit("turn: "), "tid").alias("name"), F.lit("task").alias("span_type"), "start_ms", S.known_entries(turn_id=S.quoted("tid"), model=S.quoted("model")).alias("metadata"), "cwd")
    closed = turns.where("c is not null").select("session_id", (F.col("c") * 20 + 8).alias("op_seq"), F.lit("merge").alias("op"), _id("turn", F.col("tid")).alias("span_id"), "end_ms", S.quoted("said").alias("output"))
    asks = s.where("current is not null and (asked is not null or (role = 'user' and size(skills) > 0))")
    loaded = F.when(F.size("skills") > 0, F.to_json("skills"))
    each = F.when(F.size("skills") > 0, F.to_json(F.transform("skills", lambda x: F.struct(x.alias("name")))))
    prompts = asks.select("session_id", _seq(3), F.lit("merge").alias("op"), _id("turn", F.col("current")).alias("span_id"), S.quoted("asked").alias("input"), S.known_entries(loaded_skill_names=loaded, loaded_skills=each).alias("metadata"), "cwd")
    return opened.unionByName(closed, allowMissingColumns=True).unionByName(prompts, allowMissingColumns=True)


def _calls(c: DataFrame) -> DataFrame:
    """Model calls with the epoch and the number of items that they had before them."""
    return c.select(*SCOPE, "run", "span_id", F.coalesce("epoch", "sepoch").alias("epoch"), F.coalesce("items", "sitems").cast("long").alias("items_before"))


def _pieces(calls: DataFrame, s: DataFrame, piece: int) -> DataFrame:
    """Histories of calls in pieces: an epoch's items are what the compaction before it kept, and then what was said."""
    said = s.where("item is not null").select(*SCOPE, "epoch", "ord", F.lit(0).alias("k"), "item")
    kept = s.where("replaced is not null").select(*SCOPE, (F.col("epoch") + 1).alias("epoch"), "ord", F.posexplode(F.from_json("replaced", "array<string>")).alias("k", "item"))
    # A null among the kept is an item as well.
    items = numbered(said.unionByName(kept.withColumn("item", F.coalesce("item", F.lit("null")))), "item", [*SCOPE, "epoch"], ["ord", "k"], piece)
    return pieces(calls, items, "item", [*SCOPE, "epoch"])


def _models(s: DataFrame, turns: DataFrame, tools: DataFrame, triggers: DataFrame, histories: bool) -> list[DataFrame]:
    """Model calls: the n-th run of a scope is one, if anything speaks in it or a compaction began it. Last, those that nothing has ended."""
    run = [*SCOPE, "run"]
    # A compaction's row lies in the run before the one that it begins.
    begins = s.where("compacts").select(*SCOPE, (F.col("run") + 1).alias("run"), F.col("ord").alias("co"), F.col("ts_ms").alias("cts"), F.col("current").alias("ctid"), "p", "replaced", "epoch", "items", F.col("model").alias("cmodel"), F.col("cwd").alias("ccwd"))
    speaks = F.col("speaks") & F.col("item").isNotNull()
    said = s.where("speaks").groupBy(*run).agg(F.min("ord").alias("so"), F.min_by("tid", "ord").alias("stid"), F.max("ts_ms").alias("out_ms"), F.min_by("model", "ord").alias("smodel"), F.min_by("cwd", "ord").alias("scwd"), F.min_by("epoch", "ord").alias("sepoch"), F.min_by("items", "ord").alias("sitems"), F.transform(F.array_sort(F.collect_list(F.when(speaks, F.struct("ord", "item")))), lambda x: x["item"]).alias("texts"))
    ended = s.where("cut").select(*run, F.col("ord").alias("end_ord"), "counts", F.col("ts_ms").alias("cut_ms"), F.col("sub").alias("cut_by"), F.when(F.col("counts"), S.json_at("p", "info.last_token_usage")).alias("usage"))
    c = said.join(begins, run, "full").join(ended, run, "left")
    c = c.withColumns({"tid": F.coalesce("ctid", "stid"), "ord": F.coalesce("co", "so"), "model": F.when(F.col("co").isNotNull(), F.col("cmodel")).otherwise(F.col("smodel")), "cwd": F.coalesce("ccwd", "scwd"), "spoke_ms": F.greatest("out_ms", "cts")}).where("tid is not null")
    c = c.join(turns.select(*TURN, F.col("start_ms").alias("turn_ms"), F.col("c").alias("turn_c"), F.col("end_ms").alias("turn_end")), TURN)
    # Children of a turn that had ended before: tools at their output, calls at their token count.
    child = c.where("counts").select(*TURN, F.col("end_ord").alias("ord"), F.greatest("turn_ms", "spoke_ms").alias("child_ms"))
    child = child.unionByName(tools.where("x is not null").select(*TURN, F.col("x").alias("ord"), F.col("out_ms").alias("child_ms")))
    timed = c.unionByName(child, allowMissingColumns=True).withColumn("before_ms", F.max("child_ms").over(Window.partitionBy(*TURN).orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)))
    c = timed.where("run is not null").withColumn("start_ms", F.coalesce("before_ms", "turn_ms"))
    is_compaction = F.col("co").isNotNull()
    n = F.row_number().over(Window.partitionBy(*TURN, is_compaction).orderBy("ord")) - 1
    c = c.withColumn("span_id", F.when(is_compaction, _id("llm", F.col("tid"), "compaction")).otherwise(_id("llm", F.col("tid"), _text(n))))
    metrics = {k: v.cast("double") for k, v in S.token_metrics("usage").items()}
    metrics = F.map_filter(F.create_map(*(x for k, v in metrics.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    if histories:
        whole = _pieces(_calls(c), s, PIECE).groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("told"))
        c = c.join(whole, run, "left")
        past = _joined(F.coalesce(F.transform("told", lambda x: x["text"]), F.expr("cast(array() as array<string>)")))
    else:
        past = F.to_json(F.struct("scope", F.coalesce("epoch", "sepoch").alias("epoch"), F.coalesce("items", "sitems").alias("items_before")))
    given = F.when(is_compaction, F.concat(F.lit('{"messages_before_compaction":'), _text(F.col("items")), F.lit(',"history":'), past, F.lit("}"))).otherwise(past)
    kept = F.from_json("replaced", "array<string>")
    sealed = F.exists(kept, lambda x: (S.text_at(x, "type") == "compaction") & S.text_at(x, "encrypted_content").isNotNull())
    left = F.filter(kept, lambda x: ~F.coalesce(S.text_at(x, "type") == "compaction", F.lit(False)))
    summary = F.when(kept.isNull(), F.lit(f'{{"summary":"{NO_HISTORY}","kept_messages":[]}}')).otherwise(F.concat(F.lit('{"summary":"'), F.when(sealed, F.lit(SEALED)).otherwise(F.lit(NO_SUMMARY)), F.lit('","kept_messages":'), _joined(left), F.lit("}")))
    opened = c.select("session_id", _seq(4), F.lit("insert").alias("op"), "span_id", F.array(_id("turn", F.col("tid"))).alias("parent_span_ids"), F.coalesce("model", F.when(is_compaction, "compaction").otherwise("llm")).alias("name"), F.lit("llm").alias("span_type"), "start_ms", given.alias("input"), F.when(is_compaction, summary).alias("output"), S.known_entries(model=S.quoted("model"), turn_id=S.quoted("tid"), compaction=F.when(is_compaction, F.lit("true"))).alias("metadata"), "cwd")
    answer = F.when(~is_compaction, F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(_joined(F.coalesce("texts", F.expr("cast(array() as array<string>)")))))
    # A call that a compaction replaced is never ended.
    reason = F.when(~F.col("counts"), NO_COUNT).when(F.size(metrics) == 0, F.when(F.coalesce(F.col("usage"), F.lit("{}")).isin("{}", "null") | ~F.startswith("usage", F.lit("{")), NO_USAGE).otherwise(ODD_USAGE))
    at = F.when(F.col("counts"), F.greatest("spoke_ms", "start_ms")).when(F.col("cut_by") == "SubagentStop", F.coalesce(F.when(F.col("turn_c") == F.col("end_ord"), F.col("turn_end")), "cut_ms")).otherwise(F.greatest("spoke_ms", F.when(~is_compaction, F.col("start_ms"))))
    done = c.where(F.col("end_ord").isNotNull() & (F.col("cut_by").isNull() | (F.col("cut_by") != "compacted")))
    done = done.join(s.where("compacts").select(*SCOPE, F.col("ord").alias("end_ord")), [*SCOPE, "end_ord"], "left_anti")
    closed = done.select("session_id", (F.col("end_ord") * 20 + 6).alias("op_seq"), F.lit("merge").alias("op"), "span_id", at.alias("end_ms"), answer.alias("output"), S.known_entries(usage_unavailable_reason=S.quoted(reason)).alias("metadata"), F.when(F.size(metrics) > 0, metrics).alias("metrics"))
    told = c.where("co is not null").join(triggers, ["session_id", "tid"], "left")
    what = S.known_entries(trigger=S.quoted("trigger"), replaced_message_count=_text(F.size(F.from_json("replaced", "array<string>"))), window_id=S.json_at("p", "window_id"))
    marked = told.select("session_id", _seq(5), F.lit("merge").alias("op"), _id("turn", F.col("tid")).alias("span_id"), F.lit("compaction").alias("name"), S.known_entries(compaction=_object(what)).alias("metadata"), F.array(F.lit("compaction")).alias("tags"), "cwd")
    return [opened, closed, marked, _calls(c), c.where(F.col("end_ord").isNull()).select("session_id", "scope", "ord", "span_id", "spoke_ms", F.when(~is_compaction, answer).alias("output"))]


def tool_pairs(s: DataFrame, turns: DataFrame) -> DataFrame:
    """Tool calls: the first of each id with where and how it ended: x, an output, or the end of its turn."""
    key = [*SCOPE, "call"]
    called = s.where("is_call and tid is not null").withColumn("_n", F.row_number().over(_order(*key))).where("_n = 1")
    gave = s.where("is_output and call is not null").select(*key, F.col("ord").alias("go"), F.col("ts_ms").alias("gts"), "gave")
    pairs = called.select(*key, "ord").join(gave, key).where("go > ord").groupBy(*key).agg(F.min("go").alias("x"), F.min_by("gts", "go").alias("out_ms"), F.min_by("gave", "go").alias("gave"))
    stop = s.where("sub = 'SubagentStop'").groupBy(*SCOPE).agg(F.min("ord").alias("stop"))
    t = called.drop("gave").join(pairs, key, "left").join(turns.select(*TURN, "c", F.col("end_ms").alias("turn_end")), TURN).join(stop, SCOPE, "left")
    late = F.col("x") > F.col("c")
    return t.withColumns({"out_ms": F.when(~F.coalesce(late, F.lit(False)), F.col("out_ms")), "gave": F.when(~F.coalesce(late, F.lit(False)), F.col("gave")), "x": F.when(~F.coalesce(late, F.lit(False)), F.col("x"))})


def _tools(t: DataFrame) -> DataFrame:
    loads, skill, path = skill_of(F.col("tool"), F.col("args"))
    t = t.withColumns({"loads": loads, "skill": skill, "path": path, "leave": permission_of(F.col("args"))})
    explicit = F.array_contains("skills", F.col("skill"))
    meta = S.known_entries(tool_name=S.quoted("tool"), call_id=S.quoted("call"), turn_id=S.quoted("tid"), skill_name=F.when(F.col("loads"), S.quoted("skill")), skill_load_trigger=F.when(F.col("loads") & explicit, F.lit('"explicit"')), skill_path=F.when(F.col("loads"), S.quoted("path")), tool_kind=F.when(F.col("loads"), F.lit('"skill"')), permission=F.col("leave"))
    opened = t.select("session_id", _seq(10), F.lit("insert").alias("op"), _id("tool", F.col("call")).alias("span_id"), F.array(_id("turn", F.col("tid"))).alias("parent_span_ids"), F.coalesce(F.when(F.col("loads"), F.concat(F.lit("skill: "), "skill")), "tool").alias("name"), F.lit("tool").alias("span_type"), F.col("ts_ms").alias("start_ms"), F.col("args").alias("input"), meta.alias("metadata"), F.when(F.col("leave").isNotNull(), F.array(F.lit("permission-request"))).alias("tags"), "cwd")
    approved = S.known_entries(tool_approval=F.lit('"approved"'))
    ended = t.where("x is not null or c is not null")
    closed = ended.select("session_id", (F.coalesce("x", "c") * 20 + 7).alias("op_seq"), F.lit("merge").alias("op"), _id("tool", F.col("call")).alias("span_id"), F.when(F.col("x").isNotNull(), F.col("out_ms")).otherwise(F.col("turn_end")).alias("end_ms"), "gave", approved.alias("metadata"), F.when(F.col("x").isNotNull(), S.output_error("gave")).otherwise(F.lit(MISSING)).alias("error")).withColumnRenamed("gave", "output")
    return opened.unionByName(closed, allowMissingColumns=True)


def _finals(s: DataFrame, turns: DataFrame, calls: DataFrame, tools: DataFrame) -> list[DataFrame]:
    """What ends all that is open at the end of the stream."""
    ended = turns.where("c is not null").groupBy(*SCOPE).agg(F.max_by("end_ms", "c").alias("last_ms"))
    end = s.groupBy(*SCOPE).agg(F.max("ord").alias("final")).join(ended, SCOPE, "left")
    step = lambda k: (F.col("final") * 20 + k).alias("op_seq")
    merge = F.lit("merge").alias("op")
    models = calls.join(end, SCOPE).select("session_id", step(16), merge, "span_id", F.coalesce("last_ms", "spoke_ms").alias("end_ms"), "output", S.known_entries(usage_unavailable_reason=F.lit(f'"{NO_COUNT}"')).alias("metadata"))
    shut = tools.where("x is null and c is null").join(end, SCOPE).select("session_id", step(17), merge, _id("tool", F.col("call")).alias("span_id"), F.col("last_ms").alias("end_ms"), S.known_entries(tool_approval=F.lit('"approved"')).alias("metadata"), F.lit(MISSING).alias("error"))
    left = turns.where("c is null").join(end, SCOPE).select("session_id", step(18), merge, _id("turn", F.col("tid")).alias("span_id"), F.col("last_ms").alias("end_ms"))
    return [models, shut, left]


def _triggers(events: DataFrame) -> DataFrame:
    e = "payload"
    asked = events.where(F.col("event").isin("PreCompact", "PostCompact")).select("session_id", "seq", S.text_at(e, "turn_id").alias("tid"), F.coalesce(S.text_at(e, "trigger"), F.lit("manual")).alias("trigger"))
    return asked.where("tid is not null").groupBy("session_id", "tid").agg(F.min_by("trigger", "seq").alias("trigger"))


def codex_inputs(events: DataFrame, records: DataFrame, piece: int = PIECE) -> DataFrame:
    """What model calls were given: a row (session_id, scope, span_id, epoch, items_before, piece, n_items, text) for each call and block of about `piece` bytes of its history, items joined by commas."""
    s, turns = prepared(events, records)
    s = stored(s)
    calls = _models(s, turns, stored(tool_pairs(s, turns)), _triggers(events), False)[-2]
    return _pieces(stored(calls.drop("run")), s, piece).select(*SCOPE, "span_id", "epoch", "items_before", "piece", "n_items", "text")


def codex_ops(events: DataFrame, records: DataFrame, git: DataFrame | None = None, histories: bool = False, finalize: bool = False) -> DataFrame:
    """Span operations of Codex hooks and rollout records.

    git: (cwd, git map of JSON texts), what is known of folders. finalize closes calls, tools and turns that are still open, where the last turn of their scope ended; where none did, they
    end at no time, but calls with their last output.
    """
    s, turns = prepared(events, records)
    s = stored(s)
    triggers = _triggers(events)
    tools = stored(tool_pairs(s, turns))
    calls = _models(s, turns, tools, triggers, histories)
    parts = [_roots(events, s, turns), _turns(s, turns), *calls[:-2], _tools(tools)]
    if finalize:
        parts += _finals(s, turns, calls[-1], tools)
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return as_ops(enriched(out, git).withColumn("root_span_id", _id("root")))

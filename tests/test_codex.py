"""Codex rollouts and hooks against spans worked out by hand from the rules."""

from __future__ import annotations

import json

import pytest

from loomspan.operators.spans import fold
from loomspan.plans.translate.codex import codex_ops

RECORDS = "session_id string, scope string, pos long, ts_ms long, rec string"
EVENTS = "session_id string, seq long, event string, ts_ms long, payload string"


def rec(kind, at, **payload):
    return at, json.dumps({"type": kind, "payload": payload})


def msg(sub, at, **more):
    return rec("event_msg", at, type=sub, **more)


def item(sub, at, **more):
    return rec("response_item", at, type=sub, **more)


def said(at, text, role="assistant"):
    return item("message", at, role=role, content=[{"text": text}])


MAIN = [
    rec("session_meta", 1000, id="native", cwd="/w/proj", cli_version="0.9"),
    rec("turn_context", 1001, model="m-1"),
    msg("task_started", 1010, turn_id="A"),
    msg("task_started", 1011, turn_id="A"),
    msg("user_message", 1012, message="use $fmt, please"),
    said(1013, "use $fmt, please", "user"),
    item("reasoning", 1020, summary=[{"text": "think"}, {"text": ""}]),
    item("function_call", 1030, call_id="c1", name="shell", arguments=json.dumps({"command": "cat skills/fmt/SKILL.md", "sandbox_permissions": "all", "justification": "why"})),
    msg("token_count", 1031, info={"last_token_usage": {"input_tokens": 5, "output_tokens": 7}}),
    item("function_call_output", 1050, call_id="c1", output="Exit code 2\nbad"),
    said(1070, "done"),
    msg("token_count", 1075, info={"last_token_usage": {}}),
    item("custom_tool_call", 1080, call_id="c2", name="spawn_agent", input={"x": 1}),
    msg("task_complete", 1100, turn_id="A", last_agent_message="bye"),
    item("custom_tool_call_output", 1110, call_id="c2", output="late"),
]


KEPT = [{"role": "user", "content": "kept"}, {"type": "compaction", "encrypted_content": "z"}]
SPAWNING = [rec("session_meta", 1), msg("task_started", 2, turn_id="A"), item("function_call", 3, call_id="sp", name="spawn_agent", arguments="{}"), item("function_call_output", 4, call_id="sp", output={"agent_id": "g"})]
SUB = [rec("session_meta", 5), rec("turn_context", 5, model="sub-m"), msg("task_started", 6, turn_id="S"), said(7, "hi"), item("function_call", 8, call_id="q", name="t", arguments="{}")]
HOOKS = [("PostToolUse", 4, {"tool_name": "spawn_agent", "tool_use_id": "sp", "tool_response": json.dumps({"agent_id": "g"})}), ("SubagentStart", 5, {"agent_id": "g", "agent_type": "explorer", "transcript_path": "/g"}), ("SubagentStop", 30, {"agent_id": "g", "agent_transcript_path": "/g"})]
SESSIONS = {
    "one": ({"main": MAIN}, [("SessionStart", 990, {"source": "cli", "permission_mode": "ask", "transcript_path": "/t"}), ("Stop", 1090, {"last_assistant_message": "ignored"})]),
    "overlap": ({"main": [rec("session_meta", 1), msg("task_started", 2, turn_id="A"), said(3, "a"), msg("token_count", 4, info={"last_token_usage": {"tokens": 1}}), msg("task_started", 5, turn_id="B"), item("function_call", 6, call_id="x", name="t", arguments="{}", metadata={"turn_id": "A"}), msg("token_count", 7), msg("task_complete", 8, turn_id="A"), said(9, "b"), msg("task_complete", 10, turn_id="nobody"), msg("task_complete", 11)]}, []),
    "numbered": ({"main": [rec("session_meta", 1), msg("task_started", 2), msg("task_complete", 3), msg("task_started", 4), said(5, "x")]}, []),
    "compacted": ({"main": [rec("session_meta", 1), msg("task_started", 2, turn_id="A"), said(3, "one", "user"), said(4, "two"), msg("token_count", 5, info={"last_token_usage": {"tokens": 1}}), msg("task_complete", 6, turn_id="A"),
            msg("task_started", 10, turn_id="C"), rec("compacted", 12, window_id=7, replacement_history=KEPT), msg("token_count", 13, info={"last_token_usage": {"tokens": 9}}), msg("task_complete", 14, turn_id="C"),
            msg("task_started", 20, turn_id="D"), said(21, "more", "user"), said(22, "answer")]}, [("PreCompact", 11, {"turn_id": "C", "trigger": "auto"})]),
    "spawned": ({"main": SPAWNING, "subagent:g": SUB, "subagent:unknown": SUB}, HOOKS),
    "late": ({"main": SPAWNING, "subagent:g": SUB}, HOOKS[1:]),
    "folder": ({"main": [rec("turn_context", 1, model="own"), rec("session_meta", 1, cwd="/w/git"), msg("task_started", 2, turn_id="A")]}, []),
    "empty": ({"main": []}, []),
    "malformed": ({"main": [(1, "not json"), (2, "{}"), (None, json.dumps({"type": "session_meta"})), (4, json.dumps({"type": "event_msg", "payload": 3}))]}, []),
}


def folded(spark, names, **more):
    """Spans of sessions by session and name; model calls by their start."""
    records = [(n, scope, i, at, r) for n in names for scope, rows in SESSIONS[n][0].items() for i, (at, r) in enumerate(rows)]
    events = [(n, i + 1, name, at, json.dumps(payload)) for n in names for i, (name, at, payload) in enumerate(SESSIONS[n][1])]
    ops = codex_ops(spark.createDataFrame(events, EVENTS), spark.createDataFrame(records, RECORDS), **more)
    out = {}
    for r in fold(ops).collect():
        out.setdefault(r.session_id, {})[r.name if r.span_type != "llm" else f"llm@{r.start_ms}"] = r
    return out


@pytest.fixture(scope="module")
def spans(spark):
    git = spark.createDataFrame([("/w/git", {"branch": '"main"', "model": '"overruled"'})], "cwd string, git map<string,string>")
    return folded(spark, list(SESSIONS), git=git, histories=True)


def test_a_session_of_one_turn(spans):
    got = spans["one"]
    root, turn, one, two = got["codex: proj"], got["turn: A"], got["llm@1010"], got["llm@1050"]
    assert json.loads(root.input) == {"model": "m-1", "cwd": "/w/proj", "source": "cli"}
    assert root.metadata == {"session_id": '"native"', "cwd": '"/w/proj"', "cli_version": '"0.9"', "source": '"cli"', "permission_mode": '"ask"', "transcript_path": '"/t"', "model": '"m-1"'}
    # The stop arrives before the turn's own end and ends it; what comes later finds it closed.
    assert (turn.start_ms, turn.end_ms, turn.output, root.end_ms) == (1010, 1090, '"ignored"', 1090)
    assert turn.input == '"use $fmt, please"' and json.loads(turn.metadata["loaded_skill_names"]) == ["fmt"]
    assert (one.end_ms, one.metrics) == (1030, {"prompt_tokens": 5.0, "completion_tokens": 7.0, "tokens": 12.0})
    answer = json.loads(one.output)
    assert [x.get("type", x.get("role")) for x in answer] == ["reasoning", "assistant"] and answer[0]["summary"] == [{"type": "summary_text", "text": "think"}]
    assert (two.start_ms, two.end_ms, json.loads(two.output)) == (1050, 1070, {"role": "assistant", "content": "done"})
    assert two.metadata["usage_unavailable_reason"] == '"codex_token_count_missing_usage"' and not two.metrics
    shell, spawn, three = got["skill: fmt"], got["spawn_agent"], got["llm@1070"]
    assert (shell.start_ms, shell.end_ms, shell.error, shell.tags) == (1030, 1050, "Exit code 2", ["permission-request"])
    assert shell.metadata["skill_load_trigger"] == '"explicit"' and json.loads(shell.metadata["permission"]) == {"sandbox_permissions": "all", "justification": "why"}
    assert (spawn.end_ms, spawn.error, spawn.output) == (1090, "Tool output missing before turn ended", None)
    assert three.metadata["usage_unavailable_reason"] == '"codex_transcript_missing_token_count"' and three.end_ms == 1080
    assert {x.root_span_id for x in got.values()} == {root.span_id} and set(turn.parent_span_ids) == {root.span_id}


def test_turns_that_overlap_are_told_apart_by_id(spans):
    got = spans["overlap"]
    assert (got["turn: A"].end_ms, got["turn: B"].end_ms) == (8, 11)
    assert got["t"].parent_span_ids == [got["turn: A"].span_id] and got["t"].end_ms == 8
    assert got["llm@5"].parent_span_ids == [got["turn: B"].span_id] and got["llm@5"].end_ms == 9
    assert got["llm@3"].parent_span_ids == [got["turn: A"].span_id]
    assert got["codex session"].end_ms is None


def test_turns_without_ids_are_numbered(spans):
    got = spans["numbered"]
    assert {"turn: turn-1", "turn: turn-2"} <= set(got) and got["turn: turn-2"].end_ms is None


def test_compaction_begins_a_new_epoch(spans):
    got = spans["compacted"]
    turn, call, after = got["compaction"], got["llm@10"], got["llm@20"]
    assert json.loads(turn.metadata["compaction"]) == {"trigger": "auto", "replaced_message_count": 2, "window_id": 7} and turn.tags == ["compaction"]
    assert json.loads(call.input) == {"messages_before_compaction": 2, "history": [{"role": "user", "content": "one"}, {"role": "assistant", "content": "two"}]}
    assert json.loads(call.output) == {"summary": "[summary unavailable — encrypted by Codex]", "kept_messages": KEPT[:1]}
    assert (call.end_ms, call.metrics, call.metadata["compaction"]) == (12, {"tokens": 9.0}, "true")
    assert json.loads(after.input) == [*KEPT, {"role": "user", "content": "more"}]


def test_inputs_are_references_unless_histories_are_asked_for(spark):
    got = folded(spark, ["compacted"])["compacted"]
    assert json.loads(got["llm@20"].input) == {"scope": "main", "epoch": 1, "items_before": 3}


def test_subagents_hang_below_the_turn_that_spawned_them(spans):
    got = spans["spawned"]
    agent = got["subagent: g"]
    assert agent.parent_span_ids == [got["turn: A"].span_id] and agent.end_ms == 30 and agent.metadata["model"] == '"sub-m"'
    assert got["turn: S"].parent_span_ids == [agent.span_id] and got["turn: S"].end_ms == 30 and got["t"].error.startswith("Tool output missing")
    assert got["llm@6"].metadata["usage_unavailable_reason"] == '"codex_transcript_missing_token_count"'
    assert sum(n.startswith("subagent") for n in got) == 1
    late = spans["late"]
    assert late["subagent: g"].parent_span_ids == [late["codex session"].span_id]


def test_folders_enrich_every_insert(spans):
    got = spans["folder"]
    assert got["codex: git"].metadata["branch"] == got["turn: A"].metadata["branch"] == '"main"'
    # What git says wins over a span's own metadata.
    assert got["codex: git"].metadata["model"] == '"overruled"'


def test_no_records_and_malformed_ones(spans):
    assert "empty" not in spans
    assert set(spans["malformed"]) == {"codex session"} and spans["malformed"]["codex session"].start_ms == 2


def test_a_flush_closes_what_is_open_where_the_last_turn_ended(spark):
    names = ["numbered", "overlap", "flushed"]
    SESSIONS["flushed"] = ({"main": [rec("session_meta", 1), msg("task_started", 2, turn_id="A"), msg("task_complete", 3, turn_id="A"), msg("task_started", 4, turn_id="B"), said(5, "x"), item("function_call", 6, call_id="q", name="t", arguments="{}")]}, [])
    got = folded(spark, names, finalize=True)
    assert (got["numbered"]["turn: turn-2"].end_ms, got["numbered"]["llm@4"].end_ms) == (3, 3)
    flushed = got["flushed"]
    assert (flushed["turn: B"].end_ms, flushed["t"].end_ms, flushed["t"].error, flushed["llm@4"].end_ms) == (3, 3, "Tool output missing before turn ended", 3)
    assert flushed["llm@4"].metadata["usage_unavailable_reason"] == '"codex_transcript_missing_token_count"' and len(json.loads(flushed["llm@4"].output)) == 2
    assert flushed["codex session"].end_ms is None
    assert folded(spark, ["flushed"])["flushed"]["turn: B"].end_ms is None


def test_many_turns_of_one_session_are_matched_in_one_pass(spark):
    """100,000 turns, half of them ended without an id, and 10,000 that nothing ends."""
    from pyspark.sql import functions as F

    from loomspan.plans.translate import codex

    n = 100_000
    k = F.col("id")
    start = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("task_started").alias("type"), F.concat(F.lit("t"), k.cast("string")).alias("turn_id")).alias("payload")))
    ended = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("task_complete").alias("type"), F.when(k % 2 == 0, F.concat(F.lit("t"), k.cast("string"))).alias("turn_id")).alias("payload")))
    rows = spark.range(n).select((k * 2).alias("pos"), start.alias("rec")).unionByName(spark.range(n).where("id % 10 <> 5").select((k * 2 + 1).alias("pos"), ended.alias("rec")))
    records = rows.select(F.lit("s").alias("session_id"), F.lit("main").alias("scope"), "pos", F.col("pos").alias("ts_ms"), "rec")
    turns, _ = codex._marks(codex.stream(spark.createDataFrame([], EVENTS), records))
    got = turns.agg(F.count("*").alias("n"), F.count("c").alias("ended"), F.sum(F.expr("end_ms - start_ms")).alias("length")).first()
    assert (got.n, got.ended, got.length) == (n, n - n // 10, n - n // 10)

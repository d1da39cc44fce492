"""Folders of transcripts in, whole traces out."""

from __future__ import annotations

import json

import pytest

from events import folded
from loomspan.plans.translate.claude import claude_ops
from loomspan.plans.translate.codex import codex_ops
from loomspan.plans.translate.importing import checked, claude_import, codex_import, growing
from loomspan.sources import files, imports

BASE = 1_704_067_200_000


def stamp(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z"


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps({"timestamp": stamp(at), **r}) + "\n" for at, r in rows))


def user(at, content, **more):
    return at, {"type": "user", "message": {"content": content}, **more}


def answer(at, name, *blocks, **more):
    return at, {"type": "assistant", "message": {"id": name, "model": "opus", "content": list(blocks)}, **more}


def text(said):
    return {"type": "text", "text": said}


def spans_of(spark, folder, take, translate):
    events, records = take(checked(files.records(spark, str(folder), skip_broken=False)))
    return events, list(folded(translate(events.drop("turn"), records)).values())


@pytest.fixture(scope="module")
def claude(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("claude")
    put(folder / "p" / "trip.jsonl", [
        user(1, "plan it", sessionId="trip", cwd="/home/me/tour", version="3.1"),
        answer(2, "r1", {"type": "tool_use", "id": "go", "name": "Agent", "input": {"subagent_type": "scout"}}),
        user(6, [{"type": "tool_result", "tool_use_id": "go", "content": "seen"}], toolUseResult={"agentId": "s1"}),
        answer(7, "r2", text("planned")),
        (50, {"type": "queue-operation", "content": "and pay"}),
        user(20, [text("pack")]),
        answer(21, "r3", text("no room"), isApiErrorMessage=True, error="overloaded", apiErrorStatus=529),
        user(30, "pay"), answer(31, "r4", {"type": "tool_use", "id": "run", "name": "Bash", "input": {"command": "pay"}}), user(32, [{"type": "tool_result", "tool_use_id": "run", "content": "ok"}]), answer(33, "r5", text("paid")),
    ])
    put(folder / "p" / "trip" / "subagents" / "deep" / "agent-s1.jsonl", [answer(4, "c1", text("saw a lake")), answer(5, "c2", text("and a hill"))])
    put(folder / "p" / "trip" / "subagents" / "agent-nobody.jsonl", [answer(60, "c9", text("late"))])
    put(folder / "q" / "other.jsonl", [user(1, "hi", cwd="/w")])
    return spans_of(spark, folder, claude_import, claude_ops)


def test_turns_of_claude_last_as_long_as_their_conversation(claude):
    _, spans = claude
    by = {(r.session_id, r.name): r for r in spans if r.span_type == "task"}
    ends = {n: (by["trip", f"Turn {n}"].start_ms - BASE, by["trip", f"Turn {n}"].end_ms - BASE, by["trip", f"Turn {n}"].error) for n in (1, 2, 3)}
    # Bookkeeping at second 50 stands before records of second 20 and ends no turn.
    assert ends == {1: (1000, 7000, None), 2: (20_000, 21_000, "overloaded"), 3: (30_000, 33_000, None)}
    root = by["trip", "Claude Code: tour"]
    assert (root.start_ms - BASE, root.end_ms - BASE, root.metadata["session_source"], root.metadata["claude_code_version"]) == (999, 50_001, '"import"', '"3.1"')
    assert by["trip", "Turn 2"].output == '"no room"' and json.loads(by["trip", "Turn 2"].input) == [text("pack")] and by["trip", "Turn 3"].input == '"pay"'
    assert (by["other", "Turn 1"].end_ms, by["other", "Claude Code: w"].end_ms) == (BASE + 1000, BASE + 1001)


def test_subagents_of_claude_are_of_the_same_trace(claude):
    _, spans = claude
    trip = [r for r in spans if r.session_id == "trip"]
    by = {r.name: r for r in trip}
    root, one, scout, lost = by["Claude Code: tour"], by["Turn 1"], by["subagent: scout"], by["subagent: agent"]
    assert {r.root_span_id for r in trip} == {root.span_id}
    assert scout.parent_span_ids == [one.span_id] and (scout.start_ms - BASE, scout.end_ms - BASE, scout.output) == (2000, 6000, '"and a hill"')
    # A file that no record names belongs to where the transcript ends.
    assert lost.parent_span_ids == [by["Turn 3"].span_id] and lost.end_ms - BASE == 60_000
    calls = {r.metadata["request_id"]: r for r in trip if r.span_type == "llm"}
    assert {k.strip('"') for k in calls} == {"r1", "r2", "r3", "r4", "r5", "c1", "c2", "c9"}
    assert calls['"c1"'].parent_span_ids == [scout.span_id] and calls['"r2"'].parent_span_ids == [one.span_id]
    assert (calls['"r3"'].error, calls['"r3"'].metadata["api_error_status"], calls['"r3"'].parent_span_ids) == ("overloaded", "529", [by["Turn 2"].span_id])
    tools = {r.name: r for r in trip if r.span_type == "tool"}
    assert set(tools) == {"Agent", "Terminal: pay"} and all(r.metadata["recovered_from_transcript"] == "true" for r in tools.values())


def test_a_growing_transcript_keeps_its_newest_turn_open(claude):
    events, _ = claude
    got = {r.session_id: r for r in growing(events).groupBy("session_id").agg({"event": "collect_list"}).collect()}
    trip = got["trip"]["collect_list(event)"]
    assert sorted(trip) == sorted(["SessionStart", "UserPromptSubmit", "SubagentStart", "SubagentStop", "Stop", "UserPromptSubmit", "StopFailure", "UserPromptSubmit", "ImportCheckpoint"])
    assert sorted(got["other"]["collect_list(event)"]) == ["ImportCheckpoint", "SessionStart", "UserPromptSubmit"]


def meta(at, name, **more):
    return at, {"type": "session_meta", "payload": {"id": name, **more}}


def msg(at, sub, **more):
    return at, {"type": "event_msg", "payload": {"type": sub, **more}}


def spawn(at, call, agent):
    return [(at, {"type": "response_item", "payload": {"type": "function_call", "call_id": call, "name": "spawn_agent", "arguments": json.dumps({"agent_type": "scout"})}}), (at + 1, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": call, "output": json.dumps({"agent_id": agent})}})]


def test_codex_rollouts_with_agents_of_agents(spark, tmp_path):
    child = {"source": {"subagent": {"thread_spawn": {"parent_thread_id": "top"}}}}
    home = tmp_path / "sessions"
    put(home / "2024" / "rollout-1-top.jsonl", [meta(1, "top", cwd="/w/tour", cli_version="0.7"), (2, {"type": "turn_context", "payload": {"model": "m"}}), msg(3, "task_started", turn_id="A"), msg(4, "user_message", message="go"), *spawn(5, "k1", "kid"), *spawn(7, "k2", "gone"), msg(9, "task_complete", turn_id="A"), msg(10, "task_started", turn_id="B"), msg(12, "task_complete", last_agent_message="bye")])
    # The agent spawns one of its own, which names its elder again: a circle.
    put(home / "2025" / "rollout-2-kid.jsonl", [meta(6, "kid", **child), msg(7, "task_started", turn_id="K"), *spawn(8, "k3", "grandkid"), msg(20, "task_complete", last_agent_message="found")])
    put(home / "2025" / "rollout-3-grandkid.jsonl", [meta(9, "grandkid", **child), msg(10, "task_started", turn_id="G"), *spawn(11, "k4", "kid"), msg(14, "task_complete")])
    put(home / "2025" / "rollout-4-alone.jsonl", [meta(3, "alone")])
    events, spans = spans_of(spark, tmp_path, codex_import, codex_ops)
    by = {(r.session_id, r.name): r for r in spans}
    root, a, b = by["top", "codex: tour"], by["top", "turn: A"], by["top", "turn: B"]
    assert (root.start_ms - BASE, root.end_ms - BASE, root.metadata["source"]) == (1000, 12_000, '"import"') and (a.end_ms - BASE, b.end_ms - BASE, b.output) == (9000, 12_000, '"bye"')
    kid, grand = by["top", "subagent: kid"], by["top", "subagent: grandkid"]
    assert kid.parent_span_ids == [a.span_id] and grand.parent_span_ids == [by["top", "turn: K"].span_id]
    assert (kid.start_ms - BASE, kid.end_ms - BASE, grand.end_ms - BASE, kid.metadata["agent_type"]) == (6000, 20_000, 14_000, '"scout"')
    assert {r.root_span_id for (s, _), r in by.items() if s == "top"} == {root.span_id}
    assert [s for s, n in by if n.startswith("subagent")] == ["top", "top"] and ("alone", "codex session") in by
    marks = [r.ts_ms - BASE for r in events.where("event = 'ImportCheckpoint' and session_id = 'top'").orderBy("seq").collect()]
    assert marks == [3000, 9000, 10_000]
    told = growing(events).where("session_id = 'top'").orderBy("seq").select("event").collect()
    assert [r.event for r in told] == ["SessionStart", *["ImportCheckpoint"] * 4]


def test_what_can_not_be_imported_is_an_error(spark, tmp_path):
    put(tmp_path / "a.jsonl", [user(1, "x", sessionId="s")])
    with (tmp_path / "a.jsonl").open("a") as f:
        f.write("\n{broken\n")
    with pytest.raises(ValueError, match=r"a\.jsonl line 3"):
        checked(files.records(spark, str(tmp_path), skip_broken=False))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "b.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="empty"):
        checked(files.records(spark, str(tmp_path / "empty"), skip_broken=False))
    listed = spark.createDataFrame([("/x/s.jsonl",), ("/y/s.jsonl",), ("/y/t.txt",)], "path string")
    with pytest.raises(ValueError, match="multiple transcripts found for session s"):
        imports.importable(imports.discovered(listed))
    with pytest.raises(ValueError, match="no transcripts"):
        imports.importable(imports.discovered(listed.where("path like '%.txt'")))
    assert [tuple(r) for r in imports.importable(imports.discovered(listed.limit(1))).collect()] == [("s", "/x/s.jsonl")]

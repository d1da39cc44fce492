from __future__ import annotations

import json

from events import folded, table
from loomspan.plans.translate.claude import claude_ops

HOOKS = [
    ("SessionStart", 1, {"cwd": "/home/me/project", "source": "startup", "model": "m"}),
    ("UserPromptSubmit", 2, {"prompt": "go"}),
    ("PreToolUse", 3, {"tool_name": "Bash", "tool_use_id": "t1", "tool_input": {"command": "ls"}}),
    ("PostToolUse", 5, {"tool_name": "Bash", "tool_use_id": "t1", "tool_input": {"command": "ls"}, "tool_response": {"stdout": "x"}}),
    ("PostToolUse", 9, {"tool_name": "Read", "tool_use_id": "t2", "tool_input": {"file_path": "/a/b.py"}, "tool_response": {}, "duration_ms": 4}),
    ("PostToolUse", 10, {"tool_name": "Grep", "tool_use_id": "t3", "tool_input": {}, "agent_id": "a1", "agent_type": "Explore"}),
    ("PreToolUse", 11, {"tool_name": "Edit", "tool_use_id": "t4", "tool_input": {}}),
    ("SubagentStop", 12, {"agent_id": "a1", "last_assistant_message": "found"}),
    ("PostToolUse", 13, {"tool_name": "Glob", "tool_input": {}}),
    ("Stop", 20, {"last_assistant_message": "done"}),
    ("PostToolUse", 21, {"tool_name": "Edit", "tool_use_id": "t4", "tool_input": {}}),
    ("UserPromptSubmit", 30, {"prompt": "more"}),
    ("SessionEnd", 40, {"reason": "exit"}),
]


def usage(fresh, out, read=0, five=0):
    return {"input_tokens": fresh, "output_tokens": out, "cache_read_input_tokens": read, "cache_creation": {"ephemeral_5m_input_tokens": five}}


def record(kind, ts, message, **more):
    return {"type": kind, "timestamp": ts, "message": message, **more}


def test_hooks_and_transcripts_become_a_tree(spark):
    rows = [
        (2, record("user", 2, {"content": "go"})),
        (3, record("assistant", 3, {"id": "r1", "model": "opus", "content": [{"type": "text", "text": "a"}], "usage": usage(5, 1, 2)})),
        (4, record("assistant", 4, {"id": "r1", "model": "opus", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}], "usage": usage(5, 7, 2, 3)})),
        (6, record("assistant", 6, {"id": "r2", "content": [{"type": "tool_use", "id": "t9", "name": "Write", "input": {"file_path": "/x/y.md"}}], "usage": usage(1, 1)})),
        (7, record("user", 7, {"content": [{"type": "tool_result", "tool_use_id": "t9", "content": "bad", "is_error": True}]})),
        (31, record("user", 31, {"content": "more"})),
        (32, record("assistant", 32, {"id": "r3", "model": "opus", "content": [{"type": "text", "text": "late"}]}, isApiErrorMessage=True, apiErrorStatus=529)),
    ]
    records = spark.createDataFrame([("s", "main", i, ts, json.dumps(r)) for i, (ts, r) in enumerate(rows)], "session_id string, scope string, pos long, ts_ms long, rec string")
    spans = list(folded(claude_ops(table(spark, "claude-code", "s", HOOKS), records)).values())
    by = {r.name: r for r in spans}
    root, one, two, agent = by["Claude Code: project"], by["Turn 1"], by["Turn 2"], by["subagent: Explore"]
    assert (root.start_ms, root.end_ms, one.end_ms, one.output, two.end_ms) == (1, 40, 20, '"done"', 40)
    assert agent.parent_span_ids == [one.span_id] and (agent.end_ms, agent.output) == (12, '"found"')
    bash, read, grep, edit, glob = by["Terminal: ls"], by["Read: b.py"], by["Grep"], by["Edit"], by["Glob"]
    assert (bash.start_ms, bash.end_ms) == (3, 5) and (read.start_ms, read.end_ms) == (5, 9) and grep.parent_span_ids == [agent.span_id]
    assert (edit.end_ms, edit.error) == (20, "Turn ended before tool completion") and glob.metadata["tool_call_id"] == '"1:1"'
    calls = {r.metadata["request_id"]: r for r in spans if r.span_type == "llm"}
    first = calls['"r1"']
    assert (first.start_ms, first.end_ms, first.name) == (3, 4, "opus") and json.loads(first.output)["content"] == "a"
    assert (first.metrics["prompt_tokens"], first.metrics["completion_tokens"], first.metrics["tokens"], first.metrics["prompt_cache_creation_5m_tokens"]) == (10, 7, 17, 3)
    assert calls['"r2"'].name == "claude" and calls['"r3"'].error == "late" and calls['"r3"'].parent_span_ids == [two.span_id]
    write = by["Write: y.md"]
    assert (write.error, write.end_ms, write.metadata["recovered_from_transcript"]) == ("Tool execution failed", 7, "true")
    assert len([r for r in spans if r.span_type == "tool"]) == 6


RECORDS = "session_id string, scope string, pos long, ts_ms long, rec string"


def at(rows, scope="main", session="s"):
    return [(session, scope, i, ts, json.dumps(r)) for i, (ts, r) in enumerate(rows)]


def test_commands_load_skills_that_a_listing_has(spark):
    hooks = [
        ("UserPromptExpansion", 1, {"command_name": "/early", "transcript_path": "/t"}),
        ("UserPromptExpansion", 3, {"command_name": "/fmt;", "transcript_path": "/t"}),
        ("UserPromptExpansion", 4, {"skill_name": "direct", "expansion_type": "slash_command"}),
        ("UserPromptExpansion", 4, {"skill_name": "other", "type": "mention"}),
        ("UserPromptSubmit", 5, {"prompt": "go"}),
        ("UserPromptExpansion", 6, {"skill": {"name": "inner"}}),
        ("UserPromptExpansion", 7, {"slash_command": "fmt", "transcript_path": "/t"}),
        ("UserPromptExpansion", 7, {"slash_command": "fmt"}),
        ("Stop", 8, {}),
        ("UserPromptSubmit", 9, {"prompt": "more"}),
    ]
    records = spark.createDataFrame(at([(2, {"type": "attachment", "attachment": {"names": ["fmt", "lint"]}}), (5, {"attachment": {"names": ["early"]}}), (6, {"version": "2.1"}), (7, {"version": "2.2"})]), RECORDS)
    hosts = spark.createDataFrame([("s", "box", "me", "Linux")], "session_id string, hostname string, username string, os string")
    by = {r.name: r for r in folded(claude_ops(table(spark, "claude-code", "s", hooks), records, hosts=hosts)).values()}
    one = by["Turn 1"].metadata
    # Those named before the prompt, until a merge brings those named in the turn.
    assert json.loads(one["loaded_skill_names"]) == ["inner", "fmt"] and json.loads(one["loaded_skills"]) == [{"name": "inner"}, {"name": "fmt"}]
    assert not by["Turn 2"].metadata
    ops = claude_ops(table(spark, "claude-code", "s", hooks), records).where("op = 'insert' and name = 'Turn 1'").first()
    assert json.loads(ops.metadata["loaded_skill_names"]) == ["fmt", "direct"]
    root = by["Claude Code: workspace"].metadata
    assert (root["claude_code_version"], root["hostname"], root["username"], root["os"]) == ('"2.1"', '"box"', '"me"', '"Linux"')


def test_a_tool_that_only_began_keeps_what_the_first_segment_says(spark):
    began = lambda call: ("PreToolUse", 3, {"tool_name": "Bash", "tool_use_id": call, "tool_input": {"command": call}})
    hooks = [("UserPromptSubmit", 1, {"prompt": "go"}), began("first"), began("second"), ("PermissionDenied", 4, {"tool_name": "Edit", "tool_use_id": "no", "permission": {"id": "p1", "title": "may I"}}), ("PostToolUseFailure", 5, {"tool_name": "Grep", "tool_use_id": "bad", "tool_response": {"output": "why"}}), ("PostToolUseFailure", 6, {"tool_name": "Glob", "tool_use_id": "worse"}), ("StopFailure", 20, {}),
             ("UserPromptSubmit", 30, {"prompt": "more"}), began("third"), ("UserPromptSubmit", 40, {"prompt": "again"})]
    use = lambda n, call: record("assistant", n, {"id": f"r{n}", "content": [{"type": "tool_use", "id": call, "name": "Bash", "input": {"command": f"{call} said"}}]})
    gave = lambda n, call: record("user", n, {"content": [{"type": "tool_result", "tool_use_id": call, "content": f"{call} out"}]})
    rows = [(1, record("user", 1, {"content": "go"})), (7, use(7, "first")), (8, gave(8, "first")), (9, use(9, "second")), (10, gave(10, "second")), (30, record("user", 30, {"content": "more"})), (31, use(31, "third")), (32, gave(32, "third"))]
    spans = list(folded(claude_ops(table(spark, "claude-code", "s", hooks), spark.createDataFrame(at(rows), RECORDS))).values())
    by = {r.name: r for r in spans}
    one, two, three = by["Terminal: first said"], by["Terminal: second"], by["Terminal: third"]
    assert (one.start_ms, one.end_ms, one.error, one.output, one.metadata["recovered_from_transcript"]) == (3, 20, "Turn ended before tool completion", '"first out"', "true")
    assert (two.end_ms, two.error, two.output) == (20, "Turn ended before tool completion", None) and "recovered_from_transcript" not in two.metadata
    # A prompt closes the turn before it without taking its records.
    assert (three.end_ms, three.output) == (40, None)
    assert by["Edit"].error is None and by["Edit"].metadata["permission_id"] == '"p1"' and by["Edit"].metadata["permission_title"] == '"may I"' and by["Edit"].metadata["tool_approval"] == '"denied"'
    assert by["Grep"].error == "why" and by["Glob"].error == "Tool execution failed" and by["Turn 1"].error == "Claude Code turn failed"

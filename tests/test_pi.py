from __future__ import annotations

import json

from events import folded, table
from loomspan.plans.translate.pi import pi_ops

#: Two turns: a retried end, a tool that fails, a branch summary; then a compaction after the last turn.
SESSION = [
    ("before_agent_start", 1000, {"prompt": "/skill:plan, then build"}),
    ("context", 1010, {"messages": [{"role": "user", "content": "build"}]}),
    ("before_provider_request", 1012, {"payload": {"temperature": 0}}),
    ("message_update", 1030, {"assistantMessageEvent": {"type": "thinking_delta"}}),
    ("message_update", 1050, {"assistantMessageEvent": {"type": "text_delta"}}),
    ("message_end", 1100, {"message": {"role": "assistant", "provider": "prov", "model": "asked", "responseModel": "served", "stopReason": "toolUse", "content": [{"type": "text", "text": "step "}, {"type": "text", "text": "one"}, {"type": "toolCall", "id": "t9", "name": "bash", "arguments": {"cmd": "x"}}], "usage": {"input": 40, "output": 9, "cacheRead": 7, "cacheWrite": 2, "reasoning": 3}}}),
    ("tool_execution_start", 1110, {"toolCallId": "t9", "toolName": "bash", "args": {"cmd": "x"}}),
    ("tool_execution_end", 1130, {"toolCallId": "t9", "toolName": "bash", "result": "no such file\nat all", "isError": True}),
    ("agent_end", 1140, {"willRetry": True}),
    ("context", 1150, {}),
    ("message_end", 1170, {"message": {"role": "assistant", "model": "asked", "stopReason": "error", "errorMessage": "cut off", "content": []}}),
    ("agent_end", 1180, {}),
    ("before_agent_start", 2000, {"prompt": "more"}),
    ("session_before_tree", 2010, {"preparation": {"userWantsSummary": True}}),
    ("session_tree", 2020, {"summaryEntry": {"summary": "s"}}),
    ("agent_end", 2100, {}),
    ("session_before_compact", 2200, {}),
    ("session_compact", 2240, {}),
    ("session_shutdown", 3000, {}),
]


def wrapped(events):
    return [(name, ts, {"event": payload}) for name, ts, payload in events]


def test_turns_calls_and_special_spans(spark):
    by = {r.name: r for r in folded(pi_ops(table(spark, "pi", "p1", wrapped(SESSION)))).values()}
    root, one, two, call, again, bash = (by[n] for n in ("Pi", "Turn 1", "Turn 2", "served", "asked", "bash"))
    # Prompt tokens are 40 fresh, 7 read and 2 written; without a total, all are these, 9 and 3.
    assert (call.metrics["prompt_tokens"], call.metrics["tokens"], call.metrics["time_to_first_token"]) == (49, 61, 0.02)
    assert (call.start_ms, call.end_ms, json.loads(call.metadata["stop_reason"])) == (1010, 1100, "toolUse")
    said = json.loads(call.output)[0]
    assert said["content"] == "step one" and said["tool_calls"][0]["id"] == "t9" and json.loads(call.input) == [{"role": "user", "content": "build"}]
    assert (again.start_ms, again.end_ms, again.error) == (1150, 1170, "cut off")
    assert (bash.start_ms, bash.end_ms, bash.error, bash.metadata["tool_outcome"]) == (1110, 1130, "no such file", '"error"') and "skill_name" not in bash.metadata
    assert (one.start_ms, one.end_ms, two.start_ms, two.end_ms) == (1000, 1180, 2000, 2100) and one.metadata["loaded_skill_names"] == '["plan"]'
    assert (by["Branch Summary"].start_ms, by["Branch Summary"].end_ms, by["Compaction"].start_ms, by["Compaction"].end_ms) == (2010, 2020, 2200, 2240)
    assert (root.start_ms, root.end_ms, root.metadata["total_turns"], root.metadata["total_tool_calls"]) == (1000, 3000, "2", "1")
    assert call.parent_span_ids == again.parent_span_ids == bash.parent_span_ids == [one.span_id] and two.parent_span_ids == [root.span_id]


def test_answers_take_the_first_context_and_empty_queues_give_calls_of_no_length(spark):
    say = {"message": {"role": "assistant", "model": "m", "content": []}}
    events = [("before_agent_start", 1, {"prompt": "x"}), ("message_end", 2, say), ("context", 3, {}), ("context", 4, {}), ("message_update", 5, {"type": "text"}), ("message_end", 6, say), ("message_end", 7, say), ("message_end", 8, say)]
    spans = folded(pi_ops(table(spark, "pi", "s", wrapped(events)), finalize=True))
    calls = sorted((r.end_ms, r.start_ms, r.metrics.get("time_to_first_token")) for r in spans.values() if r.span_type == "llm")
    assert calls == [(2, 2, None), (6, 3, None), (7, 4, 0.001), (8, 8, None)]
    assert next(r for r in spans.values() if r.name == "Turn 1").error == "Interrupted before completion"
    assert next(r for r in spans.values() if r.name == "Pi").end_ms == 8


def test_sessions_do_not_touch_one_another(spark):
    one = table(spark, "pi", "a", wrapped(SESSION))
    both = one.unionByName(table(spark, "pi", "b", wrapped(SESSION)))
    mine = {k: v for k, v in folded(pi_ops(both)).items() if v.session_id == "a"}
    assert mine == folded(pi_ops(one))

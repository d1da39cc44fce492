from __future__ import annotations

import json

from events import folded, table
from loomspan.plans.translate.opencode import opencode_ops

def text(sid, words):
    return {"input": {"sessionID": sid, "model": {"modelID": "big"}}, "output": {"parts": [{"type": "text", "text": words}, {"type": "file"}, {"type": "text", "text": "now"}]}}


def answer(sid, mid, begun, done, **more):
    return {"properties": {"info": {"id": mid, "sessionID": sid, "role": "assistant", "providerID": "prov", "modelID": "big", "time": {"created": begun, "completed": done}, **more}}}


#: Two turns: the first uses a skill and a tool that breaks, the second has a refused call; the session fails in the end.
SESSION = [
    ("session.created", 100, {"properties": {"info": {"id": "top"}}}),
    ("chat.message", 110, text("top", "/skills:lint tidy")),
    ("experimental.chat.system.transform", 111, {"input": {"sessionID": "top"}, "output": {"system": ["be", "brief"]}}),
    ("tool.execute.before", 120, {"input": {"sessionID": "top", "callID": "s", "tool": "skill"}, "output": {"args": {"name": "lint"}}}),
    ("tool.execute.after", 125, {"input": {"sessionID": "top", "callID": "s", "tool": "skill"}, "result": {"title": "Lint", "output": "rules"}}),
    ("tool.execute.before", 130, {"input": {"sessionID": "top", "callID": "b", "tool": "bash"}, "output": {"args": {"cmd": "x"}}}),
    ("message.part.updated", 134, {"properties": {"part": {"sessionID": "top", "messageID": "r1", "type": "tool", "callID": "b", "tool": "bash", "state": {"status": "error", "error": "broken\npipe", "input": {"cmd": "x"}}}}}),
    ("tool.execute.after", 135, {"input": {"sessionID": "top", "callID": "b", "tool": "bash"}, "result": {"title": "Run x", "output": "partial"}}),
    ("message.part.updated", 140, {"properties": {"part": {"sessionID": "top", "messageID": "r1", "type": "text", "text": "first answer", "time": {"end": 140}}}}),
    ("message.updated", 141, answer("top", "r1", 112, 139, tokens={"input": 20, "output": 6, "reasoning": 4, "cache": {"read": 10, "write": 1}})),
    ("message.updated", 142, answer("top", "r1", 112, 139)),
    ("session.idle", 150, {"properties": {"sessionID": "top"}}),
    ("chat.message", 160, text("top", "again")),
    ("permission.replied", 165, {"properties": {"sessionID": "top", "callID": "w", "response": "reject", "tool": "write"}}),
    ("tool.execute.after", 166, {"input": {"sessionID": "top", "callID": "w", "tool": "write"}}),
    ("session.error", 180, {"properties": {"sessionID": "top", "error": {"name": "Limit", "data": {"message": "too much"}}}}),
]


def test_turns_tools_and_errors(spark):
    by = {r.name: r for r in folded(opencode_ops(table(spark, "opencode", "s1", SESSION))).values()}
    root, one, two, llm, skill, bash, write = (by[n] for n in ("OpenCode", "Turn 1", "Turn 2", "prov/big", "skill: lint", "Run x", "write"))
    # Prompt tokens are 20 fresh, 10 read and 1 written; all tokens are these, 6 and 4.
    assert (llm.metrics["prompt_tokens"], llm.metrics["tokens"], llm.start_ms, llm.end_ms) == (31, 41, 112, 139)
    assert json.loads(llm.input) == [{"role": "system", "content": "be\n\nbrief"}, {"role": "user", "content": "/skills:lint tidy\nnow"}]
    assert json.loads(llm.output)[0]["tool_calls"][0]["function"] == {"name": "bash", "arguments": '{"cmd":"x"}'}
    assert (one.start_ms, one.end_ms, one.output, one.error) == (110, 150, '"first answer"', None) and json.loads(one.metadata["loaded_skill_names"]) == ["lint"]
    assert (two.start_ms, two.end_ms, two.output) == (160, 180, None) and two.error == root.error == "too much\n\ntype: Limit"
    assert (skill.start_ms, skill.end_ms, skill.metadata["skill_name"], skill.metadata["tool_kind"]) == (120, 125, '"lint"', '"skill"')
    assert (bash.error, bash.metadata["tool_outcome"], bash.output) == ("broken", '"error"', '"partial"') and "skill_name" not in bash.metadata
    assert (write.error, write.start_ms, write.end_ms, write.parent_span_ids) == ("Permission denied", 165, 165, [two.span_id])
    assert (root.start_ms, root.end_ms, root.metadata["total_turns"], root.metadata["total_tool_calls"]) == (100, 180, "2", "3")
    assert {r.root_span_id for r in by.values()} == {root.span_id} and one.parent_span_ids == [root.span_id]


def test_a_chain_of_children_shares_one_root_and_made_circles_end(spark):
    def born(sid, above, title):
        return {"properties": {"info": {"id": sid, "parentID": above, "title": title}}}

    chain = [("session.created", 1, {"properties": {"info": {"id": "n0"}}}), ("chat.message", 2, text("n0", "go"))]
    chain += [("session.created", 10 + i, born(f"n{i}", f"n{i - 1}", f"step {i} (@worker subagent)")) for i in range(1, 8)]
    # b is born below a while a lives, a is born again below b: each life has the parent of its time.
    circle = [("session.created", 50, born("a", "b", "A")), ("session.created", 51, born("b", "a", "B")), ("session.idle", 52, {"properties": {"sessionID": "a"}}), ("session.created", 53, born("a", "b", "A"))]
    by = {(r.session_id, r.name): r for r in folded(opencode_ops(table(spark, "opencode", "chain", chain).unionByName(table(spark, "opencode", "circle", circle)), finalize=True)).values()}
    top = by["chain", "OpenCode"]
    assert {by["chain", f"worker: step {i}"].root_span_id for i in range(1, 8)} == {top.span_id}
    assert by["chain", "worker: step 1"].parent_span_ids == [by["chain", "Turn 1"].span_id] and by["chain", "worker: step 7"].parent_span_ids == []
    assert {name for session, name in by if session == "circle"} == {"A", "B"}

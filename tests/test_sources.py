"""Attachments, the registry of translators, depths of trees."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame

from events import folded, table
from loomspan.plans.spans import depths
from loomspan.plans.translate.attach import attached
from loomspan.plans.translate.debug import debug_ops
from loomspan.plans.translate.sources import translated


GIVEN = "session_id string, source string, parent_span_id string, external_root_id string, project string, additional_metadata map<string,string>"


def test_attachments_follow_their_source(spark):
    ops = debug_ops(reduce(DataFrame.unionByName, (table(spark, "x", s, [("e", 1, {})]) for s in "abcdef")))
    extra = {"team": '"t"', "_bt_route": "1"}
    rows = [("a", "claude-code", "outer", None, "ours", extra), ("b", "claude-code", "outer", "far", None, None), ("c", "opencode", "outer", None, None, extra), ("d", "pi", "outer", None, None, None), ("e", "codex", "outer", "far", "ours", extra), ("f", "unheard", "outer", "far", "ours", extra)]
    spans = {(r.session_id, r.name): r for r in folded(attached(ops, spark.createDataFrame(rows, GIVEN))).values()}
    tops = {s: spans[s, f"x: {s}"] for s in "abcdef"}
    # All but sources without attachments hang below the parent.
    assert {s: r.parent_span_ids for s, r in tops.items()} == {**{s: ["outer"] for s in "abcde"}, "f": []}
    # The root is the given one in Claude and OpenCode, the parent as well in Pi, and stays its own in Codex.
    assert {s: r.root_span_id if r.root_span_id != r.span_id else "own" for s, r in tops.items()} == {"a": "own", "b": "far", "c": "own", "d": "outer", "e": "own", "f": "own"}
    assert all(spans[s, "e"].root_span_id == tops[s].root_span_id and spans[s, "e"].parent_span_ids == [tops[s].span_id] and not spans[s, "e"].metadata for s in tops)
    # Claude drops private keys; the root of Codex names the project.
    assert {s: dict(r.metadata or {}) for s, r in tops.items()} == {"a": {"team": '"t"'}, "b": {}, "c": extra, "d": {}, "e": {**extra, "project": '"ours"'}, "f": {}}


def test_each_source_has_its_plan_and_others_the_debug_plan(spark):
    prompt = ("UserPromptSubmit", 1, {"cwd": "/w"})
    events = reduce(DataFrame.unionByName, [table(spark, "pi", "p", [("before_agent_start", 1, {"event": {"prompt": "x"}})]), table(spark, "unheard", "u", [("e", 1, {})]), table(spark, "claude-code", "c", [prompt]), table(spark, "claude", "d", [("e", 1, {})]), table(spark, "opencode", "o", [("chat.message", 1, {"input": {"sessionID": "n"}, "output": {"parts": []}})]), table(spark, "codex", "k", [("SessionStart", 1, {})])])
    records = spark.createDataFrame([("codex", "k", "main", 0, 1, json.dumps({"type": "session_meta", "payload": {"cwd": "/w/z"}})), ("claude-code", "c", "main", 0, 1, json.dumps({"type": "assistant", "message": {"id": "r", "model": "m", "content": []}}))], "source string, session_id string, scope string, pos long, ts_ms long, rec string")
    plain = {("p", "Pi"), ("p", "Turn 1"), ("u", "unheard: u"), ("u", "e"), ("d", "claude: d"), ("d", "e"), ("c", "Claude Code: w"), ("c", "Turn 1"), ("o", "OpenCode"), ("o", "Turn 1")}
    assert {(r.session_id, r.name) for r in folded(translated(events)).values()} == plain
    assert {(r.session_id, r.name) for r in folded(translated(events, records)).values()} == plain | {("k", "codex: z"), ("c", "m")}


def test_git_metadata_of_hooks(spark):
    git = spark.createDataFrame([("/w", {"git_branch": '"main"', "source": '"git"'}), ("/bare", {})], "cwd string, git map<string,string>")
    events = reduce(DataFrame.unionByName, [
        table(spark, "claude-code", "c", [("UserPromptSubmit", 1, {"cwd": "/bare"}), ("PreToolUse", 2, {"tool_name": "Bash", "tool_use_id": "t", "cwd": "/w"}), ("Stop", 3, {})]),
        table(spark, "pi", "p", [("before_agent_start", 1, {"cwd": "/w", "event": {"prompt": "x"}}), ("session_shutdown", 2, {})]),
        table(spark, "opencode", "o", [("chat.message", 1, {"worktree": "/w", "input": {"sessionID": "n"}, "output": {"parts": []}}), ("session.idle", 2, {"sessionID": "n"})])])
    records = spark.createDataFrame([("claude-code", "c", "main", 0, 1, json.dumps({"type": "assistant", "message": {"id": "r", "model": "m", "content": []}}))], "source string, session_id string, scope string, pos long, ts_ms long, rec string")
    got = {(r.session_id, r.name): dict(r.metadata or {}) for r in folded(translated(events, records, git)).values()}
    has = {k for k, m in got.items() if m.get("git_branch") == '"main"'}
    assert has == {("c", "Terminal: command"), ("c", "m"), ("p", "Pi"), ("p", "Turn 1"), ("o", "OpenCode"), ("o", "Turn 1")}
    assert got["o", "OpenCode"]["source"] == got["p", "Pi"]["source"] == '"git"'


def test_depths_of_long_chains_and_circles(spark):
    chain = [(1, i, i - 1 if i else None) for i in range(1000)]
    rest = [(2, 1, 2), (2, 2, 1), (2, 3, 1), (2, 4, 99), (2, 5, 4)]
    got = {(r.k, r.n): r.depth for r in depths(spark.createDataFrame(chain + rest, "k long, n long, p long"), ["k"], "n", "p").collect()}
    assert got == {(1, i): i + 1 for i in range(1000)} | {(2, 4): 1, (2, 5): 2}

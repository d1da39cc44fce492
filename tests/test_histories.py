"""Shared histories against those written out in plain Python."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
from test_codex import EVENTS, RECORDS, SESSIONS, item, msg, rec, said

from loomspan.operators import histories as H
from loomspan.plans.translate.codex import codex_inputs, codex_ops

ROWS = "s string, pos long, item string"


def test_pieces_give_each_call_all_that_came_before_it(spark):
    r = random.Random(3)
    texts = ["", "x", "é" * 9, "b" * 40, "long" * 60, None]
    rows = [(s, r.randrange(n), r.choice(texts)) for s, n in (("a", 60), ("b", 7), ("c", 1)) for _ in range(n)]
    items = H.numbered(spark.createDataFrame(rows, ROWS), "item", ["s"], ["pos"], piece=50)
    # Calls at any place, two at the same one, and with nothing before them.
    calls = [(s, k, k) for s in "abc" for k in range(70)] + [("a", 9, 99), ("none", 1, 1)]
    got = {}
    for row in H.pieces(spark.createDataFrame(calls, "s string, items_before long, call long"), items, "item", ["s"], spread=4).collect():
        got.setdefault((row.s, row.call), []).append(row)
    for s, before, call in calls:
        mine = [x for _, x in sorted((p, x) for t, p, x in rows if t == s and x is not None)]
        if not 0 < before <= len(mine):
            assert (s, call) not in got
            continue
        parts = sorted(got[s, call], key=lambda x: x.piece)
        assert ",".join(x.text for x in parts) == ",".join(mine[:before])
        assert sum(x.n_items for x in parts) == before and len({x.piece for x in parts}) == len(parts)
        # No piece is longer than its bound and one item.
        assert all(len(x.text.replace(",", "").encode()) < 50 + 240 for x in parts)


def test_prefixes_tell_how_far_sessions_agree(spark):
    rows = [(s, i, x) for s, xs in {"one": "abcd", "fork": "abce", "late": "ab", "other": "bacd", "same": "abcd"}.items() for i, x in enumerate(xs)]
    items = H.numbered(spark.createDataFrame(rows, ROWS), "item", ["s"], ["pos"])
    assert {r.s: (r.shared_items, r.sharers) for r in H.shared_prefixes(items, ["s"]).collect()} == {"one": (4, 2), "same": (4, 2), "fork": (3, 3), "late": (2, 4)}
    assert H.numbered(spark.createDataFrame([], ROWS), "item", ["s"], ["pos"]).count() == 0


def test_row_groups_stay_small_however_long_a_history_is(spark, tmp_path):
    n, size = 256, 8 * 1024
    rows = [("s", i, f"{i:04d}" + "x" * (size - 4)) for i in range(n)]
    items = H.numbered(spark.createDataFrame(rows, ROWS), "item", ["s"], ["pos"])
    calls = spark.createDataFrame([("s", k) for k in range(1, n + 1)], "s string, items_before long")
    H.written(H.pieces(calls, items, "item", ["s"]), str(tmp_path / "out"))
    groups, told = [], 0
    for file in (tmp_path / "out").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += [meta.row_group(g).total_byte_size for g in range(meta.num_row_groups)]
        told += sum(pq.read_table(file, columns=["n_items"])["n_items"].to_pylist())
    assert max(groups) < 40 * 1024 * 1024 and told == n * (n + 1) // 2


def test_calls_of_codex_have_the_same_input_in_pieces_as_whole(spark):
    names = ["compacted", "one", "spawned"]
    long = [msg("task_started", 1, turn_id="L")] + [x for i in range(20) for x in (said(2 + i, "y" * i, "user"), said(2 + i, f"n{i}"), item("function_call", 2 + i, call_id=f"k{i}", name="t", arguments="{}"), msg("token_count", 2 + i, info={"last_token_usage": {"input_tokens": i}}))] + [rec("compacted", 40, replacement_history=[{"role": "user", "content": "kept"}, {"z": [1]}]), said(41, "after"), msg("token_count", 42)]
    sessions = {n: SESSIONS[n][0] for n in names} | {"long": {"main": long}}
    records = spark.createDataFrame([(n, scope, i, at, r) for n, scopes in sessions.items() for scope, rows in scopes.items() for i, (at, r) in enumerate(rows)], RECORDS)
    events = spark.createDataFrame([], EVENTS)
    whole = {r.span_id: r.input for r in codex_ops(events, records, histories=True).where("op = 'insert' and span_type = 'llm'").collect()}
    pieces = {}
    for r in codex_inputs(events, records, piece=100).collect():
        pieces.setdefault(r.span_id, []).append((r.piece, r.text))
    assert set(pieces) <= set(whole) and max(map(len, pieces.values())) > 10
    for span, given in whole.items():
        told = "[" + ",".join(x for _, x in sorted(pieces.get(span, []))) + "]"
        assert given == told or given.startswith('{"messages_before_compaction":') and given.endswith(f'"history":{told}}}')

from __future__ import annotations

import json

from events import folded, table
from loomspan.operators import sinks
from loomspan.plans.translate.debug import debug_ops
from loomspan.sources import files
from loomspan.streaming import live

EVENTS = [("start", 5, {"a": 1}), ("step", 7, {"b": "é"}), ("stop", 9, None)]


def test_transcripts_have_places_offsets_and_monotone_cutoffs(spark, tmp_path):
    stamp = "2024-01-01T00:00:0{}Z"
    rows = [{"timestamp": stamp.format(k), "sessionId": "s1", "n": n} for n, k in enumerate((1, 5, 2, 7))]
    text = "\n".join([json.dumps(rows[0]), "", "not json", *map(json.dumps, rows[1:])]) + "\n"
    (tmp_path / "s1.jsonl").write_text(text)
    got = files.records(spark, str(tmp_path)).orderBy("pos").collect()
    assert [json.loads(r.rec)["n"] for r in got] == [0, 1, 2, 3] and [r.pos for r in got] == [0, 3, 4, 5]
    assert got[-1].end_offset == len(text.encode()) and got[0].file == "s1.jsonl"
    base = 1_704_067_200_000
    assert files.records(spark, str(tmp_path), cutoff_ms=base + 4000).count() == 1  # the third is early but comes after a late one
    assert files.records(spark, str(tmp_path), through=got[2].end_offset).count() == 3
    assert [(r.session_id, r.files) for r in files.sessions(files.records(spark, str(tmp_path))).collect()] == [("s1", 1)]


def test_a_journal_ends_before_its_first_broken_line(spark, tmp_path):
    line = {"source": "pi", "session_id": "s", "event": "e", "ts_ms": 3, "payload": {"x": [1]}, "route": {"b": 1, "a": 2}}
    (tmp_path / "s.ndjson").write_text("\n".join([json.dumps(line), json.dumps(line), "{broken", json.dumps(line)]) + "\n")
    got = files.journal(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.session_id, r.ts_ms, r.payload) for r in got] == [(1, "s", 3, '{"x":[1]}'), (2, "s", 3, '{"x":[1]}')]
    assert sinks.deliveries(files.journal(spark, str(tmp_path))).select("route_key").distinct().count() == 1


def test_debug_lines(spark, tmp_path):
    sinks.write_debug(debug_ops(table(spark, "pi", "s", EVENTS)), str(tmp_path / "out"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(rows) == 4 and all(list(r) == ["Insert"] for r in rows)
    assert {r["Insert"]["name"] for r in rows} == {"pi: s", "start", "step", "stop"}


def test_live_spans_are_those_of_a_batch_and_a_rerun_changes_nothing(spark, tmp_path):
    whole = table(spark, "pi", "a", EVENTS).unionByName(table(spark, "pi", "b", EVENTS[:2]))
    want = folded(debug_ops(whole))
    landing, store = tmp_path / "in", tmp_path / "store"
    for k, part in enumerate(("seq = 1", "seq > 1", "session_id = 'a'")):
        whole.where(part).coalesce(1).write.mode("append").json(str(landing / str(k)))
        query = live.keep_spans(live.landed(spark, f"{landing}/*"), debug_ops, f"{store}/events", f"{store}/spans", f"{store}/checkpoint")
        query.awaitTermination()
    assert {r.span_id: r for r in live.current(spark, f"{store}/spans").select(*next(iter(want.values())).__fields__).collect()} == want


def test_tables_stored_in_a_scope_go_with_it(spark):
    import os

    from loomspan.operators import tables

    folder = tables.shared_dir(spark)
    before = set(os.listdir(folder))
    kept = tables.stored(spark.range(3))
    with tables.scope(spark):
        outer = tables.stored(spark.range(4))
        with tables.scope(spark):
            assert tables.stored(outer).count() == 4
        assert outer.count() == 4
    assert len(set(os.listdir(folder)) - before) == 1 and kept.count() == 3

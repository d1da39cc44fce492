"""Schemas of JSON, rows written by hand, journals and their replay, whitelists, retention, activity."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from events import table
from loomspan.operators import routing, schemas, sinks
from loomspan.plans.logs import manual_rows
from loomspan.sources import files
from loomspan.streaming import live


def test_types_by_path(spark):
    docs = ['{"a": 1, "b": {"c": [1, 2.5, null]}, "m": "x"}', '{"a": null, "b": {"c": []}, "m": 2}', '{"b": {"c": [[true]]}, "deep": {"x": {"y": {"z": [{"w": "v"}]}}}}', "7", "null", "{broken", None, ""]
    got = {r.path: (r.type, r.n, r.nulls, r.kinds) for r in schemas.inferred(spark.createDataFrame([(d,) for d in docs], "d string"), F.col("d")).collect()}
    assert got == {
        "$": ("mixed", 7, 1, ["null", "integer", "object", "broken"]), "a": ("integer", 2, 1, ["null", "integer"]), "b": ("object", 3, 0, ["object"]), "b.c": ("array", 3, 0, ["array"]), "b.c[]": ("mixed", 4, 1, ["null", "integer", "number", "array"]),
        "b.c[][]": ("boolean", 1, 0, ["boolean"]), "m": ("mixed", 2, 0, ["integer", "string"]), "deep": ("object", 1, 0, ["object"]), "deep.x": ("object", 1, 0, ["object"]), "deep.x.y": ("object", 1, 0, ["object"]),
        "deep.x.y.z": ("array", 1, 0, ["array"]), "deep.x.y.z[]": ("object", 1, 0, ["object"]), "deep.x.y.z[].w": ("string", 1, 0, ["string"]),
    }
    assert schemas.inferred(spark.createDataFrame([], "d string"), F.col("d")).count() == 0


def test_rows_written_by_hand_say_what_is_wrong(spark):
    rows = spark.createDataFrame([("a", " x, ,y ", '{"q": 0.5}', '{"k": "v"}', "", "out"), ("b", "", "{bad", "", "in", None), ("c", None, "", "nope", None, None)], "id string, tags string, scores string, metadata string, input string, output string")
    got = {r.id: r for r in manual_rows(rows).collect()}
    assert (got["a"].tags, got["a"].scores, got["a"].metadata, got["a"].input, got["a"].output, got["a"].problem) == (["x", "y"], {"q": 0.5}, {"k": "v"}, None, "out", None)
    assert got["b"].problem == "Error: scores must be valid JSON" and got["c"].problem == "Error: metadata must be valid JSON" and got["b"].span_id == got["b"].root_span_id == "b"


def test_replay_of_a_route_gives_what_was_journaled_for_it_before_the_mark(spark, tmp_path):
    line = lambda n, session, route: json.dumps({"source": "pi", "session_id": session, "event": f"e{n}", "ts_ms": n, "payload": {"n": n}, **({"route": route} if route else {})}) + "\n"
    text = "".join([line(1, "s", {"a": 1, "b": [2]}), line(2, "t", {"a": 1, "b": [2]}), line(3, "s", None), line(4, "s", {"b": [2], "a": 1}), line(5, "s", {"a": 2})])
    (tmp_path / "j.ndjson").write_text(text)
    mark = len(text.encode())
    with (tmp_path / "j.ndjson").open("a") as f:
        f.write(line(6, "s", {"a": 1, "b": [2]}))
    told = lambda route, through=mark: [(r.seq, r.event) for r in files.replay(spark, str(tmp_path), "s", route, through).orderBy("seq").collect()]
    assert told('{"b":[2],"a":1}') == [(1, "e1"), (2, "e4")] and told('{"a": 2}') == [(1, "e5")] and told(None) == [(1, "e3")] and told('{"a": 3}') == []
    assert told('{"a":1,"b":[2]}', mark + 1000) == [(1, "e1"), (2, "e4"), (3, "e6")] and told('{"a":1,"b":[2]}', 10) == []


def test_journals_hold_no_credentials_and_whitelists_let_pass_what_they_name(spark, tmp_path):
    rows = table(spark, "pi", "s", [("chat.message", 1, {}), ("session.created", 2, {}), ("file.edited", 3, {}), ("tool.execute.after", 4, {})]).withColumns({"config": F.lit("{}"), "token": F.lit("secret")})
    sinks.append_journal(rows, str(tmp_path / "j"))
    sinks.append_journal(rows.limit(1), str(tmp_path / "j"))
    kept = spark.read.parquet(str(tmp_path / "j"))
    assert kept.count() == 5 and not {"config", "token"} & set(kept.columns)
    assert sorted(r.event for r in routing.from_opencode(rows).collect()) == ["chat.message", "session.created", "tool.execute.after"]
    day = 86_400_000
    old = spark.createDataFrame([("a", 0), ("b", day), ("c", 3 * day)], "path string, mtime_ms long")
    assert [r.path for r in sinks.expired(old, 8 * day).collect()] == ["a"] and sinks.expired(old, 8 * day, days=5).count() == 2


def test_streams_without_repetitions_and_stretches_of_activity(spark, tmp_path):
    at = 1_700_000_000_000
    rows = spark.createDataFrame([("s", 1, at), ("s", 1, at), ("s", 2, at + 1000), ("s", 3, at + 500_000), ("t", 1, at + 400)], "session_id string, seq long, ts_ms long")
    rows.coalesce(1).write.json(str(tmp_path / "in"))

    def run(make, name):
        out = str(tmp_path / name)
        q = make(spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out)

    once = run(lambda s: live.first_of(s.withColumn("time", F.timestamp_millis("ts_ms")), ["session_id", "seq"], "time", "1 hour"), "once")
    assert once.count() == 4
    stretches = run(lambda s: live.active(s), "active").collect()
    # A stretch is told when it can't go on: the last, at 500 s, still may.
    assert sorted((r.session_id, r.events) for r in stretches) == [("s", 3), ("t", 1)]

"""The stateful live path: machines against the batch plans, order, restarts, routes, bounded memories, versions."""

from __future__ import annotations

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from events import table
from loomspan.operators import upserts
from loomspan.operators.spans import fold
from loomspan.plans.translate.debug import debug_ops
from loomspan.plans.translate.opencode import opencode_ops
from loomspan.plans.translate.pi import pi_ops
from loomspan.streaming import live, machines, recent, stateful
from test_opencode import SESSION as OPENCODE
from test_opencode import answer, text
from test_pi import SESSION, wrapped

SCHEMA = live.LANDED + ", route string"


def parsed(r):
    """A span with its JSON texts read, without the number of its operations."""
    out = {k: v for k, v in r.asDict().items() if k not in ("n_ops", "route_key")}
    read = lambda t: None if t is None else json.loads(t)
    return out | {"input": read(out["input"]), "output": read(out["output"]), "metadata": {k: read(v) for k, v in (out["metadata"] or {}).items()}, "metrics": out["metrics"] or None}


def spans(rows):
    return {(r.asDict().get("route_key"), r.session_id, r.span_id): parsed(r) for r in rows}


def made(source, session, events, finish=False):
    kind = machines.MACHINES.get(source, machines.Debug)
    state, ops = None, []
    for seq, (name, ts, payload) in enumerate(events, 1):
        machine = kind(session, state)
        ops += machine.on(seq, source, name, ts, json.dumps(payload), None)
        state = json.loads(json.dumps(machine.state))
    return ops + (kind(session, state).finish(len(events)) if finish else [])


def random_pi(r):
    say = lambda **m: {"message": {"role": r.choice(["assistant", "assistant", "user"]), "model": r.choice(["m", None]), "content": r.choice([[], [{"type": "text", "text": "a"}, {"type": "thinking", "thinking": "b"}, {"type": "toolCall", "id": "1", "name": "n", "arguments": {"x": 1}}]]), "usage": {"input": r.randint(0, 9), "output": 2, "cost": r.choice([0.5, {"total": 1}])}, **m}}
    call = lambda: r.choice(["c1", "c2"])
    choices = [
        lambda: ("before_agent_start", {"prompt": r.choice(["go /skill:a, /skill:b", "x", ""])}), lambda: ("context", r.choice([{}, {"messages": [{"role": "user"}]}])), lambda: ("before_provider_request", {"p": r.randint(0, 5)}),
        lambda: ("message_update", {"assistantMessageEvent": {"type": r.choice(["text_delta", "start"])}}), lambda: ("message_end", say()), lambda: ("message_end", say(stopReason="error", errorMessage="bad")), lambda: ("tool_execution_start", {"toolCallId": call(), "toolName": "read", "args": {"path": r.choice(["/s/plan/SKILL.md", "/x"])}}),
        lambda: ("tool_execution_end", {"toolCallId": call(), "toolName": "t", "result": r.choice(["one\ntwo", {"error": "e"}, {"v": 1}]), "isError": r.choice([True, False])}), lambda: ("agent_end", {"willRetry": r.choice([True, False])}), lambda: ("thinking_level_select", {"level": r.choice(["high", None])}),
        lambda: ("session_before_compact", {}), lambda: ("session_compact", {"k": 1}), lambda: ("session_before_tree", {"preparation": {"userWantsSummary": r.choice([True, False])}}), lambda: ("session_tree", r.choice([{}, {"summaryEntry": {"s": 1}}])), lambda: ("session_shutdown", {}) if r.random() < 0.3 else ("other", {}),
    ]
    return [(name, 1000 + 10 * i + r.randint(0, 5), payload) for i, (name, payload) in enumerate(r.choice(choices)() for _ in range(60))]


def test_the_machine_of_pi_says_what_the_batch_plan_says(spark):
    r = random.Random(8)
    sessions = {"given": wrapped(SESSION), **{f"s{i}": [(n, t, {"event": p}) for n, t, p in random_pi(r)] for i in range(12)}}
    every = None
    for name, events in sessions.items():
        t = table(spark, "pi", name, events)
        every = t if every is None else every.unionByName(t)
    ops = [o | {"session_id": s} for s, events in sessions.items() for o in made("pi", s, events, finish=True)]
    schema = spark.createDataFrame([], stateful.OPS).schema
    mine = spark.createDataFrame([{c: o.get(c) for c in schema.names} for o in ops], schema)
    assert spans(fold(mine).collect()) == spans(fold(pi_ops(every, finalize=True)).collect())


def random_opencode(r):
    """Two native sessions at the top and children of the first, created before anything else is said of them."""
    sid, call, mid = lambda: r.choice(["t0", "t0", "t1", "c0", "c1"]), lambda: r.choice(["k0", "k1"]), lambda: r.choice(["m0", "m1"])
    where = lambda **more: {"input": {"sessionID": sid(), "callID": call(), "tool": r.choice(["bash", "skill"])}, **more}
    born = lambda s, above: ("session.created", {"properties": {"info": {"id": s, "title": r.choice(["dig (@mole subagent)", "plain"])} | ({"parentID": above} if above else {})}})
    part = lambda **more: ("message.part.updated", {"properties": {"part": {"sessionID": sid(), "messageID": mid(), **more}}})
    tool = lambda **more: part(type="tool", callID=call(), tool="bash", state=more)
    choices = [
        lambda: ("chat.message", text(sid(), r.choice(["/skills:lint, go", "/skillsx. and", ""]))), lambda: ("experimental.chat.system.transform", {"input": {"sessionID": sid()}, "output": {"system": ["a", "b"]}}),
        lambda: ("tool.execute.before", where(output={"args": r.choice([{"name": "lint"}, {"cmd": 1}])})), lambda: ("tool.execute.after", where(result=r.choice([{"title": "T", "output": "o"}, {"output": [1]}, {}]))),
        lambda: tool(status="completed", output="done", input={"x": r.randint(0, 3)}), lambda: tool(status="error", error=r.choice(["bad\nworse", {"name": "E", "message": "m"}, {"data": {"message": "d"}}])), lambda: tool(status="running"),
        lambda: part(type="text", text=r.choice(["half", "full"]), **r.choice([{}, {"time": {"end": 5}}])), lambda: part(type="reasoning", text="hm"),
        lambda: ("message.updated", answer(sid(), mid(), 5, r.choice([None, 9]), tokens={"input": r.randint(0, 9), "output": 2, "cache": {"read": 1}})), lambda: ("message.updated", answer(sid(), mid(), 6, 8, error={"name": "Slow"})),
        lambda: ("permission.replied", {"properties": {"sessionID": sid(), "id": call(), "response": r.choice(["reject", "once"]), "tool": "write"}}),
        lambda: ("session.idle", {"properties": {"sessionID": sid()}}) if r.random() < 0.5 else ("chat.message", text(sid(), "more")), lambda: (r.choice(["session.deleted", "session.error"]), {"properties": {"sessionID": sid(), "error": r.choice([{"name": "Limit"}, "short"])}}) if r.random() < 0.3 else ("other", {}),
        lambda: born(*r.choice([("c0", "t0"), ("c1", "c0"), ("t1", None)])) if r.random() < 0.5 else ("chat.message", text(sid(), "still")),
    ]
    first = [born("t0", None), ("chat.message", text("t0", "go")), born("c0", "t0"), born("c1", "c0"), born("t1", None)]
    return [(name, 1000 + 10 * i + r.randint(0, 5), payload) for i, (name, payload) in enumerate([*first, *(r.choice(choices)() for _ in range(90))])]


def test_the_machine_of_opencode_says_what_the_batch_plan_says(spark):
    r = random.Random(5)
    sessions = {"given": OPENCODE, **{f"s{i}": random_opencode(r) for i in range(12)}}
    every = None
    for name, events in sessions.items():
        t = table(spark, "opencode", name, events)
        every = t if every is None else every.unionByName(t)
    ops = [o | {"session_id": s} for s, events in sessions.items() for o in made("opencode", s, events, finish=True)]
    schema = spark.createDataFrame([], stateful.OPS).schema
    got = spans(fold(spark.createDataFrame([{c: o.get(c) for c in schema.names} for o in ops], schema)).collect())
    want = spans(fold(opencode_ops(every, finalize=True)).collect())
    print([(k[1], want[k]["name"], want[k]["span_type"], want[k]["start_ms"]) for k in set(want) - set(got)][:12], [(k[1], got[k]["name"]) for k in set(got) - set(want)][:5])
    print([{c: (got[k][c], want[k][c]) for c in got[k] if got[k][c] != want[k][c]} for k in set(got) & set(want) if got[k] != want[k]][:5])
    assert set(got) == set(want)
    assert [(got[k], want[k]) for k in got if got[k] != want[k]][:1] == []


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_live_operations_are_those_of_a_batch_whatever_the_order_of_landing(rocks, tmp_path):
    spark = rocks
    whole = table(spark, "pi", "a", wrapped(SESSION)).unionByName(table(spark, "pi", "b", wrapped(SESSION)[:8])).unionByName(table(spark, "odd", "c", [("x", 5, {"v": 1}), ("y", 7, {}), ("z", 9, {})])).unionByName(table(spark, "opencode", "d", OPENCODE))
    routes = {"a": ['{"p":1}'], "b": ['{"p":1}', '{"q": [2], "p": 1}'], "c": [None], "d": ['{"p":1}']}
    rows = [(*r, route) for r in whole.collect() for route in routes[r.session_id]]
    # Four landings out of order, with repetitions; each is a run of its own, as after a restart.

    parts = [[x for x in rows if zlib.crc32(str(x[1:3]).encode()) % 4 == k] for k in (2, 0, 3, 1)]
    parts[3] += parts[1]
    landing, store = tmp_path / "in", str(tmp_path / "store")
    for k, part in enumerate(parts):
        if not part:
            continue
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(landing / str(k)))
        stream = spark.readStream.schema(SCHEMA).json(f"{landing}/*")
        live.keep_operations(stream, f"{store}/table", f"{store}/check", buckets=4).awaitTermination()
    got = spans(upserts.current(spark, f"{store}/table").collect())
    want = {}
    for r in fold(pi_ops(whole.where("source = 'pi'"))).collect() + fold(debug_ops(whole.where("source = 'odd'"))).collect() + fold(opencode_ops(whole.where("source = 'opencode'"))).collect():
        for route in routes[r.session_id]:
            want[json.dumps(json.loads(route), separators=(",", ":"), sort_keys=True) if route else "{}", r.session_id, r.span_id] = parsed(r)
    assert got == want
    # A flush closes what is open.
    keys = spark.createDataFrame([("b", '{"p":1}')], "session_id string, route_key string")
    closing = stateful.flushes(keys).select(*live.LANDED_COLUMNS, F.col("route_key").alias("route"))
    closing.coalesce(1).write.mode("append").json(str(landing / "9"))
    live.keep_operations(spark.readStream.schema(SCHEMA).json(f"{landing}/*"), f"{store}/table", f"{store}/check", buckets=4).awaitTermination()
    after = {(r.route_key, r.name): r for r in upserts.current(spark, f"{store}/table").where("session_id = 'b'").collect()}
    assert after['{"p":1}', "Turn 1"].error == "Interrupted before completion" and after['{"p":1}', "Pi"].end_ms == 1130
    assert [r.end_ms for (route, name), r in after.items() if "q" in route and name == "Pi"] == [None]


def test_lost_numbers_hold_up_only_so_many_events(rocks, tmp_path):
    spark = rocks
    rows = [("odd", "s", k, "e", k, "{}", None, "{}") for k in (1, 3, 4, 5, 6)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    q = live.keep_operations(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), patient=3, buckets=2)
    q.awaitTermination()
    assert sorted(r.start_ms for r in upserts.current(spark, str(tmp_path / "t")).where("span_type = 'tool'").collect()) == [1, 3, 4, 5, 6]


def test_reads_stay_as_large_over_fifty_batches_and_batches_that_come_again_change_nothing(spark, tmp_path):
    folder, files = str(tmp_path / "t"), []
    none = spark.createDataFrame([], stateful.OPS)
    for batch in range(50):
        ops = spark.createDataFrame([(f"s{batch % 3}", batch, "insert" if batch < 3 else "merge", f"x{batch % 3}", f"n{batch}")], "session_id string, op_seq long, op string, span_id string, name string")
        ops = none.unionByName(ops, allowMissingColumns=True)
        upserts.put(ops, folder, batch, buckets=2, most=5)
        if batch % 10 == 9:
            upserts.put(ops.withColumn("name", F.lit("again")), folder, batch, buckets=2, most=5)
            files.append(len(upserts.operations(spark, folder).inputFiles()))
    assert max(files) <= 2 * 5 * 4
    got = {r.span_id: (r.name, r.n_ops) for r in upserts.current(spark, folder).collect()}
    assert got == {"x0": ("n48", 17), "x1": ("n49", 17), "x2": ("n47", 16)}
    upserts.put(none, folder, 50, buckets=2)
    assert upserts.current(spark, folder).count() == 3


def test_memories_are_bounded_and_forget_the_oldest(rocks, tmp_path):
    ids, values = recent.RecentSet(), recent.RecentMap()
    assert all(ids.add(str(i)) for i in range(5000)) and not ids.add("4999") and not ids.add("904") and ids.add("903")
    for i in range(4096):
        values.put(str(i), "a")
    values.put("0", "b")
    values.put("new", "c")
    # The map makes a key young that is put again; the set doesn't.
    assert (values.get("0"), values.get("1"), values.get("2")) == ("b", None, "a") and len(values.values) == recent.CAPACITY
    spark = rocks
    rows = [("g", i, str(i), f"v{i}" if i % 2 else None) for i in range(6)] + [("g", 6, "0", None), ("g", 7, "5", None), ("h", 8, "5", None), ("g", 9, None, None), ("g", 10, "1", None)]
    spark.createDataFrame(rows, "k string, seq long, id string, v string").coalesce(1).write.json(str(tmp_path / "in"))

    def run(make, name):
        out = str(tmp_path / name)
        stream = spark.readStream.schema("k string, seq long, id string, v string").json(str(tmp_path / "in"))
        make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).orderBy("seq").collect()

    first = run(lambda s: recent.first_seen(s, ["k"], "id", "seq", capacity=3), "first")
    assert [r.seq for r in first] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]  # id 5 is still known, 0 and 1 are not
    known = run(lambda s: recent.last_known(s, ["k"], "id", "v", "seq", "had", capacity=2), "known")
    assert {r.seq: r.had for r in known} == {0: None, 1: "v1", 2: None, 3: "v3", 4: None, 5: "v5", 6: None, 7: "v5", 8: None, 9: None, 10: None}

"""Queries on ordered events and transcripts of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sinks
from ..operators import turns as T
from ..sources.stand_ins import ENV, TRX, envelopes, table, transcripts
from .registry import query

CALL = ["session_id", "call_id"]


def prompt() -> Column:
    return F.col("event") == "UserPromptSubmit"


def stop() -> Column:
    return F.col("event") == "Stop"


def starts() -> Column:
    return F.col("event") == "PreToolUse"


def stops() -> Column:
    return F.col("event").isin("PostToolUse", "PostToolUseFailure")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.open_turns(T.number_turns(envelopes(spark, sf_dir), prompt()), prompt(), stop())


TURNS = """t AS (SELECT *, sum(CASE WHEN event = 'UserPromptSubmit' THEN 1 ELSE 0 END) OVER w AS turn FROM env WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
o AS (SELECT *, last_value(CASE WHEN event = 'UserPromptSubmit' THEN turn WHEN event = 'Stop' THEN -1 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mark FROM t),
turns AS (SELECT *, CASE WHEN mark > 0 THEN mark END AS open_turn FROM o)"""


@query(f"WITH {ENV}, {TURNS} SELECT session_id, seq, event, turn::BIGINT AS turn FROM turns")
def turn_numbering(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "seq", "event", "turn")


@query(f"WITH {ENV}, {TURNS} SELECT session_id, seq, event, open_turn::BIGINT AS open_turn FROM turns")
def turn_assignment(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "seq", "event", "open_turn")


PAIRS = """a AS (SELECT session_id, call_id, arg_min(ts_ms, seq) AS start_ms, min(seq) AS start_seq FROM env WHERE event = 'PreToolUse' GROUP BY ALL),
p AS (SELECT a.session_id, a.call_id, start_ms, arg_min(e.ts_ms, e.seq) FILTER (e.seq > start_seq) AS end_ms, arg_min(e.event, e.seq) FILTER (e.seq > start_seq) AS stop
  FROM a LEFT JOIN (SELECT * FROM env WHERE event IN ('PostToolUse', 'PostToolUseFailure')) e ON e.session_id = a.session_id AND e.call_id = a.call_id GROUP BY ALL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir)
    return T.pair_tools(e.where(starts()), e.where(stops()), CALL)


@query(f"WITH {ENV}, {PAIRS} SELECT session_id, call_id, start_ms, end_ms, stop, end_ms - start_ms AS duration_ms FROM p")
def tool_pairing(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


@query(f"""WITH {ENV}, a AS (SELECT session_id, call_id, arg_min(ts_ms, seq) AS pre_ms FROM env WHERE event = 'PreToolUse' GROUP BY ALL),
b AS (SELECT session_id, call_id, arg_min(ts_ms, seq) AS end_ms, arg_min(floor(value)::BIGINT, seq) AS d FROM env WHERE event IN ('PostToolUse', 'PostToolUseFailure') GROUP BY ALL)
SELECT session_id, call_id, end_ms, coalesce(pre_ms, greatest(0, end_ms - d)) AS start_ms FROM a FULL JOIN b USING (session_id, call_id)""")
def tool_outer_pairing(spark, sf_dir):
    e = envelopes(spark, sf_dir)
    return T.outer_pair_tools(e.where(starts()), e.where(stops()), CALL, F.floor("value").cast("long"))


@query(f"""WITH {ENV}, {PAIRS}, l AS (SELECT session_id, max(ts_ms) AS last_ms FROM env GROUP BY 1)
SELECT session_id, call_id, start_ms, last_ms AS end_ms, 'Tool output missing before turn ended' AS error FROM p JOIN l USING (session_id) WHERE end_ms IS NULL""")
def dangling_tools(spark, sf_dir):
    """Calls without a stop end with their owner."""
    ends = envelopes(spark, sf_dir).groupBy("session_id").agg(F.max("ts_ms").alias("end_ms"))
    return _pairs(spark, sf_dir).where("end_ms is null").select(*CALL, "start_ms").join(ends, "session_id").withColumn("error", F.lit("Tool output missing before turn ended"))


@query(f"""WITH {ENV} SELECT session_id, call_id, seq, ts_ms FROM env e WHERE event = 'PostToolUse'
AND NOT EXISTS (SELECT 1 FROM env d WHERE d.event = 'PostToolUseFailure' AND d.session_id = e.session_id AND d.call_id = e.call_id)""")
def denied_anti(spark, sf_dir):
    """Stops of calls that were never denied."""
    e = envelopes(spark, sf_dir)
    return e.where("event = 'PostToolUse'").join(e.where("event = 'PostToolUseFailure'"), CALL, "left_anti").select(*CALL, "seq", "ts_ms")


@query(f"""WITH {ENV}, {TURNS} SELECT session_id, count(*) FILTER (event = 'UserPromptSubmit') AS total_turns, count(*) FILTER (event IN ('PostToolUse', 'PostToolUseFailure') AND open_turn IS NOT NULL) AS total_tool_calls,
min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM turns GROUP BY session_id""")
def root_totals(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("session_id").agg(F.count_if(prompt()).alias("total_turns"), F.count_if(stops() & F.col("open_turn").isNotNull()).alias("total_tool_calls"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))


@query(f"""WITH {ENV} SELECT DISTINCT session_id, call_id, true AS recovered FROM env e WHERE event = 'PostToolUse' AND NOT EXISTS (SELECT 1 FROM env d WHERE d.event = 'PreToolUse' AND d.session_id = e.session_id AND d.call_id = e.call_id)""")
def recovered_tools(spark, sf_dir):
    """Calls that only the transcript knows."""
    e = envelopes(spark, sf_dir)
    return e.where("event = 'PostToolUse'").select(*CALL).distinct().join(e.where(starts()), CALL, "left_anti").withColumn("recovered", F.lit(True))


@query(f"""WITH {ENV}, live AS (SELECT session_id, count(*) AS events, max(ts_ms) AS last_ms, arg_max(event, seq) FILTER (event = 'PostToolUseFailure') AS last_error FROM env WHERE event <> 'Stop' GROUP BY 1),
failed AS (SELECT DISTINCT 'u' || user_id AS session_id FROM events WHERE event_type = 'signup')
SELECT session_id, events, last_ms, last_error, true AS live FROM live UNION ALL SELECT session_id, 0, NULL, 'not authorised', false FROM failed WHERE session_id NOT IN (SELECT session_id FROM live)""")
def status_view(spark, sf_dir):
    e = envelopes(spark, sf_dir)
    live = e.where(~stop()).groupBy("session_id").agg(F.count("*").alias("events"), F.max("ts_ms").alias("last_ms"), F.max_by("event", F.when(F.col("event") == "PostToolUseFailure", F.col("seq"))).alias("last_error"), F.lit(True).alias("live"))
    failed = e.where(stop()).select("session_id").distinct()
    return sinks.status(live, failed.select("session_id", F.lit(0).cast("long").alias("events"), F.lit("not authorised").alias("last_error"), F.lit(False).alias("live")))


@query(f"""WITH {ENV}, {TURNS} SELECT session_id, open_turn::BIGINT AS turn, min(ts_ms) FILTER (event = 'UserPromptSubmit') AS start_ms, min(ts_ms) FILTER (event = 'PreToolUse') AS first_ms,
round((min(ts_ms) FILTER (event = 'PreToolUse') - min(ts_ms) FILTER (event = 'UserPromptSubmit')) / 1000.0, 3) AS seconds FROM turns WHERE open_turn IS NOT NULL GROUP BY 1, 2""")
def first_token(spark, sf_dir):
    t = _turns(spark, sf_dir).where("open_turn is not null").groupBy("session_id", F.col("open_turn").alias("turn")).agg(F.min(F.when(prompt(), F.col("ts_ms"))).alias("start_ms"), F.min(F.when(starts(), F.col("ts_ms"))).alias("first_ms"))
    return t.withColumn("seconds", F.round((F.col("first_ms") - F.col("start_ms")) / 1000, 3))


@query(f"""WITH {ENV}, {TURNS}, c AS (SELECT session_id, open_turn AS turn, seq, event, ts_ms, max(CASE WHEN event IN ('PostToolUse', 'PostToolUseFailure') THEN ts_ms END) OVER (PARTITION BY session_id, open_turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_end,
min(CASE WHEN event = 'UserPromptSubmit' THEN ts_ms END) OVER (PARTITION BY session_id, open_turn) AS turn_ms FROM turns WHERE open_turn IS NOT NULL)
SELECT session_id, turn::BIGINT AS turn, seq, coalesce(last_end, turn_ms) AS start_ms, row_number() OVER (PARTITION BY session_id, turn ORDER BY seq) AS llm FROM c WHERE event = 'PreToolUse'""")
def child_end_running_max(spark, sf_dir):
    """A call starts when the child before it ended, or with its turn."""
    t = _turns(spark, sf_dir).where("open_turn is not null")
    last = F.max(F.when(stops(), F.col("ts_ms"))).over(T.before("seq", "session_id", "open_turn"))
    turn = F.min(F.when(prompt(), F.col("ts_ms"))).over(Window.partitionBy("session_id", "open_turn"))
    c = t.withColumn("start_ms", F.coalesce(last, turn)).where(starts())
    return c.select("session_id", F.col("open_turn").alias("turn"), "seq", "start_ms", F.row_number().over(T.ordered("seq", "session_id", "open_turn")).cast("long").alias("llm"))


@query(f"""WITH {TRX}, h AS (SELECT *, list(role || ':' || length(text)) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM trx)
SELECT session_id, pos, coalesce(array_to_string(h, ' '), '') AS history, coalesce(len(h), 0)::BIGINT AS messages FROM h WHERE role = 'assistant'""")
def history_snapshot(spark, sf_dir):
    """What each model call had before it."""
    h = T.history(transcripts(spark, sf_dir).withColumn("item", F.concat_ws(":", "role", F.length("text").cast("string"))), "item")
    return h.where("role = 'assistant'").select("session_id", "pos", F.array_join("history", " ").alias("history"), F.size("history").cast("long").alias("messages"))


@query(f"""WITH {TRX}, h AS (SELECT *, min(pos) OVER w AS history_from, max(pos) OVER w AS history_to FROM trx WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, pos, history_from, history_to FROM h WHERE role = 'assistant'""")
def history_references(spark, sf_dir):
    """The same as ranges of the transcript, of a size that doesn't grow with it."""
    return T.history_ranges(transcripts(spark, sf_dir)).where("role = 'assistant'").select("session_id", "pos", "history_from", "history_to")


@query(f"""WITH {TRX}, r AS (SELECT session_id, 'm' || (pos // 3) AS request_id, pos, text FROM trx WHERE role = 'assistant'), f AS (SELECT session_id, request_id, text, min(pos) AS p FROM r GROUP BY ALL)
SELECT session_id, request_id, max(n) AS completion_tokens, max(last) AS last_pos, max(texts) AS texts FROM (
SELECT session_id, request_id, max(length(text)) AS n, max(pos) AS last, NULL AS texts FROM r GROUP BY ALL UNION ALL SELECT session_id, request_id, NULL, NULL, string_agg(md5(text), ',' ORDER BY p) FROM f GROUP BY ALL) GROUP BY ALL""")
def chunk_grouping(spark, sf_dir):
    """Streamed chunks with one request id are one call: largest counts, last place, distinct texts in order."""
    r = transcripts(spark, sf_dir).where("role = 'assistant'").withColumn("request_id", F.concat(F.lit("m"), F.floor(F.col("pos") / 3).cast("string")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.md5(x.text))
    return r.groupBy("session_id", "request_id").agg(F.max(F.length("text")).cast("long").alias("completion_tokens"), F.max("pos").alias("last_pos"), F.array_join(F.array_distinct(parts), ",").alias("texts"))


@query(f"""WITH {TRX}, s AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY session_id ORDER BY pos) AS segment FROM trx)
SELECT session_id, segment, min(pos) AS first_pos, max(pos) FILTER (role IN ('user', 'assistant')) AS last_pos, count(*) AS records FROM s WHERE segment > 0 GROUP BY 1, 2""")
def turn_segments(spark, sf_dir):
    """Transcript turns: from one user record to before the next; the end ignores bookkeeping."""
    s = transcripts(spark, sf_dir).withColumn("segment", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(T.up_to("pos")).cast("long")).where("segment > 0")
    return s.groupBy("session_id", "segment").agg(F.min("pos").alias("first_pos"), F.max(F.when(F.col("role").isin("user", "assistant"), F.col("pos"))).alias("last_pos"), F.count("*").alias("records"))


@query(f"""WITH {ENV}, s AS (SELECT *, ts_ms + floor(value)::BIGINT * 60000 AS t FROM env), c AS (SELECT session_id, min(ts_ms) + (max(ts_ms) - min(ts_ms)) // 2 AS cutoff FROM env GROUP BY 1),
m AS (SELECT *, max(t) OVER (PARTITION BY session_id ORDER BY seq) AS m FROM s) SELECT session_id, count(*) AS consumed, max(seq) AS last_seq FROM m JOIN c USING (session_id) WHERE m <= cutoff GROUP BY 1""")
def monotone_cutoff(spark, sf_dir):
    """Records are consumed up to the first beyond the cutoff, though times aren't in order."""
    e = envelopes(spark, sf_dir)
    cut = F.min("ts_ms") + F.floor((F.max("ts_ms") - F.min("ts_ms")) / 2)
    e2 = e.withColumn("ts_ms", F.col("ts_ms") + F.floor("value").cast("long") * 60000).join(e.groupBy("session_id").agg(cut.alias("cutoff")), "session_id")
    return T.cut_at(e2, F.col("cutoff"), "seq", "session_id").groupBy("session_id").agg(F.count("*").alias("consumed"), F.max("seq").alias("last_seq"))


@query(f"""WITH {TRX}, u AS (SELECT session_id, max(pos) FILTER (role = 'user') AS cut FROM trx GROUP BY 1)
SELECT session_id, count(*) FILTER (cut IS NULL OR pos < cut) AS late, count(*) FILTER (pos >= cut) AS current FROM trx JOIN u USING (session_id) GROUP BY 1""")
def late_rows_split(spark, sf_dir):
    """Buffered rows before the last user record belong to the turn before."""
    t = transcripts(spark, sf_dir)
    at = F.max(F.when(F.col("role") == "user", F.col("pos"))).over(Window.partitionBy("session_id"))
    t = t.withColumn("at", at)
    return t.groupBy("session_id").agg(F.count_if(F.col("at").isNull() | (F.col("pos") < F.col("at"))).alias("late"), F.count_if(F.col("pos") >= F.col("at")).alias("current"))


@query(f"""WITH {ENV}, f AS (SELECT session_id, event, min(seq) AS s FROM env GROUP BY ALL) SELECT session_id, string_agg(event, ',' ORDER BY s) AS events FROM f GROUP BY 1""")
def ordered_distinct(spark, sf_dir):
    f = envelopes(spark, sf_dir).groupBy("session_id", "event").agg(F.min("seq").alias("s"))
    return f.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("s", "event")))["event"], ",").alias("events"))


@query(f"WITH {ENV} SELECT session_id, call_id, min(seq) AS seq, arg_min(event, seq) AS event FROM env GROUP BY 1, 2")
def request_dedup(spark, sf_dir):
    """The first event of each id; later ones are repetitions."""
    return T.first_by(envelopes(spark, sf_dir), CALL).select(*CALL, "seq", "event")


@query(f"""WITH {ENV}, b AS (SELECT session_id, min(ts_ms) AS lo, max(ts_ms) AS hi FROM env GROUP BY 1)
SELECT DISTINCT session_id, ts_ms FROM env JOIN b USING (session_id) WHERE event = 'Stop' AND ts_ms > lo AND ts_ms < hi""")
def checkpoints(spark, sf_dir):
    """Times of stops strictly inside a session, each once."""
    e = envelopes(spark, sf_dir)
    b = e.groupBy("session_id").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    return e.where(stop()).join(b, "session_id").where("ts_ms > lo and ts_ms < hi").select("session_id", "ts_ms").distinct()


@query(f"""WITH {ENV}, s AS (SELECT session_id, call_id, seq, row_number() OVER (PARTITION BY session_id, call_id ORDER BY seq) AS n FROM env WHERE event = 'PreToolUse'),
e AS (SELECT session_id, call_id, seq AS end_seq, row_number() OVER (PARTITION BY session_id, call_id ORDER BY seq) AS n FROM env WHERE event = 'PostToolUse')
SELECT session_id, call_id, n, seq, end_seq FROM s FULL JOIN e USING (session_id, call_id, n)""")
def fifo_pairing(spark, sf_dir):
    """The n-th open request belongs to the n-th answer."""
    e = envelopes(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy(*CALL).orderBy("seq")).cast("long")
    a = e.where(starts()).select(*CALL, "seq", n.alias("n"))
    b = e.where("event = 'PostToolUse'").select(*CALL, F.col("seq").alias("end_seq"), n.alias("n"))
    return a.join(b, [*CALL, "n"], "full").select(*CALL, "n", "seq", "end_seq")


@query(f"""WITH {ENV}, {TURNS}, spawn AS (SELECT session_id, call_id, arg_min(open_turn, seq) AS turn FROM turns WHERE event = 'PreToolUse' AND open_turn IS NOT NULL GROUP BY ALL),
child AS (SELECT session_id, call_id, 'agent-' || arg_min(seq, seq) AS agent_id FROM env WHERE event = 'PostToolUse' GROUP BY ALL)
SELECT session_id, agent_id, coalesce('turn:' || turn, 'root') AS parent FROM child LEFT JOIN spawn USING (session_id, call_id)""")
def spawn_chain(spark, sf_dir):
    """A subagent hangs below the turn whose call spawned it, else below the root."""
    t = _turns(spark, sf_dir)
    spawn = t.where(starts() & F.col("open_turn").isNotNull()).groupBy(*CALL).agg(F.min_by("open_turn", "seq").alias("turn"))
    child = t.where("event = 'PostToolUse'").groupBy(*CALL).agg(F.concat(F.lit("agent-"), F.min("seq").cast("string")).alias("agent_id"))
    return child.join(spawn, CALL, "left").select("session_id", "agent_id", F.coalesce(F.concat(F.lit("turn:"), F.col("turn").cast("string")), F.lit("root")).alias("parent"))


@query(f"""WITH {ENV}, b AS (SELECT session_id, min(ts_ms) AS lo, max(ts_ms) AS hi FROM env GROUP BY 1)
SELECT session_id, 'SessionStart' AS event, lo - 1 AS ts_ms FROM b UNION ALL SELECT session_id, event, ts_ms FROM env UNION ALL SELECT session_id, 'SessionEnd', hi + 1 FROM b""")
def import_union(spark, sf_dir):
    """An imported session: its records between a start and an end made from their times."""
    e = envelopes(spark, sf_dir)
    b = e.groupBy("session_id").agg((F.min("ts_ms") - 1).alias("lo"), (F.max("ts_ms") + 1).alias("hi"))
    ends = b.select("session_id", F.inline(F.array(F.struct(F.lit("SessionStart").alias("event"), F.col("lo").alias("ts_ms")), F.struct(F.lit("SessionEnd").alias("event"), F.col("hi").alias("ts_ms")))))
    return e.select("session_id", "event", "ts_ms").unionByName(ends)


@query(f"""WITH {TRX} SELECT session_id, route, count(*) AS queued, count(DISTINCT role) AS roles, bool_and(length(text) > 0) AS flushed FROM trx GROUP BY 1, 2""")
def route_fanout(spark, sf_dir):
    """Delivery by session and route."""
    return transcripts(spark, sf_dir).groupBy("session_id", "route").agg(F.count("*").alias("queued"), F.count_distinct("role").alias("roles"), F.bool_and(F.length("text") > 0).alias("flushed"))


@query(f"""WITH {TRX} SELECT session_id, pos, sum(strlen(text) + 1) OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS end_offset FROM trx""")
def transcript_offsets(spark, sf_dir):
    """Where each record's line ends in its transcript, in bytes."""
    return transcripts(spark, sf_dir).select("session_id", "pos", F.sum(F.octet_length("text") + 1).over(T.up_to("pos")).cast("long").alias("end_offset"))


@query(f"""WITH {ENV}, b AS (SELECT session_id, max(ts_ms) AS mtime FROM env GROUP BY 1), n AS (SELECT max(mtime) AS now FROM b)
SELECT session_id, mtime FROM b, n WHERE mtime < now - 6 * 3600000""")
def retention(spark, sf_dir):
    """Journals untouched for six hours before the newest (in production, seven days)."""
    b = envelopes(spark, sf_dir).groupBy("session_id").agg(F.max("ts_ms").alias("mtime_ms"))
    return sinks.expired(b, b.agg(F.max("mtime_ms")).scalar(), days=0.25).select("session_id", F.col("mtime_ms").alias("mtime"))


@query(f"""WITH {ENV} SELECT DISTINCT call_id FROM env WHERE event = 'PreToolUse' EXCEPT SELECT call_id FROM env WHERE event = 'PostToolUseFailure' AND value > 150""")
def id_difference(spark, sf_dir):
    e = envelopes(spark, sf_dir)
    return e.where(starts()).select("call_id").distinct().join(e.where("event = 'PostToolUseFailure' and value > 150"), "call_id", "left_anti")


@query(f"""WITH {ENV} SELECT DISTINCT session_id, json_object('project', 'p' || (length(session_id) % 3))::VARCHAR AS route FROM env""")
def managed_runs(spark, sf_dir):
    """One row for each session and route, by the text of the line."""
    e = envelopes(spark, sf_dir).select("session_id", F.to_json(F.struct(F.concat(F.lit("p"), (F.length("session_id") % 3).cast("string")).alias("project"))).alias("route"))
    return e.distinct()


@query(f"""WITH {ENV}, {TURNS}, k AS (SELECT session_id, call_id, arg_min(turn, seq) AS own FROM turns WHERE event = 'PreToolUse' GROUP BY ALL)
SELECT t.session_id, t.seq, coalesce(own, open_turn)::BIGINT AS turn FROM turns t LEFT JOIN k ON k.session_id = t.session_id AND k.call_id = t.call_id WHERE event = 'PostToolUse'""")
def turn_correlation(spark, sf_dir):
    """A late completion finds the turn of its id; without one it belongs to the latest open turn."""
    t = _turns(spark, sf_dir)
    own = t.where(starts()).groupBy(*CALL).agg(F.min_by("turn", "seq").alias("own"))
    return t.where("event = 'PostToolUse'").join(own, CALL, "left").select("session_id", "seq", F.coalesce("own", "open_turn").alias("turn"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 <= 1800000 THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS events FROM g GROUP BY user_id, n""")
def idle_gaps(spark, sf_dir):
    """Stretches of a session without half an hour of silence."""
    e = table(spark, sf_dir, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) > 1_800_000, F.lit(True))
    g = e.withColumn("new", gap.cast("int")).withColumn("n", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("user_id", "n").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("events")).drop("n")

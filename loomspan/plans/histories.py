"""Shared histories over the driver's tables read as transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histories as H
from ..operators.tables import stored
from ..sources.stand_ins import TRX, span_sql, transcripts
from .registry import query
from .translate.codex import codex_inputs
from .translated import codex_records

#: Bytes of a piece here, so that these short transcripts have several.
SMALL = 1024
#: Items as text and numbered; digests as running exclusive ors.
ITEMS = f"""{TRX}, i AS (SELECT session_id, pos, role, {{item}} AS item FROM trx),
n AS (SELECT *, row_number() OVER w - 1 AS item_no, sum(strlen(item)) OVER w - strlen(item) AS bytes_before FROM i WHERE item IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY pos, item ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, md5(item_no || ':' || item) AS d FROM n),
x AS (SELECT *, printf('%015x', bit_xor(('0x' || substr(d, 1, 15))::BIGINT) OVER w) || printf('%015x', bit_xor(('0x' || substr(d, 16, 15))::BIGINT) OVER w) AS prefix FROM m WINDOW w AS (PARTITION BY session_id ORDER BY item_no ROWS UNBOUNDED PRECEDING))"""
SAID, SIZED = "role || ':' || text", "role || ':' || length(text) // 64"


def _items(spark: SparkSession, sf_dir: str, sized: bool = False) -> DataFrame:
    what = F.floor(F.length("text") / 64).cast("string") if sized else F.col("text")
    rows = transcripts(spark, sf_dir).select("session_id", "pos", "role", F.concat("role", F.lit(":"), what).alias("item"))
    return H.numbered(rows, "item", ["session_id"], ["pos"], SMALL)


@query(f"WITH {ITEMS.format(item=SAID)} SELECT session_id, pos, item_no, bytes_before::BIGINT AS bytes_before, (bytes_before // {SMALL})::BIGINT AS block, prefix FROM x")
def history_digests(spark, sf_dir):
    """Where each record stands in its session's history, and a digest of all up to it."""
    return _items(spark, sf_dir).select("session_id", "pos", "item_no", "bytes_before", "block", "prefix")


@query(f"""WITH {ITEMS.format(item=SAID)} SELECT c.session_id, c.pos, (n.bytes_before // {SMALL})::BIGINT AS piece, count(*) AS n_items, md5(string_agg(n.item, ',' ORDER BY n.item_no)) AS text_md5
FROM n c JOIN n ON n.session_id = c.session_id AND n.item_no < c.item_no WHERE c.role = 'assistant' GROUP BY ALL""")
def history_pieces(spark, sf_dir):
    """What each assistant record had before it, in pieces of bounded size."""
    items = stored(_items(spark, sf_dir))
    calls = items.where("role = 'assistant'").select("session_id", "pos", F.col("item_no").alias("items_before"))
    return H.pieces(calls, items, "item", ["session_id"]).select("session_id", "pos", "piece", "n_items", F.md5("text").alias("text_md5"))


@query(f"""WITH {ITEMS.format(item=SIZED)}, k AS (SELECT prefix, count(*) AS sharers FROM x GROUP BY 1 HAVING count(*) > 1)
SELECT session_id, max(item_no) + 1 AS shared_items, arg_max(sharers, item_no) AS sharers FROM x JOIN k USING (prefix) GROUP BY 1""")
def history_forks(spark, sf_dir):
    """How many first records a session has in common, by role and size, with others, and with how many."""
    return H.shared_prefixes(stored(_items(spark, sf_dir, sized=True)), ["session_id"])


CALLED = f"""WITH {TRX}, q AS (SELECT *, max(CASE WHEN role = 'user' THEN pos END) OVER w AS u, coalesce(sum(CASE WHEN role = 'assistant' THEN 2 + (text <> '')::INT END) OVER v, 0) AS past
FROM trx WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY pos), v AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, row_number() OVER (PARTITION BY session_id, u ORDER BY pos) AS k FROM q WHERE role = 'assistant' AND u IS NOT NULL),
b AS (SELECT session_id, u, 2 * k - 2 AS nth, past FROM a UNION ALL SELECT session_id, u, 2 * k - 1, past + 2 FROM a WHERE text <> '')
SELECT session_id, {span_sql("session_id", "'llm:t' || u || ':' || nth")} AS span_id, past::BIGINT AS items_before, past::BIGINT AS n_items FROM b WHERE past > 0"""


@query(CALLED)
def codex_histories(spark, sf_dir):
    """How many items each model call of Codex was given, by its number and by its pieces."""
    events = spark.createDataFrame([], "session_id string, seq long, event string, ts_ms long, payload string")
    told = codex_inputs(events, codex_records(spark, sf_dir), SMALL)
    return told.groupBy("session_id", "span_id", "items_before").agg(F.sum("n_items").alias("n_items"))

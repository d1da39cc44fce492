"""OpenCode sessions with children, tools, parts of messages and errors, over the driver's tables read as agent events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .translate.opencode import opencode_ops
from .translated import ASKED, _asked, _id, _row, _spans

NONE = ", NULL::VARCHAR AS output, NULL::VARCHAR AS outcome, top"
#: A child is born below the open turn, if there is one; else it is the top of its own tree.
NESTED = f"""{ASKED.format(late=0)}, d AS (SELECT session_id, min(u) * 1000 AS s, 'session:' || session_id AS top FROM n GROUP BY 1 HAVING min(u) IS NOT NULL),
t AS (SELECT *, 'session:' || session_id AS top FROM g),
c AS (SELECT *, 'session:' || session_id || '-' || pos AS born, 'turn:' || session_id || '-' || pos || ':1' AS asks, length(text) % 3 = 0 AS broke, 'session:' || session_id || CASE WHEN u IS NULL THEN '-' || pos ELSE '' END AS top FROM n WHERE role = 'assistant')
SELECT * EXCLUDE (top) REPLACE ({_id("top")} AS root_span_id) FROM (
SELECT {_row("'session:' || session_id", "'OpenCode'", "task", "s", "NULL", "1", None, more=NONE)} FROM d
UNION ALL SELECT {_row("'turn:' || session_id || ':' || turn::BIGINT", "'Turn ' || turn::BIGINT", "task", "pos * 1000", "next * 1000", "CASE WHEN next IS NULL THEN 1 ELSE 2 END", "'session:' || session_id", more=NONE)} FROM t
UNION ALL SELECT * REPLACE (CASE WHEN name <> 'Subagent' THEN parent_span_id END AS parent_span_id) FROM (
SELECT {_row("born", "CASE WHEN u IS NULL THEN 'Subagent' ELSE 'mole: dig ' || pos END", "task", "pos * 1000", "pos * 1000 + 6", "2", "'turn:' || session_id || ':' || turn::BIGINT", more=NONE)} FROM c)
UNION ALL SELECT {_row("asks", "'Turn 1'", "task", "pos * 1000 + 1", "pos * 1000 + 6", "2", "born", more=''', '"said ' || pos || '"' AS output, NULL::VARCHAR AS outcome, top''')} FROM c
UNION ALL SELECT {_row("'tool:' || session_id || '-' || pos || ':k' || pos", "'bash'", "tool", "pos * 1000 + 2", "pos * 1000 + 4", "1", "asks", "CASE WHEN broke THEN 'no ' || pos END", ''', CASE WHEN broke THEN '1' ELSE '"done"' END AS output, CASE WHEN broke THEN '"error"' ELSE '"success"' END AS outcome, top''')} FROM c)"""


@query(NESTED)
def opencode_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of an assistant is a child session that is created, asked, uses a tool, which breaks or is done, says something and falls idle."""
    sid, pos = F.col("session_id"), F.col("pos").cast("string")
    child, broke = F.concat(sid, F.lit("-"), pos), F.length("text") % 3 == 0

    def of(*fields, **more):
        return F.struct(*fields, *(v.alias(k) for k, v in more.items()))

    def part(**more):
        return of(properties=of(part=of(sessionID=child, **more)))

    call = of(sessionID=child, callID=F.concat(F.lit("k"), pos), tool=F.lit("bash"))
    state = of(status=F.when(broke, "error").otherwise("completed"), error=F.when(broke, F.concat(F.lit("no "), pos, F.lit("\nmore"))), output=F.when(~broke, F.lit("done")))
    ask = lambda s: of(input=of(sessionID=s), output=of(parts=F.array(of(type=F.lit("text"), text=F.col("text")))))
    events = _asked(spark, sf_dir, [("chat.message", ask(sid))], [
        ("session.created", of(properties=of(info=of(id=child, parentID=sid, title=F.concat(F.lit("dig "), pos, F.lit(" (@mole subagent)")))))),
        ("chat.message", ask(child)),
        ("tool.execute.before", of(input=call, output=of(args=of(cmd=F.lit("x"))))),
        ("message.part.updated", part(type=F.lit("tool"), callID=F.concat(F.lit("k"), pos), state=state)),
        ("tool.execute.after", of(input=call, result=of(output=F.lit(1)))),
        ("message.part.updated", part(type=F.lit("text"), text=F.concat(F.lit("said "), pos), time=of(end=F.lit(1)))),
        ("session.idle", of(properties=of(sessionID=child))),
    ])
    return _spans(opencode_ops(events), "output", F.col("metadata")["tool_outcome"].alias("outcome"))

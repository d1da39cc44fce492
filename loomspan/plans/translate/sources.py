"""Which plan translates the events of which source; events of other sources are spans of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attach import CLAUDE, CODEX, OPENCODE, PI
from .claude import claude_ops
from .codex import codex_ops
from .debug import debug_ops
from .opencode import opencode_ops
from .pi import pi_ops

RECORDS = "session_id string, scope string, pos long, ts_ms long, rec string"


def translated(events: DataFrame, records: DataFrame | None = None, git: DataFrame | None = None, finalize: bool = False) -> DataFrame:
    """Span operations of events of any sources, each by its own plan, the others by the debug plan.

    records: transcript records with their source; without any, hooks alone are translated. git: what is known of folders. finalize closes what is still open.
    """
    every = events.sparkSession.createDataFrame([], f"source string, {RECORDS}") if records is None else records

    def of(name: str, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("source") == name)

    parts = [
        claude_ops(of(CLAUDE, events), None if records is None else of(CLAUDE, every).drop("source"), git),
        codex_ops(of(CODEX, events), of(CODEX, every).drop("source"), git, finalize=finalize),
        opencode_ops(of(OPENCODE, events), finalize, git),
        pi_ops(of(PI, events), finalize, git),
        debug_ops(events.where(~F.coalesce(F.col("source").isin(CLAUDE, CODEX, OPENCODE, PI), F.lit(False)))),
    ]
    return reduce(DataFrame.unionByName, parts)

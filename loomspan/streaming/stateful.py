"""Span operations of a stream of events, made one event at a time by session and route.

Each key keeps the number of the next event, the state of its machine, and events that came before their turn. An event whose number was handled is a repetition and is left out; one that
is early waits, so that operations are always made in the order of numbers, whatever order events land in. More than PATIENT waiting events mean that one was lost: the first of them goes on.
An event named FLUSH closes what is open, after all that waits.

State is that of open turns and of waiting events, not of a session's past.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..operators.spans import OPS
from .machines import MACHINES, Debug
from .recent import _Kept

PATIENT = 4_096
FLUSH = "__flush__"
KEY = ["session_id", "route_key"]
_COLUMNS = [c.split(" ", 1)[0] for c in OPS.split(", ")]


class Translating(_Kept):
    def __init__(self, patient: int = PATIENT):
        self.patient = patient

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        session, route = key
        held = self.load() or {"next": 1, "source": None, "machine": None, "waiting": {}}
        waiting, flush = held["waiting"], False
        for r in rows:
            if r["event"] == FLUSH:
                flush = True
            elif r["seq"] >= held["next"]:
                waiting.setdefault(str(r["seq"]), [r["source"], r["event"], r["ts_ms"], r["payload"], r["source_version"]])
                if held["source"] is None:
                    held["source"] = r["source"]
        machine = MACHINES.get(held["source"], Debug)(session, held["machine"])
        while waiting:
            at = held["next"] if str(held["next"]) in waiting else min(map(int, waiting)) if flush or len(waiting) > self.patient else None
            if at is None:
                break
            yield from self._rows(session, route, machine.on(at, *waiting.pop(str(at))))
            held["next"] = at + 1
        if flush:
            yield from self._rows(session, route, machine.finish(held["next"] - 1))
        held["machine"] = machine.state
        self.save(held)

    @staticmethod
    def _rows(session: str, route: str, ops: list[dict]) -> Iterator[Row]:
        for o in ops:
            yield Row(**{c: {"session_id": session, "route_key": route}.get(c, o.get(c)) for c in _COLUMNS})


def translated(events: DataFrame, patient: int = PATIENT) -> DataFrame:
    """A stream of span operations. events: source, session_id, route_key, seq (from 1 in each session and route), event, ts_ms, payload, source_version."""
    return events.groupBy(*KEY).transformWithState(Translating(patient), OPS, "append", "none")


def flushes(sessions: DataFrame) -> DataFrame:
    """Events that close what the sessions (session_id, route_key) have open."""
    none = F.lit(None)
    return sessions.select(none.cast("string").alias("source"), *KEY, F.lit(0).cast("long").alias("seq"), F.lit(FLUSH).alias("event"), none.cast("long").alias("ts_ms"), none.cast("string").alias("payload"), none.cast("string").alias("source_version"))

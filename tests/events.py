"""Small event tables for the tests."""

from __future__ import annotations

import json

from loomspan.operators.spans import fold

SCHEMA = "source string, session_id string, seq long, event string, ts_ms long, payload string, source_version string"


def table(spark, source, session, events):
    rows = [(source, session, i + 1, name, ts, json.dumps(payload), None) for i, (name, ts, payload) in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA)


def folded(ops):
    return {r.span_id: r for r in fold(ops.cache()).collect()}

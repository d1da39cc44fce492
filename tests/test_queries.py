"""The registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: All queries outside the subpackage for training data that have SQL; the operators' are held against it in their own tests.
CHOSEN = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d", n) and n != "pipeline")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", CHOSEN)
def test_a_query_gives_what_its_sql_gives(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    got = entry.queries()[name](spark, FOLDER)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_log_dialect():
    from loomspan.plans.logs import facade

    assert facade("SELECT day(created), count() FROM logs WHERE output = 'day(x) count()'") == "SELECT date_trunc('DAY', created), count(*) FROM logs WHERE output = 'day(x) count()'"

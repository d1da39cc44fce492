from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text, and columns with awkward names)."""

    def make(rows, kind="doc_id long, text string, n_tokens string, k1 string, score string"):
        return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], kind)

    return make

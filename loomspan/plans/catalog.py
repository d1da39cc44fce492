"""All registered queries and their SQL."""

from __future__ import annotations

from . import histories, imported, imports, logs, nested, scalar_queries, sessions, spans, translated  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""Deterministic span ids: version 5 UUIDs as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name spaces of span ids and of mirror file names (fixed values).
SPANS = "8f2b4e119c7a4d3eb6a15f0c2d8471ae"
MIRRORS = "3d519a027c644b8f9e17a2c50d6388f1"
SEPARATOR = "\x1f"


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a name space (32 hex digits)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    marked = F.overlay(F.overlay(h, F.lit("5"), 13, 1), F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), 17, 1)
    return F.regexp_replace(marked, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")


def span_id(session: Column, key: Column) -> Column:
    return uuid5(SPANS, F.concat(session, F.lit(SEPARATOR), key))


def file_name(name: Column) -> Column:
    """A name with what isn't a letter, digit, underscore or hyphen replaced by underscores."""
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def mirror_name(session: Column, path: Column) -> Column:
    """The file that mirrors a transcript for a session: 32 hex digits, `.jsonl`."""
    return F.concat(F.replace(uuid5(MIRRORS, F.concat(session, F.lit(SEPARATOR), path)), F.lit("-"), F.lit("")), F.lit(".jsonl"))


def uuid5_sql(name: str, namespace: str = MIRRORS) -> str:
    """SQL of a version 5 UUID without hyphens."""
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    return f"(substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || substr('89ab89ab89ab89ab', ('0x' || substr({h}, 17, 1))::INT + 1, 1) || substr({h}, 18, 15))"

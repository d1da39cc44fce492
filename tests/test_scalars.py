from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomspan.functions import ids
from loomspan.functions import scalars as S


def values(spark, function, rows):
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, v string")
    return [r.x for r in table.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_ids_are_version_5_uuids(spark):
    space = uuid.UUID(ids.SPANS)
    assert values(spark, lambda v: ids.span_id(F.lit("s"), v), ["root", "é", ""]) == [str(uuid.uuid5(space, f"s\x1f{k}")) for k in ("root", "é", "")]


def test_names_of_paths(spark):
    assert values(spark, S.base_name, ["/tmp/project", r"C:\Users\agent\project", "C:\\Users\\agent\\project\\\\"]) == ["project"] * 3
    assert values(spark, S.workspace_name, ["/a/b", "/", "", None]) == ["b", "workspace", "workspace", "workspace"]
    assert values(spark, S.redact_url, ["https://me:pw@host/x@y", "https://host/a@b", "git@host:x"]) == ["https://host/x@y", "https://host/a@b", "git@host:x"]


def test_errors_of_outputs(spark):
    docs = ['{"is_error": true, "message": "bad\\nmore"}', '{"status": "failed"}', '{"error": "oops"}', '{"exit_code": 2}', '{"exitCode": 0}', '"Error: x\\ny"', '"Exit code 3"', '"Exit code 0"', "[1]", None, '{"error": {"message": "deep"}}']
    assert values(spark, S.output_error, docs) == ["bad", "Tool execution failed", "oops", "Exit code 2", None, "Error: x", "Exit code 3", None, None, None, "deep"]


def test_skills_that_prompts_name(spark):
    text = "use $one, then /skills two and skill://three.x; 'a/four/SKILL.md' <skill name=\"five\">b</skill> $one"
    assert values(spark, S.mentioned_skills, [text, "none"]) == [["one", "two", "three.x", "four", "five"], []]
    assert values(spark, lambda v: S.prefixed_skills(v, "/skills:", "/skills"), ["/skills:a, /skillsb) /skill:c"]) == [["a", "b"]]


def test_three_ways_to_read_strings(spark):
    docs = ['{"a": ""}', '{"a": 5}', '{"a": "x"}', '{"a": null}', "broken"]
    assert values(spark, lambda v: S.text_at(v, "a"), docs) == ["", None, "x", None, None]
    assert values(spark, lambda v: S.text_or_number_at(v, "a"), docs) == [None, "5", "x", None, None]

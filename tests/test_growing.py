"""Growing, shrinking and split files: as blocks, as a stream, as mirrors."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from loomspan.operators import mirror
from loomspan.sources import files, tail


def test_lines_of_files_in_many_blocks(spark, tmp_path):
    texts = {"a": "".join(f"{i:04d} é line\r\n" if i % 7 else "\n" for i in range(500)), "b": "one\ntwo", "c": "", "d": "x" * 3000 + "\nend\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    want = {}
    for name, text in texts.items():
        at = 0
        for pos, line in enumerate(text.encode().split(b"\n")):
            at += len(line) + 1
            if line.strip():
                want[name, pos] = (line.decode(), min(at, len(text.encode())), at <= len(text.encode()))
    try:
        for most in ("200b", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            read = files.lines(spark, str(tmp_path))
            got = {(os.path.basename(r.path)[:1], r.pos): (r.line, r.end_offset, r.complete) for r in read.collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_offsets_beyond_a_file_read_it_from_its_start(spark, tmp_path):
    (tmp_path / "long.jsonl").write_text('{"a":1}\n{"a":2}\n{"a":3}\n')
    (tmp_path / "short.jsonl").write_text('{"a":4}\n')
    got = files.records(spark, str(tmp_path), since=16).select("rec").collect()
    assert sorted(r.rec for r in got) == ['{"a":3}', '{"a":4}']


def test_ids_are_held_against_file_names(spark, tmp_path):
    rows = {"good": {"sessionId": "good"}, "other": {"sessionId": "elsewhere"}, "odd id": {"sessionId": "odd id"}, "rollout-1-abc": {"type": "session_meta", "payload": {"id": "abc"}}, "rollout-xyz-1": {"type": "session_meta", "payload": {"id": "xyz"}}, "child": {"type": "session_meta", "payload": {"id": "child", "source": {"subagent": {}}}}, "none": {"x": 1}}
    for name, row in rows.items():
        (tmp_path / f"{name}.jsonl").write_text(json.dumps(row) + "\n")
    got = {r.session_id: r.fits for r in files.sessions(files.records(spark, str(tmp_path))).collect()}
    assert got == {"good": True, "elsewhere": False, "odd id": False, "abc": True, "xyz": False}


def test_a_piece_has_the_lines_that_start_in_it(tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_bytes(b"a\n\nbcd\n" + b"e" * 40 + b"\nf\nunfinished")
    whole = [r[1:] for r in tail.read_piece(tail.Piece(str(path), 0, tail.complete_bytes(str(path))))]
    for size in range(1, 60):
        assert [r[1:] for p in tail.pieces(str(path), 0, tail.complete_bytes(str(path)), size) for r in tail.read_piece(p)] == whole
    assert [r[2] for r in whole] == ["a", "", "bcd", "e" * 40, "f"]


def test_a_stream_follows_files_that_grow_shrink_and_come(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    (folder / "deep").mkdir(parents=True)

    def step():
        q = tail.growing(spark, str(folder), piece=7).writeStream.foreachBatch(lambda b, n: b.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        seen = spark.read.parquet(out)
        last = seen.agg(F.max("n")).first()[0]
        return [(os.path.basename(r.path), r.line) for r in seen.where(F.col("n") == last).orderBy("path", "start_offset").collect()]

    one, two = folder / "one.jsonl", folder / "deep" / "two.jsonl"
    one.write_text("a\nb\npart")
    two.write_text("x\n")
    assert step() == [("two.jsonl", "x"), ("one.jsonl", "a"), ("one.jsonl", "b")]
    with one.open("a") as f:
        f.write("ial\nc\n")
    (folder / "deep" / "note.txt").write_text("not a transcript\n")
    assert step() == [("one.jsonl", "partial"), ("one.jsonl", "c")]
    one.write_text("anew\n")
    (folder / "late.jsonl").write_text("late\n")
    assert step() == [("late.jsonl", "late"), ("one.jsonl", "anew")]
    batch = spark.read.format(tail.NAME).option("path", str(folder)).option("piece", 3).load()
    assert sorted(r.line for r in batch.collect()) == ["anew", "late", "x"]


def test_mirrors_are_their_sources_after_growth_shrinking_and_repeats(spark, tmp_path):
    source, folder = tmp_path / "src", str(tmp_path / "mirror")
    source.mkdir()

    def listed():
        return spark.createDataFrame([("s", str(p), p.stat().st_size) for p in sorted(source.iterdir())], "session_id string, path string, size long")

    def held():
        return {os.path.basename(r.path): open(f"{folder}/{r.file}", "rb").read()[: r.mirrored] for r in mirror.marks(spark, folder).collect()}

    def put(name, data):
        (source / name).write_bytes(data)

    put("a", b"first line\n")
    put("b", b"0123456789" * 20 + b"\n")
    mirror.append(spark, listed(), folder, piece=16)
    assert held() == {p.name: p.read_bytes() for p in source.iterdir()}
    put("a", b"first line\nsecond line, longer\n")
    put("c", b"new\n")
    mirror.append(spark, listed(), folder, piece=16)
    # A copy that was never noted leaves bytes behind the mark; they are written again.
    kept = {r.path: r for r in mirror.marks(spark, folder).collect()}
    with open(f"{folder}/{kept[str(source / 'a')].file}", "ab") as f:
        f.write(b"garbage of a lost task")
    put("a", b"first line\nsecond line, longer\nthird\n")
    put("b", b"short\n")
    for _ in range(2):
        mirror.append(spark, listed(), folder, piece=16)
        assert held() == {p.name: p.read_bytes() for p in source.iterdir()}
    assert {os.path.basename(r.path): r.generation for r in mirror.marks(spark, folder).collect()} == {"a": 0, "b": 1, "c": 0}
    lines = mirror.mirrored_lines(spark, folder, files.lines).where(F.endswith("path", F.lit("/a"))).orderBy("pos").collect()
    assert [r.line for r in lines] == ["first line", "second line, longer", "third"]
    # Files that aren't listed keep their mirrors; one that is longer than its source has become is an error.
    mirror.append(spark, listed().where(F.endswith("path", F.lit("/c"))), folder)
    assert set(held()) == {"a", "b", "c"}
    with pytest.raises(OSError, match="shorter"):
        mirror.append(spark, listed().withColumn("size", F.col("size") + 5), folder)

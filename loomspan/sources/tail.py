"""Growing line files as a stream: each batch has the lines that were completed since the one before.

The offset of a stream is how far each file has been read. A batch reads byte ranges: a file's new bytes are cut into pieces, one a task, and a piece has the lines that
start in it. A last line without its line feed waits until it is complete. A file that has become shorter is read again from its start. Files that go are forgotten.

Files lie on a file system that the driver and all executors reach by the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
SCHEMA = "path string, start_offset long, end_offset long, line string"
#: Bytes of a piece, and of a step back when the last line feed is sought.
PIECE, STEP = 64 << 20, 64 << 10


def listed(folder: str, suffix: str) -> list[str]:
    """Files below a folder whose names end so, in order; links are not followed."""
    out = []
    for top, folders, names in os.walk(folder):
        folders[:] = [f for f in folders if not os.path.islink(os.path.join(top, f))]
        out += [p for n in names if n.endswith(suffix) and not os.path.islink(p := os.path.join(top, n))]
    return sorted(out)


def complete_bytes(path: str) -> int:
    """How many bytes of a file lie before the end of its last complete line."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            step = min(STEP, at)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return 0


@dataclass
class Piece(InputPartition):
    path: str
    first: int
    last: int


def pieces(path: str, first: int, last: int, size: int) -> list[Piece]:
    return [Piece(path, at, min(at + size, last)) for at in range(first, last, size)]


def read_piece(piece: Piece) -> Iterator[tuple[str, int, int, str]]:
    """The lines that start in a piece; the last may end beyond it."""
    try:
        f = open(piece.path, "rb")
    except FileNotFoundError:
        return
    with f:
        at = piece.first
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # the rest of a line that started before
        while at < piece.last:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield piece.path, at, at + len(line), line[:-1].decode("utf-8", "replace")
            at += len(line)


class GrowingLines(DataSource):
    """Options: path, a folder; suffix (`.jsonl`); piece, bytes a task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, str, int]:
        return self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("piece", PIECE))

    def reader(self, schema) -> DataSourceReader:
        return _Whole(*self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._given())


class _Whole(DataSourceReader):
    def __init__(self, folder: str, suffix: str, size: int):
        self.folder, self.suffix, self.size = folder, suffix, size

    def partitions(self) -> Sequence[InputPartition]:
        return [p for path in listed(self.folder, self.suffix) for p in pieces(path, 0, complete_bytes(path), self.size)] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return read_piece(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, size: int):
        self.folder, self.suffix, self.size = folder, suffix, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in listed(self.folder, self.suffix):
            try:
                out[path] = complete_bytes(path)
            except FileNotFoundError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for path, last in end.items():
            first = start.get(path, 0)
            out += pieces(path, first if first <= last else 0, last, self.size)
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        return read_piece(partition)


def growing(spark: SparkSession, folder: str, suffix: str = ".jsonl", piece: int = PIECE) -> DataFrame:
    """A stream of (path, start_offset, end_offset, line)."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).option("path", folder).option("suffix", suffix).option("piece", piece).load()

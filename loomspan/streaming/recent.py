"""Bounded memories of a stream's keys: the ids seen last, and the values put last.

Journals keep everything; a stream only has to absorb repetitions and rows that arrive somewhat out of order. So each key of a stream remembers `capacity` ids and forgets the oldest. A set keeps
the age of an id that comes again; a map makes it the youngest, with its new value. State is one value a key, read and written once a batch.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Ids that are remembered (fixed value).
CAPACITY = 4_096


class RecentSet:
    def __init__(self, ids: list[str] | None = None, capacity: int = CAPACITY):
        self.ids, self.capacity = OrderedDict.fromkeys(ids or []), capacity

    def add(self, key: str) -> bool:
        """Whether the id is new."""
        if key in self.ids:
            return False
        self.ids[key] = None
        while len(self.ids) > self.capacity:
            self.ids.popitem(last=False)
        return True


class RecentMap:
    def __init__(self, items: list[tuple[str, str]] | None = None, capacity: int = CAPACITY):
        self.values, self.capacity = OrderedDict(items or []), capacity

    def put(self, key: str, value: str) -> None:
        self.values.pop(key, None)
        self.values[key] = value
        while len(self.values) > self.capacity:
            self.values.popitem(last=False)

    def get(self, key: str) -> str | None:
        return self.values.get(key)


class _Kept(StatefulProcessor):
    """A processor whose state of a key is one JSON text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "text string")

    def load(self):
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def save(self, value) -> None:
        self.state.update((json.dumps(value, separators=(",", ":")),))

    def close(self) -> None:
        pass


class _First(_Kept):
    def __init__(self, columns: list[str], key: str, order: str, capacity: int):
        self.columns, self.key, self.order, self.capacity = columns, key, order, capacity

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        seen = RecentSet(self.load(), self.capacity)
        for r in sorted(rows, key=lambda r: r[self.order]):
            if r[self.key] is None or seen.add(r[self.key]):
                yield Row(**{c: r[c] for c in self.columns})
        self.save(list(seen.ids))


class _Known(_Kept):
    def __init__(self, columns: list[str], key: str, value: str, order: str, to: str, capacity: int):
        self.columns, self.key, self.value, self.order, self.to, self.capacity = columns, key, value, order, to, capacity

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        known = RecentMap(self.load(), self.capacity)
        for r in sorted(rows, key=lambda r: r[self.order]):
            if r[self.key] is not None and r[self.value] is not None:
                known.put(r[self.key], r[self.value])
            yield Row(**{c: r[c] for c in self.columns}, **{self.to: known.get(r[self.key]) if r[self.key] is not None else None})
        self.save(list(known.values.items()))


def first_seen(stream: DataFrame, groups: list[str], key: str, order: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows whose id (key) is none of the last `capacity` of its group, in the order of a column inside a batch; rows without an id all stay."""
    return stream.groupBy(*groups).transformWithState(_First(stream.columns, key, order, capacity), stream.schema, "append", "none")


def last_known(stream: DataFrame, groups: list[str], key: str, value: str, order: str, to: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows with, as column `to`, the value that their key got last, among the last `capacity` keys of their group. A row with a value puts it."""
    schema = stream.withColumn(to, F.col(value).cast("string")).schema
    return stream.groupBy(*groups).transformWithState(_Known(stream.columns, key, value, order, to, capacity), schema, "append", "none")

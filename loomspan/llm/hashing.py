"""Words of many texts at once, as 64-bit hashes of their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BY = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def letters(outside: str) -> np.ndarray:
    """For each byte, whether it belongs to words: those that aren't outside."""
    out = np.ones(256, bool)
    out[list(outside.encode())] = False
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _BY[0]
    x = (x ^ (x >> _U(27))) * _BY[1]
    return x ^ (x >> _U(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def powers(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def _segments(buffer: np.ndarray, letter: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about BLOCK bytes that end between words or texts; a longer word is a stretch of its own length."""
    at = 0
    while at < len(buffer):
        to = min(at + BLOCK, len(buffer))
        while to < len(buffer):
            ahead = buffer[to - 1 : to + BLOCK]
            gaps = np.flatnonzero(~letter[LOWER[ahead]])
            edge = int(edges[np.searchsorted(edges, to)])
            if len(gaps):
                to = min(to + int(gaps[0]), edge)
                break
            if edge <= to + len(ahead):
                to = edge
                break
            to += len(ahead)
        yield at, min(to, len(buffer))
        at = to


def word_hashes(buffer: np.ndarray, offsets: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts buffer[offsets[i]:offsets[i+1]]: where the words of each start, and the hashes of all, A-Z lower-cased."""
    found, firsts = [], []
    for a, b in _segments(buffer, letter, offsets):
        text = LOWER[buffer[a:b]]
        inside = letter[text]
        edge = np.zeros(len(text) + 1, bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:] = True, ~inside[:-1]
        after[-1], after[:-1] = True, ~inside[1:]
        starts = np.flatnonzero(inside & (before | edge[:-1]))
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        power, inverse = _powers(1 << max(20, len(text).bit_length()))
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + _U(1)) * power[: len(text)], out=sums[1:])
        found.append(mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        firsts.append(starts + a)
    starts = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
    return np.searchsorted(starts, offsets), np.concatenate(found) if found else np.empty(0, np.uint64)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows at, to of a string column with their bytes and offsets, about BLOCK bytes at a time; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    if not len(wide):
        return
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] else np.empty(0, np.uint8)
    at = 0
    while at < len(wide):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to

"""Secret scans: patterns with a known form, and character Markov models for strings without one.

Base spans are the matches of three patterns, leftmost and without overlap for each kind; matches that are too short are dropped. Start and end of a span are those of the whole
match, in code points.

The method adds runs of key characters that look random. Two second-order Markov models give the probability of a run, a character after the two before it: one of random strings,
trained on what base spans hold (labelled by their patterns), and one of ordinary identifiers, trained on all runs outside these, of all
documents. Counts are added up in the tasks, over at most two models times the cube of the alphabet. Each model backs off to one character before, then to the character alone, then to all characters
alike, so that random strings of another alphabet than the labelled ones aren't taken for identifiers. A run of LEAST characters or more that
doesn't overlap a base span is a span of kind `random` if the log-likelihood ratio is at least MARGIN, and at least RATE a character.

Defined cases: a null or empty text has no spans; letters outside ASCII end a run; without base spans nothing is learnt of random strings and the model is the back-off alone; repeated rows each get their spans, and count
each; equal starts are ordered by kind, as listed; a very long text is scanned whole, in one task; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import blocks

# The patterns of the base spans, and how long what they match must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

#: Characters of a run; each has a number from 1, and 0 is what ends a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
K = len(ALPHABET) + 1
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: Characters of a run that is judged, and its evidence in nats: in all, and a character.
LEAST, MARGIN, RATE = 16, 6.0, 0.25
#: Weight of the back-off in each of its steps, and of all characters alike in the last.
BACKOFF, FLAT = 5.0, 0.1

_NUMBER = np.zeros(256, np.int64)
_NUMBER[list(ALPHABET.encode())] = np.arange(1, K)

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, end, number of the kind), by kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


def _value(text: str, span: Span) -> tuple[int, int]:
    """Where the secret of a base span lies: after the name and the sign of an assignment, else the whole span."""
    m = ASSIGN.match(text, span[0], span[1]) if span[2] == 0 else None
    return m.span(2) if m else span[:2]


def _triples(numbers: np.ndarray) -> np.ndarray:
    """How often each character follows each two, in runs that 0 ends."""
    x = np.concatenate([np.zeros(2, np.int64), numbers])
    a, b, c = x[:-2], x[1:-1], x[2:]
    a = np.where(b == 0, 0, a)  # a run starts afresh
    return np.bincount((a * K + b) * K + c, minlength=K**3)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, K**3), np.int64)
    for batch in batches:
        for at, to, data, offsets in blocks(batch.column(0)):
            # A 0 between texts, so that no run crosses them.
            numbers = np.insert(_NUMBER[data], offsets[1:], 0)
            for i in range(at, to):
                text = batch.column(0)[i].as_py() or ""
                if spans := base_spans(text):
                    start, raw = int(offsets[i - at]) + i - at, text.isascii()
                    held = []
                    for a, b in sorted({_value(text, s) for s in spans}):
                        if not raw:
                            a, b = (len(text[:x].encode("utf-8", "surrogatepass")) for x in (a, b))
                        held.append((start + a, start + b))
                    last = 0
                    for a, b in held:
                        a = max(a, last)
                        if b > a:
                            sums[1] += _triples(np.append(numbers[a:b], 0))
                            last = b
                    for a, b in held:
                        numbers[a:b] = 0
            sums[0] += _triples(numbers)
    model, at = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(model, pa.int64()), pa.array(at, pa.int64()), pa.array(sums[model, at], pa.int64())], names=["model", "at", "n"])


@dataclass
class Models:
    """How much likelier each character after two others is in random strings than in identifiers, as a logarithm."""

    ratio: np.ndarray

    def evidence(self, run: str) -> float:
        x = np.concatenate([np.zeros(2, np.int64), _NUMBER[np.frombuffer(run.encode(), np.uint8)]])
        return float(self.ratio[x[:-2], x[1:-1], x[2:]].sum())


def _model(counts: np.ndarray) -> np.ndarray:
    """Logarithms of P(c | a, b), of characters that aren't ends."""
    n = counts.reshape(K, K, K)[:, :, 1:].astype(float)
    flat = np.full(K - 1, 1 / (K - 1))
    single = n.sum(axis=(0, 1))
    single = (1 - FLAT) * (single / single.sum() if single.sum() else flat) + FLAT * flat
    pairs = n.sum(axis=0)
    pairs = (pairs + BACKOFF * single) / (pairs.sum(axis=1, keepdims=True) + BACKOFF)
    triples = (n + BACKOFF * pairs[None]) / (n.sum(axis=2, keepdims=True) + BACKOFF)
    mixed = (1 - FLAT) * triples + FLAT * flat
    return np.log(np.concatenate([np.ones((K, K, 1)), mixed], axis=2))


def fit(docs: DataFrame, text: str = "text") -> Models:
    """Both models, from counts over all documents."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_counted, "model long, at long, n long").groupBy("model", "at").agg(F.sum("n").alias("n")).collect()  # of 2 * K**3 numbers
    sums = np.zeros((2, K**3), np.int64)
    for r in rows:
        sums[r.model, r.at] = r.n
    return Models(_model(sums[1]) - _model(sums[0]))


def spans_of(text: str, models: Models) -> list[Span]:
    """All spans, by start and kind."""
    base = base_spans(text)
    taken = sorted(s[:2] for s in base)
    out, i = base, 0
    for m in RUN.finditer(text):
        a, b = m.span()
        if b - a < LEAST:
            continue
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        if (e := models.evidence(m.group())) >= max(MARGIN, RATE * (b - a)):
            out.append((a, b, 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def scan(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): lists of (kind, start, end, found) for each document."""
    given = docs.select(F.col(doc_id), F.col(text).alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                lists.append([{"kind": KINDS[k], "start": a, "end": b, "found": t[a:b]} for a, b, k in spans_of(t, models)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], names=[batch.schema.names[0], "spans"])

    kind = F.struct(F.lit("").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("found"))
    return given.mapInArrow(scanned, docs.select(F.col(doc_id), F.array(kind).alias("spans")).schema)


def redacted(docs: DataFrame, models: Models, text: str = "text", by: str = "[secret]") -> DataFrame:
    """docs with every span of their text replaced; spans that overlap are one."""
    others = [c for c in docs.columns if c != text]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.schema.get_field_index(text), []
            for t in batch.column(at).to_pylist():
                out, last = [], 0
                for a, b, _ in spans_of(t or "", models):
                    if a >= last:
                        out += [t[last:a], by]
                    last = max(last, b)
                texts.append(t and "".join([*out, t[last:]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], names=[*others, text])

    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(text)).mapInArrow(cleaned, docs.select(*(F.col(f"`{c}`") for c in others), F.col(text)).schema).select(*(F.col(f"`{c}`") for c in docs.columns))

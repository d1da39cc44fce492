"""Toxicity scores by weak supervision.

Voters fire on a text: words of a small lexicon of insults, marks of shouting, and word
beginnings or whole words that training rows marked toxic share and others lack. A generative label
model estimates by EM how often each voter, and the annotator of the labels, is right;
voters that fire together, in all documents, beyond what the classes explain share their weight. A linear
(logistic) classifier is trained on the posterior labels and scores every text from its voters alone.

Only rows whose crc32(doc_id as text) mod 5 is not 0 lend their labels. Labelled rows that fit the model are a sample of about SAMPLE (a parameter), taken by
the hash of their ids; how often voters fire together is counted over all documents, labelled or not. Every pattern of the sample is tested, and as many become voters as the
test lets through: none is cut off by rank. All rows are scored, over their whole text. Labels, languages, sources
and ids are never inputs of a score.

Defined cases: a null or empty text fires nothing and gets the score of a text
without hits (below 0.5 unless most training rows are toxic); without labels the lexicon alone decides, at an assumed accuracy; of
several labels of one id, or of equal texts, the largest counts; patterns that tell as much are taken in the order of their bytes; rows with a null id have no label and aren't held out; repeated rows and further
columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import key
from .shared import stored, unused

#: Correlation, beyond what the classes explain, from which voters share their weight.
TIED = 0.2
#: Labelled rows of the fitted sample, about.
SAMPLE = 20_000
#: Lengths of word beginnings, in bytes; a whole word of any length ends with a full stop.
SHORTEST, LONGEST = 3, 9
MIN_TOXIC = 4
#: Learned voters that are sought for each toxic row.
COVER = 4

LEXICON = tuple(
    """idiot idiots moron morons stupid dumb scum trash loser losers clown pathetic worthless disgusting imbecile filth vermin bastard asshole bitch whore retard
    dummkopf vollidiot arschloch abschaum hurensohn widerlich dreckig schlampe wichser
    connard connasse salope ordure imbécile abruti crétin pathétique dégoûtant
    estúpido imbécil basura escoria pendejo cabrón puta asqueroso gilipollas""".split()
)
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_MARKS = {b"!!": b"!!", b"??": b"??"}


def _words(text: str | None) -> tuple[bytes, set[bytes]]:
    low = (text or "").encode().lower()
    return low, set(_WORD.findall(low))


def _patterns(words: set[bytes]) -> set[bytes]:
    """Every word followed by a full stop, and its beginnings."""
    out = {w + b"." for w in words}
    for n in range(SHORTEST, LONGEST + 1):
        out.update(w[:n] for w in words if len(w) >= n)
    return out


class Voters:
    """Which of the given patterns a text fires: full words (with a full stop), beginnings and marks."""

    def __init__(self, patterns: list[bytes]):
        self.at = {p: i for i, p in enumerate(patterns)}
        self.marks = [(m, self.at[p]) for p, m in _MARKS.items() if p in self.at]
        plain = [p for p in patterns if p not in _MARKS]
        self.least = min((len(p.rstrip(b".")) for p in plain), default=1 << 30)
        self.gate = {p.rstrip(b".")[: self.least] for p in plain}
        self.lengths = sorted({len(p) for p in plain if not p.endswith(b".")})
        self.whole = any(p.endswith(b".") for p in plain)

    def __call__(self, text: str | None) -> list[int]:
        low, words = _words(text)
        out = {i for m, i in self.marks if m in low}
        if self.gate:
            n, gate, at = self.least, self.gate, self.at
            for w in words:
                if w[:n] in gate:
                    if self.whole and (i := at.get(w + b".")) is not None:
                        out.add(i)
                    for k in self.lengths:
                        if k > len(w):
                            break
                        if (i := at.get(w[:k])) is not None:
                            out.add(i)
        return sorted(out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) rows become patterns with how many toxic and clean texts have them, added up where it's cheap to."""
    found: tuple[Counter[bytes], Counter[bytes]] = Counter(), Counter()

    def out() -> pa.RecordBatch:
        names = list(found[0] | found[1])
        columns = [pa.array(names, pa.binary()), *(pa.array([f[p] for p in names], pa.int64()) for f in (found[1], found[0]))]
        for f in found:
            f.clear()
        return pa.RecordBatch.from_arrays(columns, names=["pattern", "toxic", "clean"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[label].update(_patterns(_words(text)[1]))
            if len(found[0]) + len(found[1]) > 300_000:
                yield out()
    yield out()


def candidates(rows: DataFrame, toxic: int, clean: int) -> tuple[list[tuple[bytes, int, int]], int]:
    """Patterns (with toxic and clean texts that have them) that tell toxic from clean texts better than chance lets any of those tested, and how many were tested."""
    counts = stored(rows.select("label", "text").mapInArrow(_counted, "pattern binary, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= MIN_TOXIC))
    tested = counts.count()
    base = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    gain = 2 * (F.col("toxic") * F.log(F.col("toxic") / (n * base)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - base)))).otherwise(0.0))
    good = counts.where((F.col("toxic") > n * base) & (gain > _least(tested)))
    return sorted((bytes(r.pattern), r.toxic, r.clean) for r in good.collect()), tested


def _least(tested: int) -> float:
    """The deviance that chance rarely gives to any of so many patterns."""
    return 2 * (float(np.log(max(tested, 2))) + 3)


def _deviance(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """Twice the log-likelihood gained by telling apart the texts with a pattern; 0 where it speaks for clean texts."""
    n = toxic + clean
    base = all_toxic / (all_toxic + all_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(toxic > 0, toxic * np.log(toxic / (n * base)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - base))), 0)
    return np.where(toxic > n * base, 2 * gain, 0.0)


@dataclass
class Model:
    patterns: list[bytes]
    weights: np.ndarray
    bias: float


def label_model(fires: np.ndarray, label: np.ndarray, together: np.ndarray, n: int, rounds: int = 40) -> np.ndarray:
    """P(toxic) of each labelled row. fires: rows x voters; label: 1 or 0; together: in how many of n documents two voters fire, and on the diagonal one."""
    voters = fires.shape[1]
    weight = np.ones(voters)
    prior = float(np.clip(label.mean(), 0.01, 0.9))
    post = np.where(label == 1, 0.95, 0.05).astype(float)
    right = np.array([0.05, 0.95])  # P(label 1) of clean and toxic rows
    share = together.diagonal() / max(n, 1)
    for turn in range(rounds):
        mass = np.stack([1 - post, post])
        rate = (mass @ fires + [[0.05], [0.5]]) / (mass.sum(1, keepdims=True) + 1)  # class x voter
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        if turn == rounds // 2 and voters > 1:
            apart = rate[1] - rate[0]
            toxic = float(np.clip(apart @ (share - rate[0]) / (apart @ apart + 1e-12), 1e-3, 0.9))  # of all documents
            explained = toxic * np.outer(rate[1], rate[1]) + (1 - toxic) * np.outer(rate[0], rate[0])
            rest = together / max(n, 1) - explained
            spread = np.sqrt(np.clip(rest.diagonal(), 1e-9, None))
            tied = np.clip(rest / np.outer(spread, spread), 0, 1)
            tied[tied < TIED] = 0
            np.fill_diagonal(tied, 1)
            weight = 1 / tied.sum(1)
        hits = mass @ (label == 1)
        right = np.clip((hits + [0.5, 9.5]) / (mass.sum(1) + 10), 0.001, 0.999)
        prior = float(np.clip(post.mean(), 1e-3, 0.9))
        score = np.log(prior / (1 - prior)) + (fires * (np.log(rate[1] / rate[0]) * weight)).sum(1) + ((1 - fires) * (np.log((1 - rate[1]) / (1 - rate[0])) * weight)).sum(1)
        score += np.where(label == 1, np.log(right[1] / right[0]), np.log((1 - right[1]) / (1 - right[0])))
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[np.ndarray, float]:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _choose(fired: list[list[int]], label: np.ndarray, found: list[tuple[bytes, int, int]], tested: int) -> list[int]:
    """Patterns that, one after another, best tell toxic rows of which fewer than COVER chosen ones so far fire; chance alone would rarely give one of them.

    fired: of each row, the patterns that it has. Of beginnings of one another, only one is taken.
    """
    names, clean = [p for p, _, _ in found], np.array([c for _, _, c in found], float)
    rows_of: list[list[int]] = [[] for _ in names]
    for i in np.flatnonzero(label == 1).tolist():
        for p in fired[i]:
            rows_of[p].append(i)
    left = np.full(len(fired), COVER)
    have, open_, out = np.array([len(r) for r in rows_of], float), int((label == 1).sum()), []
    plain, free, all_clean = [n.rstrip(b".") for n in names], np.ones(len(names), bool), max(int((label == 0).sum()), 1)
    while len(names) and open_:
        gain = np.where(free, _deviance(have, clean, open_, all_clean), 0.0)
        best = int(gain.argmax())
        if gain[best] < _least(tested):
            break
        out.append(best)
        free &= ~np.array([n.startswith(plain[best]) or plain[best].startswith(n) for n in plain])
        for i in rows_of[best]:
            left[i] -= 1
            if not left[i]:
                open_ -= 1
                have[fired[i]] -= 1
    return out


def holds_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SAMPLE) -> DataFrame:
    """(text, label) of about `size` labelled rows that aren't held out; equal texts count once."""
    given = stored(labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~holds_out(doc_id)).groupBy(doc_id).agg(F.max(label).cast("int").alias("label")))
    n = given.count()
    taken = given.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / max(n, 1))))
    rows = docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(taken), doc_id)  # about `size` ids
    return rows.withColumn("k", F.struct(*key("text"))).groupBy("k").agg(F.first("text").alias("text"), F.max("label").alias("label")).drop("k")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SAMPLE) -> Model:
    rows = stored(sample(docs, labels, doc_id, text, label, size).where("label in (0, 1)").repartition(24))
    known = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    toxic, clean = known.get(1, 0), known.get(0, 0)
    patterns = [w.encode() + b"." for w in LEXICON] + list(_MARKS)
    if toxic and clean:
        found, tested = candidates(rows, toxic, clean)
        found = [x for x in found if x[0] not in patterns]
        fired, marks = _votes(rows, [p for p, _, _ in found])
        patterns += [found[i][0] for i in _choose(fired, marks, found, tested)]
    fired, marks = _votes(rows, patterns)
    fires = np.zeros((len(fired), len(patterns)), np.float32)
    for i, at in enumerate(fired):
        fires[i, at] = 1
    heard = np.flatnonzero(fires.any(0))
    unheard = np.setdiff1d(np.arange(len(patterns)), heard)
    weights = np.zeros(len(patterns))
    weights[[i for i in unheard if patterns[i] not in _MARKS]] = 2.0 if len(heard) else 4.0
    bias = -2.0
    if len(heard):
        together, n = _together(docs, text, [patterns[i] for i in heard])
        weights[heard], bias = _logistic(fires[:, heard].astype(float), label_model(fires[:, heard].astype(float), marks, together, n))
    elif not len(marks):
        weights[:] = [0.0 if p in _MARKS else 4.0 for p in patterns]  # nothing to estimate accuracies by
    return Model(patterns, weights, bias)


def _votes(rows: DataFrame, patterns: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
    """Of the bounded sample: which patterns each row fires, and its label."""

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(patterns)
        for batch in batches:
            at = [voters(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), batch.column(1)], names=["at", "label"])

    got = rows.select("text", "label").mapInArrow(fired, "at array<int>, label int").collect()
    return [r["at"] for r in got], np.array([r["label"] for r in got], int)


def _together(docs: DataFrame, text: str, patterns: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many documents each two patterns fire, over all docs, and the number of docs."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, sums, n = Voters(patterns), np.zeros((len(patterns), len(patterns)), np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                at = voters(t)
                n += 1
                if at:
                    sums[np.ix_(at, at)] += 1
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), -1]), pa.array([*j.tolist(), -1]), pa.array([*sums[i, j].tolist(), n])], names=["i", "j", "n"])

    got = docs.select(text).mapInArrow(paired, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # pairs of voters
    out, n = np.zeros((len(patterns), len(patterns))), 0
    for r in got:
        if r.i < 0:
            n = r.n
        else:
            out[r.i, r.j] = r.n
    return out, n


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with their score in place of the text; a column of docs with its name is replaced."""
    docs = docs.drop(*({name} - {text}))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = [i for i, w in enumerate(model.weights) if w]
        voters, weights = Voters([model.patterns[i] for i in used]), model.weights[used]
        for batch in batches:
            z = [model.bias + float(weights[voters(t)].sum()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(z), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], names=[*batch.schema.names[:-1], name])

    others = docs.drop(text).columns
    given = docs.select(*others, text)
    return given.mapInArrow(scored, docs.select(*others, F.lit(0.0).alias(name)).schema)


def remove(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    model = fit(docs, labels, doc_id, text)
    mark, copy = unused(docs, "score", "copy")
    return score(docs.withColumn(copy, F.col(text)), model, copy, mark).where(F.col(mark) < 0.5).select(*docs.columns)

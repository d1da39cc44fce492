"""Secret scans, the filter audit and hard negatives against plain versions, on small tables with awkward rows."""

import base64
import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

from loomspan.llm import filters, negatives, queries, secrets
from loomspan.llm.shared import read

SF = "/root/testdata/sf0.001"


def base_plain(text):
    out = []
    kinds = [
        (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
        (r"AKIA[A-Z0-9]+", 0, 16),
        (r"[0-9a-f]+", 0, 32),
    ]
    for k, (pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


AWKWARD = [
    "", None, "password=", "PassWord = 'abcdefgh'", "secret:token:abcdefgh1", "token = \"" + "0a" * 20 + "\"", "ſecret=abcdefghij", "toKen=abcdefghij",
    "é" * 7 + "AKIA" + "Z9" * 6, "AKIAABC", "AKIA" * 9, "f" * 31, "f" * 32 + "g" + "0" * 40, "apikey='a.b=c/d+e-f_'", "api_key :x1234567", "𝒳 passwd=12345678 𝒳",
    "password=token=abcdefgh", "word " * 50_000 + "token=zzzzzzzz", "secret=" + "a" * 100_000,
]


def test_base_spans_are_those_of_the_patterns(spark):
    for t in AWKWARD:
        got = sorted(secrets.base_spans(t or ""), key=lambda s: (s[0], s[2]))
        assert [(secrets.KINDS[k], a, b) for a, b, k in got] == base_plain(t or ""), (t or "")[:80]
    docs = read(spark, SF, "documents")
    want = {r.doc_id: base_plain(r.text or "") for r in docs.select("doc_id", "text").collect()}
    for r in queries.op11_secrets(spark, SF).collect():
        base = want[r.doc_id]
        assert r.base_sha256 == digest(base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in base) for kind in secrets.KINDS[:3]]
        listed = [tuple(s.split(":")) for s in r.spans.split(",")] if r.spans else []
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(listed)


def plain_evidence(models_from, run):
    """The log-likelihood ratio from dictionaries of counted triples: (random runs, ordinary runs)."""
    import math

    def model(runs):
        triples, pairs, singles = {}, {}, {}
        for r in runs:
            a = b = ""
            for c in r:
                triples.setdefault((a, b), {}).setdefault(c, 0)
                triples[(a, b)][c] += 1
                pairs.setdefault(b, {}).setdefault(c, 0)
                pairs[b][c] += 1
                singles[c] = singles.get(c, 0) + 1
                a, b = b, c
        n, flat = sum(singles.values()), 1 / len(secrets.ALPHABET)

        def p(a, b, c):
            one = 0.9 * (singles.get(c, 0) / n if n else flat) + 0.1 * flat
            two = (pairs.get(b, {}).get(c, 0) + 5 * one) / (sum(pairs.get(b, {}).values()) + 5)
            three = (triples.get((a, b), {}).get(c, 0) + 5 * two) / (sum(triples.get((a, b), {}).values()) + 5)
            return math.log(0.9 * three + 0.1 * flat)

        return p

    x, y = (model(r) for r in models_from)
    total, a, b = 0.0, "", ""
    for c in run:
        total += x(a, b, c) - y(a, b, c)
        a, b = b, c
    return total


def test_models_are_those_of_plain_counts(spark):
    texts = ["password=abc123xyz789 said für the quick-brown fox", "hello_world AKIA" + "Q7" * 8 + " end", None, "", "ab ab ab secret: 'k3j4h5g6'"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    models = secrets.fit(docs)
    held, ordinary = ["abc123xyz789", "AKIA" + "Q7" * 8, "k3j4h5g6"], []
    for t in texts:
        t = t or ""
        for h in held:
            t = t.replace(h, "\0")
        ordinary += re.findall("[A-Za-z0-9+/_-]+", t)
    for run in ["abc123", "quickbrown", "Zz9-_/+", "k3j4h5", "a"]:
        assert models.evidence(run) == pytest.approx(plain_evidence((held, ordinary), run), abs=1e-9)


def test_random_strings_are_told_from_identifiers(spark):
    """Held out: none of these strings is in the documents that the models are trained on."""
    models = secrets.fit(read(spark, "/root/testdata/sf0.01", "documents"))
    r = random.Random(5)
    strange = [base64.b64encode(r.randbytes(24)).decode() for _ in range(150)] + [r.randbytes(12).hex() for _ in range(150)] + ["".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=30)) for _ in range(150)]
    parts = "get set user total count http request handler thread pool value index result parse string buffer socket client server config reader writer".split()
    plain = ["_".join(r.sample(parts, 4)) for _ in range(150)] + ["".join(w.title() for w in r.sample(parts, 4)) for _ in range(150)] + ["-".join(r.sample(parts, 5)) for _ in range(150)]
    hits = lambda xs: np.mean([any(k == 3 for _, _, k in secrets.spans_of(f"see {x} now", models)) for x in xs])
    assert hits(strange) > 0.85 and hits(plain) < 0.02


def test_secrets_of_awkward_tables(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", 1) for i, t in enumerate(AWKWARD)], "doc_id long, text string, spans string, model int")
    models = secrets.fit(docs)
    assert secrets.scan(docs, models).count() == len(AWKWARD)
    clean = secrets.redacted(docs, models)
    assert clean.columns == docs.columns and clean.where("text LIKE '%0a0a0a0a%'").count() == 0 and clean.where("text IS NULL").count() == 1
    empty = docs.where("false")
    assert secrets.scan(empty, secrets.fit(empty)).count() == 0


def audit_plain(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic). The audit by walking each order."""
    first, out = {}, {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        fails.append((lang or "", i, {k for k, v in f.items() if v}))
    shapley = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, _, _ in fails}:
            left = [(i, f) for p, i, f in fails if p == part]
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                failing = sum(c in f for p, _, f in fails if p == part)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(f == {c} for p, _, f in fails if p == part), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_of(docs, labels):
    got = filters.audit(filters.histograms(docs, labels), "ABCDE").collect()
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in filters.COUNTS) for r in got}


def test_audit_against_walking_each_order(spark):
    r = random.Random(2)
    texts = ["", None, "A B C", "a " * 150, "the # of", " ".join(f"w{i}" for i in range(300)), "ABC " * 300, "x y \x0b\x0c z", "é" * 100_000, "word " * 40_000]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(200)]
    labels = [(r.choice([None, *range(40)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame([(*x, "clash", 7) for x in rows], "doc_id long, text string, lang string, mask string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_of(docs, marks) == audit_plain(rows, labels)
    assert audit_of(docs.where("false"), marks) == {}
    assert audit_of(docs, marks.where("false")) == audit_plain(rows, [])
    real = read(spark, SF, "documents")
    want = audit_plain([(x.doc_id, x.text, x.lang) for x in real.select("doc_id", "text", "lang").collect()], [(x.doc_id, x.quality, x.toxic) for x in read(spark, SF, "labels").collect()])
    assert audit_of(real, read(spark, SF, "labels")) == want


def mine_plain(rows, step, by=256):
    """rows: (id, label, vector)."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(min(max(float(x) * by, -(1 << 24)), 1 << 24))) for x in v]
        best[i] = min(best.get(i, (label, ints)), (label, ints))
    out = set()
    for a, (label, v) in best.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, (lab, w) in best.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            found = [(i, -t) for t, i, lab in scored if lab != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out |= {(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("spread", [0.1, 3000.0])
def test_negatives_against_scoring_all(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    monkeypatch.setattr(negatives, "AT_A_TIME", 5)
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = (np.abs(r.normal(0, spread, 8)) if i % 3 else np.full(8, spread)).round(3).tolist()
        rows.append((i, int(r.integers(0, 3)) if i % 11 else 1, v))
    rows += [(None, 1, [0.1] * 8), (401, None, [0.1] * 8), (402, 1, None), (403, 1, [0.1, None]), (404, 1, [float("nan")] * 8), (405, 1, [float("inf")] * 8), (406, 1, [0.5] * 3), (408, 2, [0.4] * 3), (412, 1, [0.5] * 3), (416, 1, []), (420, 2, []), (424, 1, []), (428, 1, [1e300] * 8), (432, 1, [0.0] * 8)]
    rows += rows[:60] + [(4, 0, [0.2] * 8), (-8, 1, [0.3] * 8)]
    table = spark.createDataFrame([(*x, "clash", 3) for x in rows], "vec_id long, label int, embedding array<double>, id string, v int")
    got = negatives.mine(table, negatives.F.col("id") % 4 == 0)
    assert {tuple(x) for x in got.collect()} == mine_plain(rows, 4)
    assert negatives.mine(table.where("false"), negatives.F.col("id") % 4 == 0).count() == 0
    assert negatives.mine(table, negatives.F.lit(False)).count() == 0


def test_few_rows_are_scored_exactly(spark):
    """The file's bounds leave most rows out."""
    rows = read(spark, SF, "embeddings").collect()
    v = np.array([[int(np.floor(256 * float(x))) for x in r.embedding] for r in rows])
    low = v.min(axis=0)
    width = -(-(v.max(axis=0) - low + 1) // negatives.CELLS)
    bounds = negatives._Bounds(v[:20], low, width)
    upper = bounds(((v - low) // width).astype(np.uint8).T)
    exact = v @ v[:20].T
    assert (upper >= exact).all() and (upper - bounds.gap <= exact).all()
    kept = [(upper[:, j] >= negatives._kth(upper[:, j] - bounds.gap[j], 5)).mean() for j in range(20)]
    assert np.mean(kept) < 0.2


def test_blocks_meet_without_being_copied(spark, monkeypatch):
    """Many parts and blocks, a hot vector under two labels: neither side is exploded by the other's blocks, shuffled or broadcast to meet it."""
    for name, value in {"ROWS": 16, "ANCHORS": 4, "PART": 100, "ANCHOR_PART": 10, "PARTS": 3}.items():
        monkeypatch.setattr(negatives, name, value, raising=False)
    r = np.random.default_rng(8)
    rows = [(i, int(r.integers(0, 3)), [0.25] * 6 if i % 2 else np.abs(r.normal(0, 0.2, 6)).round(2).tolist()) for i in range(400)]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), negatives.F.col("id") % 5 == 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not any(x in plan for x in ("Generate", "SortMergeJoin", "BroadcastExchange"))
    assert {tuple(x) for x in got.collect()} == mine_plain(rows, 5)


def test_only_the_first_copies_of_a_block_are_met():
    ids, labels, v = np.array([9, 4, 7, 1, 2, 3]), np.array([1, 1, 1, 2, 1, 1]), np.array([[5], [5], [5], [5], [6], [5]], np.int32)
    assert ids[negatives._first_copies(ids, labels, v, 2)].tolist() == [4, 1, 2, 3]
    assert negatives._first_copies(ids, labels, np.empty((6, 0), np.int32), 6).tolist() == [0, 1, 2, 3, 4, 5]

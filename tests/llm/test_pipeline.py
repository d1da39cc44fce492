"""The corpus pipeline against plain Python, stage by stage; long texts, ties and clashing names for every operator."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import bpe, decontam, embeddings, html, licenses, lm, minhash, sharding, toxicity, urls


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[s : s + size]) for s in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def without_near_copies(rows):
    """Rows (id, text) of which each group of near copies keeps the one with the smallest id."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for (i, _), g in zip(rows, group, strict=True):
        first[g] = min(i, first.get(g, i))
    return [r for r, s, g in zip(rows, sets, group, strict=True) if not s or r[0] == first[g]]


def without_benchmark(rows, items):
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        n = min(len(w), 10)
        if n:
            windows[n].update(tuple(w[s : s + n]) for s in range(len(w) - n + 1))
    split = [(i, t, words(t)) for i, t in rows]
    return [(i, t) for i, t, w in split if not any(tuple(w[s : s + n]) in got for n, got in windows.items() for s in range(len(w) - n + 1))]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    """A folder with documents (toxic, near copies, benchmark passages, empty, long), labels and benchmark."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(21)
    vocabulary = [f"wo{rng.randrange(900)}" for _ in range(700)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([4, 12, 30]))) for _ in range(12)] + [None, ""]
    texts = []
    for i in range(420):
        w = rng.choices(vocabulary, k=rng.choice([6, 40, 40, 120]))
        if i % 7 == 0:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "scum"])
        if i % 11 == 3:
            w += words(items[i % 12])
        if i % 5 == 4 and i > 20:
            w = texts[i - 3][1].split()
            if i % 10 == 9 and len(w) > 30:
                w[-1] = "other"
        texts.append((i, " ".join(w)))
    texts += [(500, ""), (501, None), (502, "long " + " ".join(rng.choices(vocabulary, k=60_000))), (503, "One, TWO"), (504, "one, two")]
    labels = [(i, int("idiot" in t or "scum" in t)) for i, t in texts[:420] if i % 4]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items


def test_the_pipeline_keeps_what_plain_stages_keep(spark, corpus):
    import corpus_pipeline

    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "benchmark", "bpe"]
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert kept.columns == docs.columns
    # The classifier's decisions are those of its scores, and right on all of these texts.
    mild = [(i, t) for i, t in texts if not {"idiot", "scum"} & set(words(t))]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in mild]
    unique = without_near_copies(mild)
    clean = without_benchmark(unique, items)
    assert len(mild) > len(unique) > len(clean) > 100
    got = corpus_pipeline.run(spark, folder)
    want = []
    for i, t in clean:
        ids = bpe.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want


def test_the_pipeline_takes_empty_tables(spark, corpus, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shards_are_those_of_the_highest_score(docs):
    texts = [(i, f"text é {i}") for i in range(40)] + [(None, None), (7, "again")]
    got = sharding.assign(docs(texts))
    assert got.columns[:4] == ["doc_id", "size", "text_crc32", "shard"]
    plain = {(i, t): (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts}
    assert sorted(repr((r["size"], r.text_crc32)) for r in got.collect()) == sorted(repr(v) for v in plain.values())
    # Each shard's score is its own: with fewer shards, rows of the others stay where they are.
    wide = {(r.doc_id, r.text_crc32): r.shard for r in got.collect()}
    for shards in (1, 3, 9):
        for r in sharding.assign(docs(texts), weights=[1.0] * shards).collect():
            if wide[r.doc_id, r.text_crc32] < shards:
                assert r.shard == wide[r.doc_id, r.text_crc32]


def test_the_shard_of_a_key_is_that_of_the_highest_weighted_score(docs):
    """Scores worked out again from the hash: -weight / ln(u)."""
    xxhash = pytest.importorskip("xxhash")

    def shard(key, weights):
        text = "null" if key is None else f"k{key}"
        best = []
        for s, w in enumerate(weights):
            h = xxhash.xxh64(text.encode(), seed=42).intdigest()
            h = xxhash.xxh64(s.to_bytes(4, "little"), seed=h).intdigest()
            best.append((-w / math.log(((h >> 11) + 0.5) / (1 << 53)), -s))
        return -max(best)[1]

    keys = [None, 0, -5, *range(1, 400), 10**15]
    for weights in ([1.0] * 16, [1.0, 3.0, 0.5]):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(docs([(k, "x") for k in keys]), weights=weights).collect()}
        assert got == {k: (shard(k, weights), shard(k, [*weights, weights[-1]])) for k in keys}
    long = sharding.assign(docs([(1, "é" * 3_000_000)])).first()
    assert (long["size"], long.text_crc32) == (6_000_001, zlib.crc32("é".encode() * 3_000_000))


def test_clashing_columns_of_shards_stay(spark):
    rows = spark.createDataFrame([(1, 0, "kept", "kept too"), (2, 0, "b", "c")], "id long, shard int, _bucket string, _start string")
    got = sharding.slots(rows, "shard").orderBy("id").collect()
    assert [(r["_bucket"], r["_start"]) for r in got] == [("kept", "kept too"), ("b", "c")] and sorted(r.slot for r in got) == [0, 1]


def plain_scan(text, phrases, notices):
    """Places of phrases and, for each notice, the largest coverage by a chain of common runs, by trying all."""
    w = words(text)
    split, whole = [words(p) for p in phrases], f" {' '.join(w)} "
    found = [(s, n) for n, p in enumerate(split) for s in range(len(w)) if w[s : s + len(p)] == p]
    cover = {label: 1.0 for label, texts in notices.items() for t in texts if f" {' '.join(words(t))} " in whole}
    return found, cover


def plain_coverage(w, templates):
    """The largest share of each template in a chain of common runs: matching statistics by trying all lengths, chains by trying all runs before."""
    factors = {tuple(t[a:b]): [] for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    for n, t in enumerate(templates):
        for a in range(len(t)):
            for b in range(a + 1, len(t) + 1):
                factors[tuple(t[a:b])].append((n, b - 1))
    longest = [next((k for k in range(i + 1, 0, -1) if tuple(w[i - k + 1 : i + 1]) in factors), 0) for i in range(len(w))]
    runs = [(i, k) for i, k in enumerate(longest) if k >= licenses.LEAST_RUN and (i + 1 == len(w) or longest[i + 1] != k + 1)]
    out = {}
    seen = []
    for place, length in runs:
        new = []
        for n, end in factors[tuple(w[place - length + 1 : place + 1])]:
            value = length
            for m, last, at, had in seen:
                more = min(length, end - last, place - at)
                if m == n and place - length - at < licenses.GAP and more > 0:
                    value = max(value, had + more)
            new.append((n, end, place, value))
            out[n] = max(out.get(n, 0), value / len(templates[n]))
        seen += new
    return out


def test_license_scores_are_those_of_the_best_chain_of_runs():
    rng = random.Random(31)
    notices = {"one": ["a b c d e f g h i j k l m n", "p q a b c r s t"], "two": ["c d e f x y z a b c d", "b c d b c d b c d e"]}
    scanner = licenses.Scanner({}, notices)
    templates = [words(t) for ts in notices.values() for t in ts]
    partly = 0
    for _ in range(400):
        w = []
        for _ in range(rng.randrange(1, 7)):
            t = rng.choice(templates)
            a = rng.randrange(len(t))
            w += rng.choice([t[a : a + rng.randrange(1, 9)], rng.choices("abcdxyz", k=rng.randrange(14))])
        got = {n: span[0] for n, span in scanner([x.encode() for x in w])[1].items()}
        want = plain_coverage(w, templates)
        assert got == pytest.approx(want)
        partly += any(0.3 < v < 1 for v in want.values())
    assert partly > 100


def test_license_scans_find_what_stands_there(docs):
    rng = random.Random(13)
    filler = ["the", "code", "cc", "by", "rights", "general", "license", "é"]
    texts = []
    for i in range(60):
        w = rng.choices(filler, k=rng.randrange(30))
        for t in rng.sample([*licenses.PHRASES, *(x for ts in licenses.NOTICES.values() for x in ts)], k=rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = [t]
        texts.append((i, " ".join(w)))
    texts += [(100, "cc by " * 3), (101, "CC\nBY"), (102, "x " * 200_000 + "all rights reserved")]
    for r in licenses.scan(docs(texts)).collect():
        text = dict(texts)[r.doc_id]
        found, cover = plain_scan(text, licenses.PHRASES, licenses.NOTICES)
        labels = list(licenses.PHRASES.values())
        starts = [s for s, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words(text)), len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({labels[n] for _, n in found})) and set(cover) <= set(r.labels.split(",")) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_the_label_model_finds_who_is_right():
    rng = np.random.default_rng(5)
    n = 4000
    truth = rng.random(n) < 0.2
    rates = [(0.7, 0.02), (0.5, 0.05), (0.3, 0.3)]
    fires = np.stack([rng.random(n) < np.where(truth, a, b) for a, b in rates], 1)
    fires = np.column_stack([fires, fires[:, 0]]).astype(float)  # the last voter copies the first
    label = np.where(rng.random(n) < 0.9, truth, ~truth).astype(int)
    post = toxicity.label_model(fires, label, fires.T @ fires, n)
    # As good as the rule that knows all rates, and better than the labels.
    odds = np.log(0.2 / 0.8) + np.where(label == 1, np.log(9), -np.log(9))
    for k, (a, b) in enumerate(rates):
        odds += np.where(fires[:, k] == 1, np.log(a / b), np.log((1 - a) / (1 - b)))
    best = ((odds > 0) == truth).mean()
    assert ((post > 0.5) == truth).mean() > max((label == truth).mean(), best - 0.01)
    # Two voters that always agree say no more than one of them.
    alone = toxicity.label_model(fires[:, :3], label, fires[:, :3].T @ fires[:, :3], n)
    assert ((post > 0.5) == (alone > 0.5)).mean() > 0.97


def test_voters_of_all_documents_are_counted(docs):
    texts = [(i, ["idiot scum", "idiot", "x", None][i % 4]) for i in range(40)]
    together, n = toxicity._together(docs(texts), "text", [b"idiot.", b"scum."])
    assert n == 40 and together.tolist() == [[20, 10], [10, 10]]


def test_held_out_toxic_texts_are_found(spark, corpus):
    folder, texts, _ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score(docs.withColumn("held", toxicity.holds_out("doc_id")), toxicity.fit(docs, labels)).where("held").collect()
    truth = {i: bool({"idiot", "scum"} & set(words(t))) for i, t in texts}
    assert len(got) > 50 and all((r.score >= 0.5) == truth[r.doc_id] for r in got)


def test_very_long_texts(spark, docs):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(400_000)) + " idiot"
    texts = [(1, long), (2, long + " more"), (3, "x" * 1_500_000), (4, "idiot words")]
    bench = spark.createDataFrame([(1, " ".join(long.split()[200_000:200_012]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.scan(docs(texts), bench).collect()} == {1: 12, 2: 12, 3: 0, 4: 0}
    assert {r.id: r.component for r in minhash.groups(docs(texts)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    labels = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    assert {r.doc_id for r in toxicity.score(docs(texts), toxicity.fit(docs(texts), labels.where("false"))).where("score >= 0.5").collect()} == {1, 2, 4}
    got = {r.doc_id: r.n_tokens for r in lm.score(docs(texts), labels.select("doc_id")).collect()}
    assert got == {1: 400_001, 2: 400_002, 3: 1, 4: 2}


def test_clashing_names_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "c0", "mark", "chunk", 5)], "doc_id long, text string, mark string, c0 string, chunk string, score int")
    none = spark.createDataFrame([], "doc_id long")
    got = lm.score(docs, none)
    assert got.columns == ["doc_id", "mark", "c0", "chunk", "n_tokens", "target_loss", "background_loss", "score"] and got.first().mark == "c0"
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0
    assert urls.judge(spark.createDataFrame([], "url string"), urls.rules(spark, [])).count() == 0
    assert toxicity.remove(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert bpe.encode_table(docs).columns == ["doc_id", "mark", "c0", "chunk", "score", "n_tokens", "ids_sha256", "decoded_sha256"]

"""Encoding, decontamination, near-duplicates, licences, toxicity and model scores against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import bpe, decontam, licenses, lm, minhash, sharding, toxicity

ODD = [(1, None), (1, None), (None, "lone words here"), (2, ""), (3, "   "), (4, "a" * 3000 + " b" * 900 + "\n\n  c" * 100), (5, " " * 2000), (6, "it's    x 'tis'real''s" * 60), (7, "中文" * 900 + "。" + "٠" * 300), (8, "\x1c\x1d \x85" * 200), (6, "it's    x 'tis'real''s" * 60)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(600, 64), (64, 16)])
def test_chunks_are_encoded_as_whole_texts_are(docs, chunk, overlap):
    got = bpe.encode_table(docs(ODD), chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "k1", "score", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(i, len(ids := bpe.encode(t or "")), digest(" ".join(map(str, ids))), digest(t or "")) for i, t in ODD]
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()))) == sorted(map(repr, want))


def test_runs_of_millions_of_characters_are_encoded(docs):
    import public_tokenizers
    import regex

    n = 2_000_000
    texts = ["x" + " " * n, "\n" * n, "a" * n, "中" * 1_000_000, "word " * 30_000 + " " * 100_000 + "end. 12" * 9_000 + "é" * 70_000 + " tail" * 9_000, "x" + " " * 100_000 + "y's " * 100]
    one = bpe._codec(bpe.RANKS)[0]._core_bpe.encode_single_piece
    want = []
    for i, t in enumerate(texts):
        ids = [k for m in regex.finditer(public_tokenizers.PATTERN, t) for k in one(m[0].encode())]
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(t)))
        assert bpe.encode(t) == ids
    got = bpe.encode_table(docs(list(enumerate(texts))).repartition(3))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want


@pytest.mark.parametrize("seed", range(4))
def test_pieces_join_to_the_text_and_encode_alone(docs, seed):
    rng = random.Random(seed)
    texts = []
    for i in range(30):
        parts = [rng.choice([" ", "\n", "  \n ", "a", "bcd", "12", "'s", "!?", "é", "\xa0", "\x1c"]) * rng.choice([1, 1, 2, 3, 40, 90]) for _ in range(rng.randrange(1, 40))]
        texts.append((i, "".join(parts)))
    table = docs(texts).select(F.col("doc_id").cast("string").alias("digest"), "text")
    joined = defaultdict(list)
    for r in sorted(bpe.pieces(table, 64, 16).collect(), key=lambda r: (r.digest, r.piece)):
        joined[int(r.digest)].append(r.text)
    for i, t in texts:
        assert "".join(joined[i]) == t
        assert [k for x in joined[i] for k in bpe.encode(x)] == bpe.encode(t)


def test_no_texts_give_no_rows(spark, docs):
    none = docs([])
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert bpe.encode_table(none).count() == decontam.scan(none, bench).count() == minhash.groups(none).count() == 0
    assert licenses.scan(none).count() == sharding.assign(none).count() == minhash.keep_one(none).count() == 0
    assert decontam.scan(docs(ODD), bench.where("false")).where("n_hit > 0").count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(texts, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add("" if i is None else str(i))
    for i, t in texts:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= got
        yield (i, len(w), len(hit), ",".join(sorted(found)))


def test_shared_spans_are_found_word_for_word(spark, docs):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "Été", "été", "ΑΣ", "x9", "ümlaut"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 10, 11, 14, 40])))) for k in range(12)] + [(50, None), (51, ""), (None, "Beta x9 Beta gamma"), (3, "again alpha")]
    texts = [(k, ", ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 8, 30, 120])))) for k in range(30)]
    texts += [(100 + k, f"Start {t or ''}! end") for k, (_, t) in enumerate(items)] + [(7, None), (7, None), (None, items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(docs(texts), bench)
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()))) == sorted(map(repr, hits(texts, items)))
    clean = {i for i, _, n, _ in hits(texts, items) if not n}
    left = decontam.remove(docs(texts), bench)
    assert left.columns == docs([]).columns
    assert {r.doc_id for r in left.collect()} == clean


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[s : s + size]) for s in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def grouped(texts, size, percent=80):
    sets = [shingles(t, size) for _, t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sets, group


def similar_texts(rng):
    texts = [(None, "null id"), (901, "One"), (902, "one"), (903, ""), (904, None), (905, " \t "), (906, "one two"), (906, "one two")]
    for family in range(6):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(len(base) // 8 + 2)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(400)}"
            texts.append((len(texts), " ".join(copy)))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies_are_grouped_as_all_pairs_say(docs, size):
    texts = similar_texts(random.Random(size))
    sets, group = grouped(texts, size)
    least = {}
    for (i, _), g in zip(texts, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(repr((i, len(s), i if not s else least.get(g))) for (i, _), s, g in zip(texts, sets, group, strict=True))
    got = minhash.groups(docs(texts), size=size)
    assert sorted(repr((r.id, r.n_shingles, r.component)) for r in got.collect()) == want
    kept = minhash.keep_one(docs(texts), size=size)
    assert kept.columns == docs([]).columns
    assert kept.count() == len({g for g, s in zip(group, sets, strict=True) if s}) + sum(not s for s in sets)


def test_phrases_and_notices(docs):
    texts = [(1, "Licensed under CC BY-NC 4.0."), (2, "all rights reserved, ALL Rights reserved"), (3, None), (4, "Released under the MIT License"), (5, "cc\xa0by"), (1, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licenses.scan(docs(texts)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels, got[1].score) == (1, 2, "cc-by", "cc-by,cc-by-nc", 1.0)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (6, 2, 0, 3, "reserved")
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert (got[4].n_base, got[4].base_labels, got[4].labels) == (0, "", "mit") and got[5].n_base == 0


def test_the_automaton_knows_the_longest_run_of_template_words():
    rng = random.Random(1)
    for _ in range(100):
        templates = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 8))] for _ in range(rng.randint(1, 4))]
        automaton, text = licenses.Automaton(templates), [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(25)]
        seen = {p: (n, s) for p, n, s in automaton.statistics(text)}
        for i in range(25):
            ends = {n: {(k, e) for k, t in enumerate(templates) for e in range(n - 1, len(t)) if t[e - n + 1 : e + 1] == text[i - n + 1 : i + 1]} for n in range(1, i + 2)}
            longest = max((n for n, e in ends.items() if e), default=0)
            length, state = seen.get(i, (0, 0))
            assert length == longest and (not longest or set(automaton.places[state]) == ends[longest])


def test_short_runs_do_not_evict_a_long_one():
    repeated = [w for i in range(10) for w in ("x", "y", "z", f"s{i}")]
    one, two = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(140)]
    scanner = licenses.Scanner({}, {"own": [" ".join(repeated + one + two)]})
    _, spans = scanner(licenses.words(" ".join([*one, "other", "x", "y", "z", "other", *two])))
    assert spans[0] == (240 / 280, 0, 244)


def test_toxic_words_and_hidden_patterns_are_learned(spark, docs):
    rng = random.Random(5)
    words = [f"wo{rng.randrange(500)}" for _ in range(400)]
    texts, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = rng.choices(words, k=40)
        if toxic:
            w[rng.randrange(40)] = rng.choice(["idiot", "moron"]) if i % 12 else f"zzqx{rng.randrange(99)}"
        texts.append((i, " ".join(w)))
        if i % 3 == 0 or not toxic:
            labels.append((i, int(toxic)))
    texts += [(5000, None), (5001, ""), (None, "you idiot"), (5002, "ZZQX7 idiot")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(texts), table)
    got = toxicity.score(docs(texts), model)
    score = {r.doc_id: r.score for r in got.collect()}
    assert all((score[i] >= 0.5) == (i % 6 == 0) for i in range(900))
    assert score[5000] == score[5001] < 0.5 <= score[5002] and score[None] >= 0.5
    assert toxicity.remove(docs(texts), table).count() == 900 - 150 + 2
    bare = toxicity.fit(docs(texts), table.where("false"))
    assert {r.doc_id for r in toxicity.score(docs(texts), bare).where("score >= 0.5").collect()} >= {None, 5002}


def test_held_out_labels_are_never_read(spark, docs):
    texts = [(i, f"word{i} idiot" if i % 2 else f"word{i}") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.holds_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs(texts), x) for x in (labels, flipped))
    assert a.patterns == b.patterns and np.allclose(a.weights, b.weights) and a.bias == b.bias


def plain_losses(texts, target, fresh):
    """(tokens, background's and target's loss) of each row, from counts of all rows but itself."""
    rows = [(i, plain_words(t), 0 if i is None or i not in target else 1) for i, t in texts] + [(i, plain_words(t), 2) for i, t in fresh]
    one, two, n = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for _, w, m in rows:
        if m < 2:
            n[m] += len(w)
            one[m].update(w)
            two[m].update(zip(w, w[1:]))
    size = len(set(one[0]) | set(one[1])) + 1
    for i, w, mark in rows:
        losses = []
        own, pairs = Counter(w), Counter(zip(w, w[1:]))
        for m in (0, 1):
            mine, out = int(mark == m), 0.0
            for k, x in enumerate(w):
                p = (one[m][x] - mine * own[x] + lm.ADD) / (n[m] - mine * len(w) + lm.ADD * size)
                before = one[m][w[k - 1]] - mine * own[w[k - 1]] if k else 0
                if before:
                    p = lm.MIX * (two[m][w[k - 1], x] - mine * pairs[w[k - 1], x]) / before + (1 - lm.MIX) * p
                out -= np.log(p)
            losses.append(out / max(1, len(w)))
        yield i, len(w), *losses


@pytest.mark.parametrize("chunk, buckets", [(1 << 21, 24), (50, 3)])
def test_losses_are_those_of_all_other_texts(spark, docs, monkeypatch, chunk, buckets):
    monkeypatch.setattr(lm, "BUCKETS", buckets)
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choices(["alpha", "Beta", "été", "x9", "中文", "w", "Z"], k=rng.randrange(30)))) for i in range(60)]
    texts += [(1, texts[1][1]), (None, "alpha w w"), (None, None), (70, ""), (71, "?! ."), (72, "only here"), (73, "only, HERE")]
    fresh = [(900, "alpha alpha unheard Beta"), (901, None), (902, texts[3][1])]
    target = spark.createDataFrame([(1,), (None,), (3,), (3,), (8,), (70,), (500,)], "doc_id long")
    got = lm.score(docs(texts), target, docs(fresh), chunk=chunk)
    assert got.columns == ["doc_id", "k1", "n_tokens", "target_loss", "background_loss", "score"]
    want = sorted((repr(i), n, b, t, t - b) for i, n, b, t in plain_losses(texts, {1, 3, 8, 70, 500}, fresh))
    rows = sorted((repr(r.doc_id), r.n_tokens, r.background_loss, r.target_loss, r.score) for r in got.collect())
    assert [r[:2] for r in rows] == [w[:2] for w in want] and np.allclose([r[2:] for r in rows], [w[2:] for w in want])


def test_models_of_nothing(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert lm.score(docs([]), none).count() == 0
    got = {r.doc_id: r for r in lm.score(docs([(1, "a b"), (2, "a b"), (3, None)]), none).collect()}
    assert got[1].score == got[2].score and got[1].target_loss == pytest.approx(np.log(3)) and got[3].score == 0


def test_words_of_any_length_and_place_are_hashed_alike():
    from loomspan.llm import hashing

    rng = random.Random(2)
    long = "".join(rng.choices("ab Cdé", k=3_000_000)) + "X" * 2_500_000 + " tail" + "," * 1_200_000 + "End"
    texts = ["", "One two", long, "two", "", "é" * 700_000, "ONE"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    first, got = hashing.word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, lm._LETTER)
    words = [plain_words(t) for t in texts]
    assert np.diff(first).tolist() == list(map(len, words))
    ids = {}
    flat = [w for ws in words for w in ws]
    assert all(ids.setdefault(w, h) == h for w, h in zip(flat, got.tolist(), strict=True)) and len(set(ids.values())) == len(ids)


def test_one_more_shard_only_takes_rows(docs):
    texts = [(i % 300, f"text {i}") for i in range(600)] + [(None, None), (None, None)]
    got = sharding.assign(docs(texts)).collect()
    assert len(got) == len(texts) and all(r.grown_shard in (r.shard, 16) for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == 301
    for shard in range(16):
        mine = sorted(r.slot for r in got if r.shard == shard)
        assert mine == list(range(len(mine)))
    none = [r for r in got if r.doc_id is None]
    assert [(r["size"], r.text_crc32) for r in none] == [(1, 0), (1, 0)]
    heavy = sharding.assign(docs(texts), weights=[1.0, 3.0]).groupBy("shard").count().collect()
    assert {r.shard: r["count"] > 300 for r in heavy} == {0: False, 1: True}

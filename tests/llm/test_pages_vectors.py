"""URLs, pages and embeddings."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import embeddings, html, urls
from loomspan.llm.components import components
from loomspan.llm.queries import URL_RULES


def test_the_longest_listed_entry_decides(spark):
    pages = [
        (1, None, "", "", None, "allow"), (2, "abc", "", "", None, "allow"), (3, "HTTP://NET/x", "net", "/x", "net/", "block"),
        (4, "x://a.Example.net/en/1?q=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"), (5, "x://example.net/en?", "example.net", "/en", "net/", "block"),
        (6, "x://example.net", "example.net", "", None, "allow"), (7, "x://example.com/de/#a", "example.com", "/de/", "example.com/de/", "block"),
        (8, "x://notexample.com/de/", "notexample.com", "/de/", None, "allow"), (9, "y://b.org?/fr/", "b.org", "", None, "allow"),
        (None, "y://b.org/fr/z", "b.org", "/fr/z", "org/fr/", "allow"), (None, "y://b.org/fr/z", "b.org", "/fr/z", "org/fr/", "allow"), (11, "://net//en/", "net", "//en/", "net/", "block"),
    ]
    table = spark.createDataFrame([(i, u, "old", "old") for i, u, *_ in pages], "page_id long, url string, host string, h string")
    got = urls.judge(table, urls.rules(spark, URL_RULES))
    assert sorted(repr((r.page_id, r.url, r.host, r.path, r.rule, r.verdict)) for r in got.collect()) == sorted(map(repr, pages))
    assert urls.judge(table.limit(0), urls.rules(spark, URL_RULES)).count() == 0
    assert urls.judge(table, urls.rules(spark, URL_RULES).limit(0)).where("rule is not null").count() == 0


def test_a_filter_never_misses_and_the_join_removes_what_it_lets_pass(spark):
    listed = urls.rules(spark, [(f"h{i}.example", "/", "block") for i in range(300)])
    pages = spark.createDataFrame([(i, f"http://h{i}.example/a") for i in range(900)], "page_id long, url string")
    got = urls.judge(pages, listed)
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(300))


BODY = "<p>Hello, this is the first long paragraph, with commas.</p><p>Second one &amp; more\n text follows, here&nbsp;it is.</p>"
TEXT = "Hello, this is the first long paragraph, with commas.\nSecond one & more text follows, here it is."


def test_main_text():
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text(f"<nav><a href=x>home</a></nav><article><h1>T</h1>{BODY}</article><footer>f</footer>") == f"T\n{TEXT}"
    assert html.main_text(f'<div id=menu><a href=x>home</a></div><div class="content">{BODY}<ul><li>one<li>two</ul></div><div class=comments><p>Nice post, I really, really liked it, thanks a lot.</p></div>') == f"{TEXT}\none\ntwo"
    assert html.main_text(f'<header><h1>Site</h1></header><main><article><header><h1>T</h1></header>{BODY}<aside>side</aside><form>f<input></form><section class="comments">c</section></article></main>') == f"T\n{TEXT}"
    assert html.main_text(f'<div class="cookie-notice"><p>We use cookies, many cookies, on this long page of ours.</p></div><div>{BODY}</div><div class="ad-slot"><p>Buy, buy, buy now, all of the things.</p></div>') == TEXT
    assert html.main_text('<p>unclosed "quote <a href="x>y and a < b') and html.main_text("<<<>>> a < b") == "<<<>>> a < b"
    assert html.main_text("<div>" * 5000 + "deep text that is long enough, to count") == "deep text that is long enough, to count"
    assert html.main_text("<article><p>cut off in the middle, of a long tag <b") == "cut off in the middle, of a long tag"


def test_pages_keep_their_rows(spark):
    table = spark.createDataFrame([(1, "u", BODY, "x"), (1, "u", BODY, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html.extract(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, [(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, None, "", 0)]))
    assert html.extract(table.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(500, 500 + k) for k in range(1, 30)] + [(rng.randrange(600, 640), rng.randrange(600, 640)) for _ in range(25)]
    group = {n: n for e in edges for n in e}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: g for n, g in group.items() if n != g}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_vectors_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for _ in range(40):
            rows.append((len(rows), rng.standard_normal(16).tolist(), label))
        base = rng.standard_normal(16)
        for _ in range(60):
            rows.append((len(rows), (base + 0.25 * rng.standard_normal(16)).tolist(), label))
    rows += [(len(rows), rows[0][1], 0), (len(rows) + 1, rows[0][1], 0), (900, None, 0), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, [], 0), (906, [1.0, 2.0], 0), (None, [5.0, 1.0], 0), (906, [1.0, 2.0], 0)]
    fine = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, group = [0] * len(rows), list(range(len(rows)))
    for a in fine:
        for b in fine:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                n[a] += 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(repr((i, k, least.get(g))) for (i, _, _), k, g in zip(rows, n, group, strict=True))
    got = embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in got.collect()) == want


def test_one_link_between_two_tight_groups_is_found(spark):
    rng = np.random.default_rng(6)

    def near(degrees):
        x = 0.002 * rng.standard_normal(16)
        x[:2] += [np.cos(np.radians(degrees)), np.sin(np.radians(degrees))]
        return x.tolist()

    rows = [(1000 * label + i, near(at), label) for label in range(6) for i, at in enumerate([0.0] * 199 + [25.84] * 199 + [3.0, 23.84])]
    got = embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component_id for r in got} == {1000 * label for label in range(6)}
    assert all(r.n_links == 199 + (r.vec_id % 1000 >= 398) for r in got)


def nodes_of(spark, x):
    return spark.createDataFrame([(f"{i:04d}", "l", v.tolist(), x.shape[1], 1) for i, v in enumerate(x)], "node string, label string, vec array<double>, dim int, n long")


def test_saturated_lists_are_doubled_and_gain_links(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3, 24)).repeat(30, 0) + 0.1 * rng.standard_normal((90, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = int((x @ x.T >= 0.93).sum()) - 90
    assert true == 3 * 30 * 29
    found = {}
    for widest in (5, 40):
        search = embeddings.Search(nodes_of(spark, x), 0.93, 5, widest, 0.05, 8, 8)
        search.descend(0)
        found[widest] = search.links().count()
        lists = {r.a: r for r in search.graph.groupBy("a").agg(F.count("*").alias("n"), F.max("width").alias("width")).collect()}
        assert all(r.n <= r.width <= widest for r in lists.values())
    assert found[5] < 0.5 * true and found[40] == true


def test_a_miss_is_seen_and_searched_again_or_raised(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        x = rng.standard_normal(16)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (x + 0.3 * rng.standard_normal(16)).tolist(), 0)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = (x @ x.T >= 0.93).sum(1) - 1
    assert true.sum() > 200
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, recall = embeddings.linked(table)
    assert recall == 1 and {r.vec_id: r.n_links for r in got.collect()} == dict(enumerate(true.tolist()))
    monkeypatch.setattr(embeddings, "BUCKET", 1)
    monkeypatch.setattr(embeddings, "SEARCHES", 1)
    with pytest.raises(RuntimeError, match="of the links"):
        embeddings.linked(table, miss=0.999, rounds=0)


def test_tables_are_as_many_as_the_miss_rate_needs():
    meets = 1 - np.arccos(0.93) / np.pi
    for bits in range(1, 25):
        t = embeddings.tables_for(bits, 0.93, 0.05)
        assert (1 - meets**bits) ** t <= 0.05 < (1 - meets**bits) ** (t - 1)


def test_no_vectors_give_no_rows(spark):
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (2, [0.0], 0), (3, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embeddings.link(odd).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_short_sections_and_further_articles_stay():
    long = "<p>" + "Words of a long paragraph, in a section, with commas, " * 6 + "</p>"
    page = f"<div><div>{long * 10}</div><div><p>A short section that is part of the text, too</p></div><p>Tiny.</p><div><a href=x>more</a> <a href=y>links</a></div>loose words</div>"
    got = html.main_text(page).split("\n")
    assert got[10:] == ["A short section that is part of the text, too", "Tiny.", "loose words"] and len(got) == 13
    page = f"<main><article>{long * 3}</article><article><p>Second, short one.</p></article><article class=comment><p>Nice.</p></article></main>"
    assert html.main_text(page).split("\n")[3:] == ["Second, short one."]

"""Main text of made pages, and of random trees against a plain scorer."""

from __future__ import annotations

import random
import time

import pytest

from loomspan.llm import html

P = "<p>Hello, this is the first long paragraph, with commas.</p><p>Second one follows, here it is, in full length.</p>"
T = "Hello, this is the first long paragraph, with commas.\nSecond one follows, here it is, in full length."
LONG = "<p>" + "A paragraph that is long enough, with commas, to count. " * 4 + "</p>"
LONG_T = ("A paragraph that is long enough, with commas, to count. " * 4).strip()
LINKS = '<div class="x"><a href=/a>One link</a> <a href=/b>and another link</a></div>'

PAGES = [
    (f'<div class="content has-sidebar">{P}</div>', T),
    (f'<div id="page" class="site no-sidebar">{P}</div>', T),
    (f'<div class="post share-enabled">{P}</div>', T),
    (f'<form action="x">{P}<input name=y></form>', T),
    (f'<h1>Title</h1><form action="x"><div>{P}</div></form>', f"Title\n{T}"),
    (f'<div class="layout-sidebar-left"><div id="c">{LONG * 3}</div><div class="sidebar"><p>Side text, of some length, is here.</p></div></div>', "\n".join([LONG_T] * 3)),
    (f'<div class="post"><div class="article-header"><h1>Title</h1></div><div>{P}</div></div>', f"Title\n{T}"),
    (f'<div class="site-header"><h1>Site</h1></div><div class="post">{P}</div><div class="site-footer"><p>Footer, with words, and more of them here.</p></div>', T),
    (f'<div id="wrap"><div><header><h1>Title</h1></header><div>{P}</div></div><footer>f</footer></div>', f"Title\n{T}"),
    (f'<div><header><h1>Site</h1></header>{P}<footer>foot</footer></div>', T),
    (f'<div id="main">{P}</div><div id="comments"><p>{"I liked it a lot, really, thanks for the text. " * 30}</p></div>', T),
    (f'<div>{LONG * 4}</div><div class="related"><p>Related, some text, that is long enough to count.</p></div>{LINKS}', "\n".join([LONG_T] * 4)),
    (f'<div id="a"><div class="part">{LONG * 3}</div><div class="part"><div>{P}</div></div><div class="other"><a href=x>{P[3:40]}</a></div></div>', "\n".join([LONG_T] * 3) + f"\n{T}"),
    (f'<body>{P}<div class="ad"><p>Buy, buy, buy now, all of the things.</p></div><div class="newsletter"><form><p>Your mail, please, for our letter.</p></form></div></body>', T),
    ('<div class="comments"><p>Only a comment, nothing else.</p></div>', ""),
    (f'<section><h2>One</h2>{P}</section><section><h2>Two</h2>{P}</section>', f"One\n{T}\nTwo\n{T}"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_pages_without_an_article_element(page, want):
    assert html.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>" if not page.startswith("<body>") else page) == want


def test_points_choose_among_articles():
    page = f"<body><div><article><p>A short teaser, nothing more.</p></article></div><div><article>{LONG * 5}</article></div></body>"
    assert html.main_text(page) == "\n".join([LONG_T] * 5)


@pytest.mark.parametrize("start", ["<div>", "<span>", "<div class=ad>", "<b><i>"])
def test_deep_pages_take_time_in_proportion(start):
    began = time.perf_counter()
    html.main_text(start * 20_000 + "<p>some text that is, long enough to count</p>" * 2000)
    assert time.perf_counter() - began < 10


def made(rng, depth=0):
    """A random tree: (tag, class, children) with texts (text, linked)."""
    if depth > 3 or depth > 1 and rng.random() < 0.4:
        words = " ".join(rng.choice(["word", "longer", "text,", "of,"]) for _ in range(rng.choice([2, 6, 12, 40, 90])))
        return ("p", "", [(words, rng.random() < 0.2)])
    return (rng.choice(["div", "div", "section"]), rng.choice(["", "", "", "kind", "promo", "comments"]) if depth else "", [made(rng, depth + 1) for _ in range(rng.choice([1, 2, 2, 3, 4]))])


def written(node):
    tag, kind, inner = node
    if tag == "p":
        text, linked = inner[0]
        return f"<p><a href=x>{text}</a></p>" if linked else f"<p>{text}</p>"
    return f'<{tag} class="{kind}">' + "".join(map(written, inner)) + f"</{tag}>"


def plain(root):
    """The text that the docstring promises, by walking the tree for each question; None where a mark may be lifted."""
    bad = ("promo", "comments")
    nodes = []

    def walk(node, up, marked):
        marked = marked or node[1] in bad
        nodes.append((node, up, marked))
        me = len(nodes) - 1
        if node[0] != "p":
            for child in node[2]:
                walk(child, me, marked)

    walk(root, -1, False)

    lines = [[] for _ in nodes]
    for i, (_, up, _) in enumerate(nodes):
        lines[i] = [up, *lines[up]] if up >= 0 else []

    def below(i):
        return [j for j in range(i, len(nodes)) if j == i or i in lines[j]]

    def ancestors(j):
        return lines[j]

    def points(i):
        text, linked = nodes[i][0][2][0]
        if linked:
            return 0.0
        return len(text) / 100 if len(text) < 25 else 1 + text.count(",") + min(len(text) / 100, 3)

    texts = [i for i, (n, _, _) in enumerate(nodes) if n[0] == "p"]
    free = [i for i in texts if not nodes[i][2]]
    if 4 * sum(map(points, free)) < sum(points(i) for i in texts if nodes[i][2]) or not free:
        return None
    score = {}
    for i in free:
        for level, up in enumerate(ancestors(i)[:4]):
            score[up] = score.get(up, 0) + points(i) / 2**level
    share = {}
    for up in range(len(nodes)):
        own = [nodes[i][0][2][0] for i in below(up) if i in free]
        share[up] = sum(len(t) for t, linked in own if linked) / max(1, sum(len(t) for t, _ in own))
    score = {up: x * (1 - share[up]) for up, x in score.items()}
    top = max(score, key=lambda n: (round(score[n], 9), -n))
    kept, chain = {top}, [top, *ancestors(top)]
    for level, n in enumerate(chain):
        up = nodes[n][1]
        for k in range(len(nodes)):
            if k != n and nodes[k][1] == up and up >= 0 and not nodes[k][2] and share[k] < 0.5 and any(i in free for i in below(k)):
                if level == 0 or nodes[k][0][:2] == nodes[n][0][:2]:
                    kept.add(k)
    return "\n".join(nodes[i][0][2][0][0] for i in free if any(k in kept for k in [i, *ancestors(i)]))


def test_random_trees_are_scored_as_said():
    rng = random.Random(11)
    compared = 0
    for _ in range(300):
        root = ("div", "", [made(rng)])
        want = plain(root)
        if want is not None:
            page = "<body>" + "<div>" * 4 + written(root) + "</div>" * 4 + "</body>"
            got = html.main_text(page)
            top = html.Page(page)
            score, _, _ = top.scores(top.points(), top.unmarked(top.points()))
            if max(score, key=lambda n: (round(score[n], 9), -n)) > 5:  # a container of the tree itself
                assert got == want
                compared += 1
    assert compared > 100


COUNCIL = "The council met on Monday, and after long talks, it agreed on the plan for the river, the bridge and the road."
FURTHER = "Another paragraph follows here, with more words, commas, and a reasonable length to count as text of the page."

#: Names of topics that hold a word of layouts: nothing in them may be lost.
TOPICS = [
    f'<article><h1>T</h1><p>{COUNCIL}</p><section id="related-work"><p>{FURTHER}</p></section></article>',
    f'<article><h1>T</h1><p>{COUNCIL}</p><section class="form-of-government"><p>{FURTHER}</p></section></article>',
    f'<article><h1>T</h1><p>{COUNCIL}</p><p class="alert">{FURTHER}</p></article>',
    f'<article class="legal-analysis"><h1>T</h1><p>{COUNCIL}</p><p>{FURTHER}</p></article><div class="blurb"><p>Short words, few.</p><p>Short words, more.</p><p>Short words, end, now, here.</p></div>',
    f'<div class="intro"><p>Short intro, some words, in a line that is long enough.</p></div><article class="post category-social"><h1>T</h1><p>{COUNCIL}</p><p>{FURTHER}</p></article>',
    f'<main><p>{COUNCIL}</p><div class="discussion-of-results"><p>{FURTHER}</p></div></main>',
    f'<main><p>{COUNCIL}</p><section id="search-for-meaning"><p>{FURTHER}</p></section></main>',
    f'<article class="tag-advertising topic-cookies"><p>{COUNCIL}</p><p>{FURTHER}</p></article>',
    f'<article class="newsletter-edition-4"><p>{COUNCIL}</p><blockquote class="legal">{FURTHER}</blockquote></article>',
    f'<article><p>{COUNCIL}</p><div class="banner-headline-story"><p>{FURTHER}</p></div></article>',
    f'<article><p>{COUNCIL}</p><table><tr><td class="notice">{FURTHER}</td></tr></table></article>',
    f'<article><p>{COUNCIL}</p><ul><li class="follow">{FURTHER}</li></ul></article>',
    f'<div id="content"><h1>T</h1><p>{COUNCIL}</p><div class="menu-engineering"><p>{FURTHER} {COUNCIL}</p><p>{COUNCIL}</p></div></div>',
    f'<article><p>{COUNCIL}</p><section class="sharing-economy"><p>{FURTHER}</p></section></article>',
    f'<article class="sponsor-profile"><p>{COUNCIL}</p><section class="copyright-law"><p>{FURTHER}</p></section></article>',
]
#: The same words where they do mark: what they hold goes.
CHROME = [
    f'<article><p>{COUNCIL}</p><div class="share-buttons"><a href="/x">{FURTHER}</a></div></article>',
    f'<article><p>{COUNCIL}</p><div class="newsletter-signup-box"><p>{FURTHER}</p></div></article>',
    f'<article><p>{COUNCIL}</p><div class="ad-slot-3"><p>{FURTHER}</p></div></article>',
    f'<article><p>{COUNCIL}</p><p>{COUNCIL}</p></article><article class="comment"><p>{FURTHER}</p></article>',
    f'<div><p>{COUNCIL}</p><p>{COUNCIL}</p></div><div class="user-comments-area"><p>{FURTHER}</p></div>',
    f'<div><p>{COUNCIL}</p><p>{COUNCIL}</p></div><div class="acme-cookie-consent"><p>Short notice, few words.</p></div>'.replace("Short notice, few words.", FURTHER[:40]),
    f'<article><p>{COUNCIL}</p><section class="related-articles-more"><ul><li><a href="/a">{FURTHER}</a></li></ul></section></article>',
    f'<article><p>{COUNCIL}</p><p class="advert">{FURTHER}</p></article>',
]


@pytest.mark.parametrize("page", TOPICS)
def test_no_text_is_lost_to_a_word_in_a_name(page):
    got = html.main_text(f"<html><body>{page}</body></html>")
    assert COUNCIL in got and FURTHER in got


@pytest.mark.parametrize("page", CHROME)
def test_names_of_the_layout_still_mark(page):
    got = html.main_text(f"<html><body>{page}</body></html>")
    assert COUNCIL in got and FURTHER[:40] not in got

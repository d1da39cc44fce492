"""Main text of web pages by tree scoring.

The page is read into a tree that forgives missing end tags. Each paragraph (a run of text
in one block) gets points for its length and commas, less its share of linked text, and passes them to its ancestors:
all to the first, half to the next and so on, LEVELS of them. A container's sum is discounted by its share of linked text.
The container with the highest score is kept, of equal ones the outermost, and with it

- its siblings and the text beside it, unless they are mostly links;
- the siblings of an ancestor that are of its kind (the same tag and class), such as further sections or parts, and h1 titles;
- within an article or main element, all siblings of its ancestors up to that element, and beyond it only further articles beside an article, and h1 titles.

Scripts, styles, menus, footers, sidebars in elements of that meaning, and hidden parts are never read. Elements that their class, id, role or tag
mark as something else (forms, headers of the page, adverts, notices, comments) neither give nor keep
text, but a mark is only a discount: where an element so marked outweighs all that is unmarked, as LIFTED says for each mark,
the mark is lifted (that of reader comments only where nothing else has text). So a name of the layout, or a form, around
the whole page empties no page. Words that follow `has`, `no` or `with` in a name are no marks. A name that also has words which are neither marks nor of the layout
(`related-work`, `form-of-government`) marks its element only where that holds little text or mostly links; articles are marked as comments only; and a paragraph in an article isn't
marked by words that articles use themselves (`alert`, `legal`).

Character references are decoded, white space inside a block becomes one space, and blocks are joined by line
feeds. Defined cases: a null or empty page, and one without text, gives an empty text; if no paragraph has points, all unmarked text is kept; ties go to the outermost
and then the first container; markup cut off anywhere is read as far as it goes; the time grows with the page's length, however deep it is nested;
null ids, repeated rows and further columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of HTML by what they do here (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template iframe svg math canvas object video audio button select option textarea input nav menu aside footer dialog title datalist map noembed noframes".split())
PARAGRAPHS = frozenset("p pre td th li blockquote dd dt h1 h2 h3 h4 h5 h6 figcaption caption address summary".split())
#: Elements that a start tag ends, and those beyond which it does not look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id values that mark what isn't the article, and those of reader comments.
MARKED = frozenset(
    """ad ads adbox adsense advert adverts advertisement advertising adslot banner banners sponsor sponsored sponsors promo promos promotion promoted affiliate
    cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox paywall newsletter subscribe subscription signup
    sidebar sidebars aside widget widgets rail related recommended recommendations share sharing social follow
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer foot copyright legal
    form login search skip""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
HEADERS = frozenset("header".split())
#: Words before a marked one that make a name one of the layout, those after it, and those before `header` that make it the article's.
STATES, SWITCHES = frozenset("has have no not with without is hide show".split()), frozenset("enabled disabled".split())
OWN = frozenset("article post entry story".split())
#: Words of a layout that say nothing of what an element is for.
LAYOUT = frozenset(
    """box block blocks container wrapper wrap list lists bar section sections area areas panel panels link links inner outer item items content contents left right top bottom center middle main site page pages global local primary secondary
    first last next prev previous js btn button buttons icon icons row rows col cols column columns group groups grid slot slots unit units module modules component view card cards text title titles heading label labels body base
    user users reader readers author date meta avatar thread count number id ui app web html default custom plugin div span sticky fixed floating inline mobile desktop small medium large big mini wide full half fluid clear clearfix media post article entry story articles posts stories
    mailing email print tools tool settings policy privacy bottombar topnav subnav"""
    .split()
)
#: Marks that are words of articles as well.
SOFT = frozenset("alert notice notices notification legal form search follow related recommended recommendations social share sharing rail skip banner overlay popup discussion respond reply".split())
#: Points with which an element is kept whose name only contains a mark, in an article and elsewhere.
OUTWEIGHS = (1.0, 3.0)
#: Elements that no class marks.
NEVER = frozenset("main html body h1 h2 h3 h4 h5 h6".split())
LEAST, COMMA, LENGTH, MOST = 25, 1.0, 100, 3.0
LEVELS = 4
#: Marks of an element, the stronger the higher: none, the header of a page or an article, a form, something else, reader comments.
FREE, HEADER, FORM, OTHER, COMMENT = range(5)
#: A mark is lifted where what it marks has this many times the points of all that is unmarked, and so many points; and so many where nothing is unmarked.
LIFTED = {FORM: (1, 3, 3), OTHER: (4, 10, 3), COMMENT: (float("inf"), 10, 10)}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _of_name(name: str) -> tuple[int, bool, bool]:
    """What the words of one class or id say; whether other words stand beside them, and whether articles use them."""
    parts = [x.lower() for x in _PART.findall(name)]
    mark, soft, strange = FREE, True, False
    for i, part in enumerate(parts):
        if i and parts[i - 1] in STATES or i + 1 < len(parts) and parts[i + 1] in SWITCHES:
            continue
        found = COMMENT if part in COMMENTS else OTHER if part in MARKED else HEADER if part in HEADERS and not OWN.intersection(parts[:i]) else FREE
        mark = max(mark, found)
        soft = soft and (not found or part in SOFT)
        strange = strange or not (found or len(part) == 1 or part.isdigit() or part in LAYOUT or part in HEADERS or part in STATES or part in SWITCHES)
    return mark, strange and mark > HEADER, soft and mark > HEADER


def _marked(tag: str, attributes: str, inside: bool) -> tuple[int, bool, bool, str]:
    """What class, id, role and tag say of an element, whether that only stands beside other words, whether it is hidden, and its class. inside: in an article."""
    mark, weak, hidden, kind = FREE, False, False, ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            if value.lower() in ROLES:
                mark, weak = max(mark, OTHER), False
        elif name == "style":
            hidden = hidden or bool(_UNSEEN.search(value))
        elif name == "hidden" or name == "aria-hidden":
            hidden = hidden or name == "hidden" or value.lower() == "true"
        elif tag not in NEVER:
            for found, strange, soft in map(_of_name, value.split()):
                if tag == "article" and (found != COMMENT or strange) or inside and soft and tag in PARAGRAPHS:
                    continue
                # A name that says it outright counts more than one that has other words.
                if found and (not mark or weak and not strange or weak == strange and found > mark):
                    mark, weak = found, strange
            kind = value if name == "class" else kind
    if tag == "form" and (mark < FORM or weak):
        mark, weak = max(mark, FORM), False
    if tag == "header":
        mark = max(mark, HEADER)
    return mark, weak, hidden, kind


class Page:
    """Blocks of text of a page and the elements they lie in, numbered in page order: a child has a higher number than its parent."""

    def __init__(self, html: str):
        self.parent, self.tag, self.mark, self.kind = [-1], ["#"], [FREE], [""]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it in links
        self.weak: dict[int, bool] = {}  # elements whose name only contains a mark, and whether they lie in an article
        self.barred: set[int] = set()  # elements with a menu, footer or sidebar among their children
        self._stack = [(0, "#", False, 0)]  # element, tag, hidden, nearest block
        self._held: list[tuple[str, bool]] = []
        self._open_tags: Counter[str] = Counter()
        self._read(html)

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(t for t, _ in self._held).split())
            if text:
                self.blocks.append((self._stack[-1][3], text, sum(len(" ".join(t.split())) for t, linked in self._held if linked)))
            self._held = []

    def _text(self, raw: str) -> None:
        if not self._stack[-1][2]:
            self._held.append((unescape(raw) if "&" in raw else raw, self._open_tags["a"] > 0))

    def _pop_to(self, at: int) -> None:
        if any(entry[1] in BLOCKS for entry in self._stack[at:]):
            self._flush()
        while len(self._stack) > at:
            self._open_tags[self._stack.pop()[1]] -= 1

    def _find(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        for at in range(len(self._stack) - 1, 0, -1) if any(self._open_tags[tag] for tag in tags) else ():
            tag = self._stack[at][1]
            if tag in tags:
                return at
            if tag in stop:
                return 0
        return 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if at := self._find({"p"}, BLOCKS - {"p"}):
                self._pop_to(at)
        if tag in ENDS:
            mine, stop = ENDS[tag]
            while at := self._find(mine, stop):
                self._pop_to(at)
        if tag == "body" and (at := self._find({"head"}, frozenset())):
            self._pop_to(at)
        if tag == "a" and (at := self._find({"a"}, BLOCKS)):
            self._pop_to(at)
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        inside = self._open_tags["article"] + self._open_tags["main"] > 0
        mark, weak, hidden, kind = _marked(tag, attributes, inside)
        up, _, unseen, block = self._stack[-1]
        if mark == HEADER and inside:
            mark = FREE
        if weak:
            self.weak[len(self.tag)] = inside
        elif mark == OTHER:
            self.barred.add(up)
        if tag in ("nav", "footer", "aside"):
            self.barred.add(up)
        self.parent.append(up)
        self.tag.append(tag)
        self.mark.append(mark)
        self.kind.append(kind)
        node = len(self.tag) - 1
        self._stack.append((node, tag, unseen or hidden or tag in DROPPED, node if tag in BLOCKS else block))
        self._open_tags[tag] += 1

    def _close(self, tag: str) -> None:
        at = self._find({tag}, frozenset() if tag in BLOCKS else BLOCKS)
        if at:
            self._pop_to(at)
        elif tag in BLOCKS:
            self._flush()

    def _read(self, html: str) -> None:
        at = 0
        while at < len(html):
            m = _TAG.search(html, at)
            if not m:
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._close(tag)
                continue
            attributes = m[3] or m[6] or ""
            self._open(tag, attributes)
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
                self._close(tag)
        if at < len(html):
            self._text(html[at:])
        self._pop_to(1)
        self._flush()

    def points(self) -> list[float]:
        """The points of each block."""
        out = []
        for _, text, linked in self.blocks:
            own = len(text) / LENGTH if len(text) < LEAST else 1 + COMMA * (text.count(",") + text.count("，") + text.count("、")) + min(len(text) / LENGTH, MOST)
            out.append(own * (1 - min(linked / len(text), 1.0)))
        return out

    def _headers(self) -> None:
        """A header with an h1 or h2, in a container without menus or footers, is the article's."""
        titled = {0}
        for n in range(len(self.tag) - 1, 0, -1):
            if self.tag[n] in ("h1", "h2"):
                titled.add(n)
            if n in titled and self.tag[n] not in ("body", "html"):
                titled.add(self.parent[n])
        for n, mark in enumerate(self.mark):
            if mark == HEADER:
                up = self.parent[n]
                self.mark[n] = FREE if n in titled and up not in self.barred and self.tag[up] not in ("body", "html", "#") else OTHER

    def _weigh(self, points: list[float]) -> None:
        """Elements whose name only contains a mark, and that hold text of their own, aren't marked; comments outside articles are."""
        if not self.weak:
            return
        got, size, linked = [0.0] * len(self.tag), [0] * len(self.tag), [0] * len(self.tag)
        for (node, text, links), own in zip(self.blocks, points, strict=True):
            got[node] += own
            size[node] += len(text)
            linked[node] += links
        for n in range(len(self.tag) - 1, 0, -1):
            for sums in (got, size, linked):
                sums[self.parent[n]] += sums[n]
        for n, inside in self.weak.items():
            if got[n] >= OUTWEIGHS[not inside] and 2 * linked[n] < size[n] and (inside or self.mark[n] != COMMENT):
                self.mark[n] = FREE

    def unmarked(self, points: list[float]) -> list[bool]:
        """Which elements lie in no marked one, after marks that outweigh all else have been lifted."""
        self._weigh(points)
        self._headers()
        near = [0] * len(self.tag)  # the nearest element with a mark
        for n in range(1, len(self.tag)):
            near[n] = n if self.mark[n] else near[self.parent[n]]
        own = dict.fromkeys([0, *near], 0.0)
        for (node, _, _), got in zip(self.blocks, points, strict=True):
            own[near[node]] += got
        inside: dict[int, list[int]] = {}
        total = dict(own)  # with marked parts, but for comments
        for n in sorted(own, reverse=True)[:-1]:
            up = near[self.parent[n]]
            inside.setdefault(up, []).append(n)
            total[up] += total[n] * (self.mark[n] != COMMENT)
        free, lifted, heap = own[0], {0}, []
        last = 0
        while True:
            for k in inside.get(last, ()):
                heapq.heappush(heap, (self.mark[k] == COMMENT, -total[k], k))
            found = False
            while heap and not found:
                _, got, last = heapq.heappop(heap)
                ratio, least, alone = LIFTED[self.mark[last]]
                found = -got >= alone if not free else -got >= least and -got > ratio * free
            if not found:
                break
            lifted.add(last)
            free += own[last]
        out = [True] * len(self.tag)
        for n in range(1, len(self.tag)):
            out[n] = out[self.parent[n]] and (near[n] != n or n in lifted)
        return out

    def scores(self, points: list[float], free: list[bool]) -> tuple[dict[int, float], list[int], list[int]]:
        """Scores of containers, and characters and linked characters of all elements, without marked ones."""
        got: dict[int, float] = {}
        block = [0] * len(self.tag)  # the nearest block element
        for n in range(1, len(self.tag)):
            block[n] = n if self.tag[n] in BLOCKS else block[self.parent[n]]
        size, linked = [0] * len(self.tag), [0] * len(self.tag)
        for (node, text, links), own in zip(self.blocks, points, strict=True):
            if not free[node]:
                continue
            size[node] += len(text)
            linked[node] += links
            up = self.parent[node] if self.tag[node] in PARAGRAPHS else node
            for level in range(LEVELS if own else 0):
                if up < 0:
                    break
                up = block[up]
                got[up] = got.get(up, 0.0) + own / (1 << level)
                up = self.parent[up]
        for n in range(len(self.tag) - 1, 0, -1):
            size[self.parent[n]] += size[n]
            linked[self.parent[n]] += linked[n]
        return {n: own * (1 - min(linked[n] / max(size[n], 1), 1.0)) for n, own in got.items()}, size, linked

    def kept(self) -> tuple[set[int], set[int], list[bool]]:
        """The elements that are kept with all in them, those of which text that lies in no other block is, and unmarked ones."""
        points = self.points()
        free = self.unmarked(points)
        score, size, linked = self.scores(points, free)
        if not score:
            return {0}, set(), free
        top = max(score, key=lambda n: (score[n], -n))
        whole, loose = {top}, set()
        children: dict[int, list[int]] = {}
        chain = [top]
        while chain[-1] > 0:
            chain.append(self.parent[chain[-1]])
        above = set(chain)
        for n in range(1, len(self.tag)):
            if self.parent[n] in above and free[n]:
                children.setdefault(self.parent[n], []).append(n)
        semantic = next((i for i, n in enumerate(chain) if self.tag[n] in ("article", "main")), -1)
        for i, n in enumerate(chain[:-1]):
            if self.tag[n] in ("body", "html"):
                break
            up = chain[i + 1]
            near = i < semantic or i == 0 > semantic
            if near:
                loose.add(up)
            alike = "article" if i == semantic else self.tag[n] if i > semantic < 0 else ""
            for k in children.get(up, ()):
                if k == n or 2 * linked[k] >= size[k] > 0:
                    continue
                if near and self.tag[k] in BLOCKS or self.tag[k] == "h1" or self.tag[k] == self.tag[n] == alike in BLOCKS and (i == semantic or self.kind[k] == self.kind[n]):
                    whole.add(k)
        return whole, loose, free

    def text(self) -> str:
        if not self.blocks:
            return ""
        whole, loose, free = self.kept()
        stays = [n in whole for n in range(len(self.tag))]
        for n in range(1, len(self.tag)):
            stays[n] = stays[n] or stays[self.parent[n]]
        return "\n".join(t for node, t, linked in self.blocks if free[node] and (stays[node] or node in loose and 2 * linked < len(t)))


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with, in place of the html, the main text and n_chars, its characters; columns of pages with these names are replaced."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            new = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], "text", "n_chars"])

    pages = pages.drop(*({"text", "n_chars"} - {html}))
    others = pages.drop(html)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema), "text string, n_chars long"])
    return pages.select(*others.columns, html).mapInArrow(extracted, schema)

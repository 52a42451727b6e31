"""Main text of web pages by wrappers: union-free regular expressions inferred from a host's pages.

A page's token stream (element starts and ends, text) is balanced, then aligned with itself:
elements of one kind in a row become one repeated element, runs that come again and again one
repeated group. What is left is the page's shape with numbered text slots. Shapes of one host are
aligned with one another, content by content: equal tokens match, text against text becomes a slot
that varies, and what only one side has becomes optional; repeats that this brings together are
folded again. The expression that all pages of the host match is its wrapper. It needs no
alternatives: a group is ``(a? b? c?)*``.

The wrapper knows of each slot in how many pages it is, how long it is, how much of it are links
and whether it says the same everywhere. Slots within elements named or marked as page furniture
are left out. Of the rest those in the article are kept where the wrapper has one; elsewhere
those that vary, since what every page of a host repeats is its template. Each distinct shape of
a host is aligned with the wrapper once, and its pages keep the slots that this says.

Shapes are merged within tasks first, so one row per task and host is shuffled, and wrappers of a
large host are merged in rounds of bounded groups.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._shared import table, written

#: Different contents of an element beyond which they become one group, longest run looked for, deepest nesting.
MOST_ITEMS = 64
LONGEST_RUN = 8
DEEPEST = 60
#: Wrappers merged by one call, and shapes that a task holds before it merges them.
FAN = 64
HELD = 20_000

# Elements of HTML by how they break text, and names of page furniture.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math object canvas select datalist".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "option": ("select",)}
FURNITURE_TAGS = frozenset("head nav aside footer form button input fieldset dialog menu address".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense dfp sponsor sponsored sponsors promo promos promotion promoted outbrain taboola "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay interstitial paywall newsletter subscribe subscription signup signin login register "
    "menu menus nav navbar navigation breadcrumb breadcrumbs crumbs sidebar sidebars aside rail widget widgets related recommended recommendations recirculation trending popular "
    "share sharing social follow comment comments commentlist reply replies respond disqus discussion reactions footer footnav foot copyright colophon masthead topbar toolbar "
    "pagination pager paging search searchform skip skiplink tags tagcloud complementary contentinfo".split()
)
HEADER_WORDS = frozenset("header head banner masthead".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
ARTICLE_WORDS = (frozenset("article articlebody post entry story".split()), frozenset("main content maincontent".split()))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)""", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Slot:
    """A place of text; ``held`` is what a caller keeps there."""

    __slots__ = ("held", "opt", "rep")
    label = "#"

    def __init__(self, held: list, opt: bool = False, rep: bool = False):
        self.held, self.opt, self.rep = held, opt, rep


class Element:
    """An element by its name and marks, or a repeated group of optional items (label ``()``)."""

    __slots__ = ("items", "label", "opt", "rep")

    def __init__(self, label: str, items: list | None = None, opt: bool = False, rep: bool = False):
        self.label, self.items, self.opt, self.rep = label, items if items is not None else [], opt, rep


@lru_cache(100_000)
def label_of(name: str, attributes: str) -> str:
    """Name and marks (classes, id, role, item property), digits and case left out."""
    marks = []
    for m in _MARK.findall(attributes):
        marks += re.sub(r"\d+", "", _CAMEL.sub("-", html.unescape(m).strip("\"'"))).lower().split()
    return f"{name}.{' '.join(sorted(set(marks)))}" if marks else name


@lru_cache(100_000)
def words_of(label: str) -> frozenset[str]:
    return frozenset(re.findall(r"[a-z]+", label.partition(".")[2]))


def parse(page: str | None) -> tuple[Element, int]:
    """The balanced tree of a page and how many texts it has; a slot holds [(place, text, characters in links)]."""
    root, at, page = Element(""), 0, page or ""
    stack, buffer, linked, link, n = [root], [], 0, False, 0

    def flush() -> None:
        nonlocal buffer, linked, n
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                stack[-1].items.append(Slot([(n, text, min(linked, len(text)))]))
                n += 1
            buffer, linked = [], 0

    def close(names: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
        """End the nearest open element of these names and all within it, unless one of ``until`` is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].label.partition(".")[0]
            if name in names:
                del stack[k:]
                return
            if name in until:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            buffer.append(text)
            if link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        ends, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "a":
            link = not ends
        if ends:
            if name in INLINE and stack[-1].label.partition(".")[0] != name:
                continue
            if name not in RAW:
                flush()
                close((name,), ("table",) if name != "table" else ())
            continue
        if name in RAW:
            over = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
            at = over.start() if over else len(page)
            if name not in ("svg", "math", "object", "canvas", "select", "datalist"):
                flush()
            continue
        label = label_of(name, attributes) if "=" in attributes else name
        if name in INLINE and (label == name or not words_of(label) & FURNITURE_WORDS):
            continue
        flush()
        if name in VOID or name == "br" or attributes.endswith("/") and name in INLINE:
            continue
        if name in CLOSES_P:
            close(("p",), ("table", "td", "th", "div", "section", "article", "body", "button"))
        if name in CLOSES:
            close(CLOSES[name], HOLDS[name])
        if len(stack) <= DEEPEST:
            inner = Element(label)
            stack[-1].items.append(inner)
            stack.append(inner)
    flush()
    return root, n


def absorb(a, b, join) -> None:
    """Make ``a`` match what ``b`` of the same label matches."""
    a.opt, a.rep = a.opt or b.opt, a.rep or b.rep
    if a.label == "#":
        a.held = join(a.held, b.held)
    elif a.label == "()":
        a.items = _group(a.items + b.items, join).items
    else:
        a.items = align(a.items, b.items, join)


def _group(items: list, join) -> Element:
    """A repeated group with one optional item for each label among ``items``."""
    of: dict = {}
    for x in items:
        for y in x.items if x.label == "()" else [x]:
            if y.label in of:
                absorb(of[y.label], y, join)
            else:
                of[y.label] = y
            of[y.label].opt = True
    return Element("()", list(of.values()), rep=True)


def fold(items: list, join) -> list:
    """Neighbours of one label become a repeated item, runs that come twice in a row a repeated group."""
    out: list = []
    for x in items:
        last = out[-1] if out else None
        if last is not None and last.label == x.label:
            absorb(last, x, join)
            last.rep = True
            continue
        if last is not None and last.label == "()" and any(y.label == x.label for y in last.items):
            out[-1] = _group([last, x], join)
            continue
        out.append(x)
        while len(out) > 1 and x.label == "()" and any(y.label == out[-2].label for y in x.items):
            out[-2:] = [x := _group([x, out[-2]], join)]
        for k in range(2, min(LONGEST_RUN, len(out) // 2) + 1):
            if [y.label for y in out[-k:]] == [y.label for y in out[-2 * k : -k]]:
                out[-2 * k :] = [_group(out[-2 * k :], join)]
                break
        if len(out) > MOST_ITEMS:
            out = [_group(out, join)]
    return out


def align(a: list, b: list, join) -> list:
    """One sequence that matches what ``a`` and what ``b`` match."""
    if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b, strict=True)):
        for x, y in zip(a, b, strict=True):
            absorb(x, y, join)
        return a
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].label == b[j].label else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].label == b[j].label:
            absorb(a[i], b[j], join)
            out.append(a[i])
            i, j = i + 1, j + 1
        else:
            first = i < len(a) and (j == len(b) or best[i + 1][j] >= best[i][j + 1])
            x = a[i] if first else b[j]
            x.opt = True
            out.append(x)
            i, j = (i + 1, j) if first else (i, j + 1)
    return fold(out, join)


def folded(x: Element, join) -> Element:
    """``x`` with all its contents folded, the inner ones first."""
    for y in x.items:
        if y.label != "#":
            folded(y, join)
    x.items = fold(x.items, join)
    return x


def slots(x: Element) -> Iterator[Slot]:
    for y in x.items:
        if y.label == "#":
            yield y
        else:
            yield from slots(y)


def coded(x, of) -> list:
    """An element as lists: [label, flags, contents], a slot as [flags, what ``of`` makes of it]."""
    flags = x.opt + 2 * x.rep
    return [flags, of(x.held)] if x.label == "#" else [x.label, flags, [coded(y, of) for y in x.items]]


def decoded(x: list, of):
    if isinstance(x[0], int):
        return Slot(of(x[1]), bool(x[0] & 1), bool(x[0] & 2))
    return Element(x[0], [decoded(y, of) for y in x[2]], bool(x[1] & 1), bool(x[1] & 2))


def pooled(a: list, b: list) -> list:
    """Figures of a slot over two sets of pages: [pages, characters, in links, least hash, greatest hash]."""
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])]


def shaped(page: str | None) -> tuple[str, list[str], list[int], list[list]]:
    """(shape, texts in page order, each one's slot, figures of each slot) of a page."""
    root, n = parse(page)
    folded(root, lambda a, b: a + b)
    texts, place, figures = [""] * n, [0] * n, []
    for k, s in enumerate(slots(root)):
        s.held.sort()
        for i, text, _ in s.held:
            texts[i], place[i] = text, k
        h = zlib.crc32("\n".join(t for _, t, _ in s.held).encode("utf-8", "replace"))
        figures.append([1, sum(len(t) for _, t, _ in s.held), sum(x for *_, x in s.held), h, h])
    return json.dumps(coded(root, lambda _: 0), separators=(",", ":"), ensure_ascii=False), texts, place, figures


def _furniture(label: str) -> bool:
    """Whether an element that doesn't hold the article is page furniture."""
    name = label.partition(".")[0]
    if name in ("html", "body"):
        return False
    return name in FURNITURE_TAGS or bool(words_of(label) & FURNITURE_WORDS)


def _article(label: str) -> int:
    """2 for an element named or marked as the article, 1 for the page's main part, 0 for others."""
    name, words = label.partition(".")[0], words_of(label)
    if name in ("html", "body", "p", "li", "table", *INLINE, *HEADINGS) or name in FURNITURE_TAGS or words & COMMENT_WORDS:
        return 0
    if name == "article" or words & ARTICLE_WORDS[0] and not words & FURNITURE_WORDS:
        return 2
    return int(name == "main" or bool(words & ARTICLE_WORDS[1]) and not words & FURNITURE_WORDS)


def kept(root: Element) -> list[bool]:
    """Which slots of a wrapper are main text, in order."""
    found: list[tuple] = []  # figures, rank of the article around it, furniture

    def holds(x: Element) -> int:
        return max([0, *(max(_article(y.label), holds(y)) for y in x.items if y.label != "#")])

    def walk(x: Element, rank: int, out: bool, header: bool) -> None:
        for y in x.items:
            if y.label == "#":
                found.append((y.held, rank, out or header))
                continue
            own, name = _article(y.label), y.label.partition(".")[0]
            inside = holds(y)
            top = name == "header" or bool(words_of(y.label) & HEADER_WORDS) and name not in ("html", "body", "article", "main")
            walk(y, max(rank, own), out or (_furniture(y.label) and not inside), (header or top and not inside) and not (rank and name in HEADINGS))

    walk(root, 0, False, False)
    for rank in (2, 1):
        if any(r >= rank and not out for _, r, out in found):
            return [r >= rank and not out for _, r, out in found]
    varies = [not out and (f[0] < 2 or f[3] != f[4]) and 2 * f[2] <= f[1] for f, _, out in found]
    return varies if any(varies) else [not out for _, _, out in found]


def wrapped(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of ``pages`` as :func:`read` gives them: one row per host."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def merged() -> pd.DataFrame:
            of: dict = {}
            for (host, shape), figures in sorted(held.items()):
                it = iter(figures)
                x = decoded(json.loads(shape), lambda _: next(it))  # noqa: B023
                if host in of:
                    absorb(of[host], x, pooled)
                else:
                    of[host] = x
            held.clear()
            return pd.DataFrame({"host": list(of), "wrapper": [_text(x) for x in of.values()]}, dtype="object")

        for b in batches:
            for host, shape, figures in zip(b["host"], b["shape"], b["figures"], strict=True):
                own = json.loads(figures)
                before = held.get((host, shape))
                held[host, shape] = own if before is None else [pooled(x, y) for x, y in zip(before, own, strict=True)]
            if len(held) > HELD:
                yield merged()
        yield merged()

    def together(x: pd.DataFrame) -> pd.DataFrame:
        first, *rest = (decoded(json.loads(w), list) for w in sorted(x["wrapper"]))
        for other in rest:
            absorb(first, other, pooled)
        return pd.DataFrame({"host": [x["host"].iloc[0]], "wrapper": [_text(first)]})

    rows = written(pages.mapInPandas(local, "host string, wrapper string"), "wrappers")
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    while True:
        most = -(-most // FAN)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(most))).groupBy("host", "part").applyInPandas(together, "host string, wrapper string")
        if most == 1:
            return rows


def _text(x: Element) -> str:
    return json.dumps(coded(x, lambda held: held), separators=(",", ":"), ensure_ascii=False)


def decided(wrapper: str, shape: str) -> list[bool]:
    """Which slots of a page's shape its host's wrapper keeps; a slot the wrapper lacks follows the shape's own names."""
    root = decoded(json.loads(wrapper), list)
    for s, keep in zip(slots(root), kept(root), strict=True):
        s.held = (keep, [])
    numbers = iter(range(1 << 30))
    own = decoded(json.loads(shape), lambda _: (None, [next(numbers)]))
    plain = kept(decoded(json.loads(shape), lambda _: [1, 1, 0, 0, 0]))
    absorb(root, own, lambda a, b: (a[0] if a[0] is not None else b[0], a[1] + b[1]))
    out = list(plain)
    for s in slots(root):
        for k in s.held[1]:
            out[k] = plain[k] if s.held[0] is None else s.held[0]
    return out


def read(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, host, shape, shape_id, texts, slots, figures): every page with its texts in order and the slots they stand in."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_column).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), host.alias("host"), F.col(html_column).alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [shaped(x) for x in b["html"]]
            yield pd.DataFrame(
                {
                    "page_id": b["page_id"], "url": b["url"], "host": b["host"], "shape": [x[0] for x in got], "shape_id": [hashlib.md5(x[0].encode("utf-8", "replace")).hexdigest() for x in got],
                    "texts": [x[1] for x in got], "slots": [x[2] for x in got], "figures": [json.dumps(x[3], separators=(",", ":")) for x in got],
                }
            )

    return rows.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, shape string, shape_id string, texts array<string>, slots array<int>, figures string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, blocks, host) for every row of ``pages`` (page_id, url, html).

    ``blocks`` are the kept texts in page order, ``text`` joins them by line feeds. Character
    references are decoded and white space within a block is one space; ends of blocks and
    ``br`` part blocks, inline elements don't. A null or empty page, and one without main text,
    has an empty text. Pages without a host make one host of their own. Whole pages of any length
    are read; elements nested deeper than ``DEEPEST`` count as their ancestor at that depth, with
    their text. Equal pages give equal rows, repeated rows and ids too. A page of which the host
    has no other is read by the names of its elements alone. An empty table gives no rows, and
    only the three columns are read, so others don't matter.
    """
    rows = written(read(pages), "pages")
    wrappers = wrapped(rows.select("host", "shape", "figures")).select(F.col("host").alias("of_host"), "wrapper")
    shapes = rows.groupBy("host", "shape_id").agg(F.first("shape").alias("shape"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [decided(w, s) for w, s in zip(b["wrapper"], b["shape"], strict=True)]
            yield pd.DataFrame({"of_host": b["host"], "of_shape": b["shape_id"], "keep": keep})

    verdicts = shapes.join(wrappers, F.col("host") == F.col("of_host")).select("host", "shape_id", "shape", "wrapper").mapInPandas(judge, "of_host string, of_shape string, keep array<boolean>")
    verdicts = written(verdicts, "verdicts")  # a row per host and shape; its files tell the join how large it is
    out = rows.join(verdicts, (F.col("host") == F.col("of_host")) & (F.col("shape_id") == F.col("of_shape")), "left")
    both = F.arrays_zip("texts", "slots")
    blocks = F.transform(F.filter(both, lambda x: F.get("keep", x["slots"])), lambda x: x["texts"])
    out = out.select("page_id", "url", "host", blocks.alias("blocks"))
    text = F.array_join("blocks", "\n")
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "blocks", "host")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")

import json
import random

import pytest

from packetloom.llm import wrappers as w

PAGES = "page_id bigint, url string, html string"


def prose(rng, n=12):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n)).capitalize() + "."


def site_plain(rng, k):
    """Furniture by element name; implied ends, raw text with markup in it, comments."""
    title, body = prose(rng, 4), [prose(rng) for _ in range(rng.randrange(1, 6))]
    menu = "".join(f"<li><a href='/{prose(rng, 1)}'>{prose(rng, 1)}</a>" for _ in range(rng.randrange(2, 6)))
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{x:y}}</style><script>var t='</p><p>no';</script></head><body><header><h1>Site {k % 3}</h1></header><nav><ul>{menu}</ul></nav>"
    page += f"<!-- <p>never</p> --><div class='ad'>{prose(rng)}</div><article><h1>{title}</h1>" + "".join(f"<p>{x}" for x in body) + f"</article><aside>{prose(rng)}</aside><footer>&copy; {prose(rng)}</footer>"
    return page, [title, *body]


def site_marked(rng, k):
    """Furniture by class and id; lists and quotes in the article; comments that are articles themselves."""
    title, body = prose(rng, 5), [prose(rng) for _ in range(rng.randrange(2, 7))]
    items = [prose(rng, 3) for _ in range(rng.randrange(2, 5))]
    quote = [prose(rng)] if k % 2 else []
    page = f'<body class="has-sidebar"><div id="cookieNotice12">We use cookies</div><div class="site-header"><h2>{prose(rng, 2)}</h2></div><div class="wrap with-sidebar"><div class="entry-content post-{k}"><h1>{title}</h1>'
    page += "".join(f"<p>{x}</p>" for x in body) + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" + "".join(f"<blockquote><p>{x}</p></blockquote>" for x in quote)
    page += f'<div class="share-buttons"><a href="#">Share</a></div></div><div id="sidebar"><p>{prose(rng)}</p></div></div><form><input name=q><button>Go</button> find</form><section class="comments"><article class="comment"><p>{prose(rng)}</p></article></section></body>'
    return page, [title, *body, *items, *quote]


def site_bare(rng, k):
    """No names at all: only what varies between the pages tells the text from the template."""
    body = [prose(rng, 20) for _ in range(rng.randrange(2, 5))]
    page = "<body><div>Home of everything</div><center>Navigate here</center><table><tr><td>" + "<br>".join(body) + "</td></tr></table><hr><div>All of this belongs to us</div></body>"
    return page, body


SITES = {"http://plain.example.org": site_plain, "https://www.marked.example.com": site_marked, "http://user@bare.example.net:8080": site_bare}


def corpus(n=12, seed=1):
    rng, out, want = random.Random(seed), [], {}
    for host, make in SITES.items():
        for k in range(n):
            page, text = make(rng, k)
            want[len(out)] = "\n".join(text)
            out.append((len(out), f"{host}/{k}?q=1", page))
    return out, want


@pytest.mark.parametrize("fan", [64, 2])
def test_planted_sites(spark, monkeypatch, fan):
    monkeypatch.setattr(w, "FAN", fan)
    pages, want = corpus()
    out = w.extract(spark.createDataFrame(pages, PAGES).repartition(4)).collect()
    assert {r.page_id: r.text for r in out} == want
    assert all(r.n_chars == len(r.text) and "\n".join(r.blocks) == r.text for r in out)


def test_result_is_the_same_however_rows_are_dealt(spark):
    df = spark.createDataFrame(corpus(8, 5)[0], PAGES)
    got = [sorted(w.extract(df.repartition(k)).select("page_id", "text").collect()) for k in (1, 3, 7)]
    assert got[0] == got[1] == got[2]


def test_wrapper_of_repeats_options_and_slots():
    pages = ["<ul><li>a</ul><p>x", "<ul><li>b<li>c</ul><h2>n</h2><p>x<p>y", "<p>x", "<dl><dt>1<dd>2<dt>3<dd>4</dl><p>x"]
    of = [w.decoded(json.loads(w.shaped(p)[0]), lambda _: [1, 1, 0, 0, 0]) for p in pages]
    for x in of[1:]:
        w.absorb(of[0], x, w.pooled)
    flat = {y.label: (y.opt, y.rep) for y in of[0].items}
    assert flat == {"ul": (True, False), "dl": (True, False), "h2": (True, False), "p": (False, True)}
    group = next(y for y in of[0].items if y.label == "dl").items
    assert [(y.label, y.rep, [z.label for z in y.items]) for y in group] == [("()", True, ["dt", "dd"])]
    assert next(y for y in of[0].items if y.label == "p").items[0].held[0] == 4


def test_many_different_children_stay_bounded():
    rng = random.Random(2)
    names = [f"x-{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    page = "<article>" + "".join(f"<{n}>{n}</{n}>" for n in (rng.choice(names) for _ in range(3000))) + "</article>"
    shape, texts, place, _ = w.shaped(page)
    assert len(texts) == 3000 and len(set(place)) <= 100
    assert json.loads(shape)[2][0][2][0][0] == "()"


def blocks(page):
    shape, texts, place, _ = w.shaped(page)
    keep = w.kept(w.decoded(json.loads(shape), lambda _: [1, 1, 0, 0, 0]))
    return [t for t, k in zip(texts, place, strict=True) if keep[k]]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []), ("", []), ("just text", ["just text"]), ("<p>a &amp; b&nbsp;c &am &#233;&lt;i&gt;", ["a & b c &am é<i>"]), ("<p>a<b>b</b> c<br>d", ["ab c", "d"]), ("<p>1 < 2 <p>x<", ["1 < 2", "x<"]),
        ("<article><p>a</p><script>if (a<b) '<p>'</script><p>b</article><script>never ends <p>c", ["a", "b"]), ('<article><p title="a > b">x</p><a href="unended>y', ["x", "y"]),
        ("<main><h1>t</h1><nav>n</nav><p>x</p></main><p>out", ["t", "x"]), ("<article><header><h1>t</h1><p>by someone</p></header><p>x</article>", ["t", "x"]), ("<div>" * 500 + "deep" + "</div>" * 500 + "<p>x", ["deep", "x"]),
        ("<article><p>  a \n\t b  </p></article>", ["a b"]), ("<article><ul><li>a<ul><li>b</ul><li>c</ul></article>", ["a", "b", "c"]), ("<article>x<!-- y", ["x"]), ("<article><p>x</article><footer>cut", ["x"]),
        ('<article><p>x <span class="ad">buy</span> y', ["x", "y"]), ("<ARTICLE><P>X</P></ARTICLE><FOOTER>f</FOOTER>", ["X"]),
    ],
)
def test_single_pages(page, want):
    assert blocks(page) == want


def test_odd_pages(spark):
    page, text = site_plain(random.Random(3), 1)
    long = "<article>" + "<p>word" * 60_000 + "</article>"
    rows = [(1, "http://a.example/1", page), (1, "http://a.example/1", page), (2, None, page), (None, "not a url", page), (3, "http://b.example", None), (4, "http://b.example", ""), (5, "http://c.example", long), (None, None, None)]
    df = spark.createDataFrame([(*r, "h", 1, True) for r in rows], PAGES + ", host string, shape int, keep boolean")
    out = w.extract(df).select("page_id", "url", "text", "n_chars").collect()
    assert len(out) == len(rows)
    assert sorted((r.page_id or 0, r.text) for r in out) == sorted([(1, "\n".join(text)), (1, "\n".join(text)), (2, "\n".join(text)), (0, "\n".join(text)), (3, ""), (4, ""), (5, "\n".join(["word"] * 60_000)), (0, "")])
    assert w.extract(df.limit(0)).count() == 0


def test_query_keeps_each_article(spark):
    """The driver's pages: the article's texts, taken by a plain search, are what the query returns."""
    import html
    import re

    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in w.query(spark, d).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|br|h1)>", body)]
        assert r.text == "\n".join(x for x in want if x)

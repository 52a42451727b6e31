import math
import random
import re

import numpy as np
import pytest

from packetloom.llm import search as se
from tests.llm.conftest import filler


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=20):
    """Every item's best documents by scoring all of them."""
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n_docs, length = len(docs), sum(len(t) for _, t in docs)
    out = []
    for item, text in set(items):
        scores = []
        for i, t in docs:
            s, m = 0, 75 + 25 * len(t) * n_docs // length
            for x in terms(text):
                df, tf = sum(x in u for _, u in docs), t.count(x)
                if df:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("pass_terms", [10**6, 7])
def test_equals_brute_force(spark, monkeypatch, pass_terms):
    monkeypatch.setattr(se, "BLOCK", 16)
    rng = random.Random(4)
    vocabulary = ["the"] * 30 + ["of", "É", "é", "x1", "9", "日本", "rare", "Zed", "zed", "k"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 30))) for i in range(150)] + [(500, None), (501, ""), (502, " -- "), (None, "rare zed"), (7, "rare rare"), (7, "rare rare")]
    items = [(i, text(n)) for i, n in enumerate([1, 2, 5, 20, 3])] + [(3, "rare of"), (3, "rare of"), (None, "zed"), (9, None), (10, ""), (11, "unheard")]
    d, q = tables(spark, docs, items)
    assert got(se.search(d.repartition(3), q, pass_terms=pass_terms)) == brute(docs, items)


def test_ties_go_to_smaller_ids_across_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(se, "BLOCK", 8)
    docs = [(i, "one two") for i in range(100, 0, -1)] + [(200, "other text")]
    d, q = tables(spark, docs, [(1, "one")])
    out = se.search(d.repartition(5), q).orderBy("rank").collect()
    assert [r.doc_id for r in out] == list(range(1, 21)) and len({r.score for r in out}) == 1 and [r["rank"] for r in out] == list(range(1, 21))


def test_accumulators_are_limited_and_scores_whole():
    """Common terms make no accumulators once the rare ones have filled the list."""
    rng = np.random.default_rng(2)
    n = 2000
    rows = [(d, 0, 1) for d in range(n)] + [(d, 1, 1) for d in range(0, n, 2)] + [(int(d), 2, 3) for d in rng.choice(n, 30, replace=False)]
    doc, t, f = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    items = se.Items([("q", "aa bb cc")])
    df = np.bincount(t, minlength=3)
    items.rank(df)
    w, m = np.array([se.weight(n, int(x)) for x in df]), np.full(n, 100)
    best = se.Best(1, 20)
    made = se.accumulate(t, f, doc, m, list(range(n)), items, w, best)
    assert made == 30
    score = np.zeros(n, np.int64)
    np.add.at(score, doc, w[t] * ((10**9 * f) // (1000 * f + 12 * m[doc])))
    want = sorted(((-int(s), d) for d, s in enumerate(score)))[:20]
    assert best.found[0] == [(-s, d) for s, d in want]


def test_odd_documents(spark, odd_docs, no_docs):
    q = spark.createDataFrame([(1, filler(3, 40), "x"), (2, None, "y")], "item_id bigint, text string, doc_id string")
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in q.collect()])
    assert got(se.search(odd_docs, q)) == want
    assert se.search(no_docs, q).count() == 0 and se.search(odd_docs, q.limit(0)).count() == 0


def test_ids_of_text(spark):
    d = spark.createDataFrame([("b", "one"), ("a", "one"), (None, "one")], "doc_id string, text string")
    out = se.search(d, spark.createDataFrame([("q", "one")], "item_id string, text string"))
    assert [(r.item_id, r.doc_id) for r in out.orderBy("rank").collect()] == [("q", "a"), ("q", "b"), ("q", None)]

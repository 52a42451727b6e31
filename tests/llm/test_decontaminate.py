import hashlib
import random
import re

import pytest

from packetloom.llm import decontaminate as dc
from tests.llm.conftest import filler


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            if item is None or not n:
                continue
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_equals_brute_force(spark, limit):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "dé", "E1", "ff"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 9, 10, 11, 14, 25, 40, 6, 1 + 8])] + [(2, text(12)), (77, None), (78, "--"), (None, text(12))]
    docs = [(i, text(rng.randrange(1, 60))) for i in range(40)]
    docs += [(100 + k, f"{text(7)} {t} {text(9)}") for k, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, items[5][1].upper())]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in dc.hits(d, b, broadcast_grams=limit).collect()}
    assert got == brute(docs, items)


def test_odd_documents(spark, odd_docs, no_docs, tables):
    out = dc.hits(odd_docs, spark.read.parquet(f"{tables}/benchmark.parquet"))
    assert out.count() == odd_docs.count()
    assert {r.doc_id for r in out.filter("contaminated").collect()} >= {2}
    assert dc.hits(no_docs, spark.read.parquet(f"{tables}/benchmark.parquet")).count() == 0
    assert dc.hits(odd_docs, spark.createDataFrame([], "item_id bigint, text string")).filter("contaminated").count() == 0
    kept = dc.stage(spark, odd_docs, tables)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1


def test_stage_judges_rows_that_share_an_id_by_their_texts(spark, tmp_path):
    leak = filler(50, 14)
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, f"{filler(1, 9)} {leak}"), (5, filler(2, 30)), (None, f"{leak} {filler(3, 4)}"), (None, filler(4, 30)), (6, filler(5, 30)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = dc.stage(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, [r for r in docs.collect() if leak not in (r.text or "")]))


@pytest.mark.parametrize("limit", [10**6, 0])
def test_a_shared_phrase_shorter_than_a_window_joins_nothing(spark, limit, monkeypatch):
    """300 items and 400 documents with one nine-word phrase in common, and a few true copies among them."""
    phrase = filler(1, 9)
    items = [(i, f"{filler(100 + i, 6)} {phrase} {filler(500 + i, 6)}") for i in range(300)]
    docs = [(i, f"{filler(2000 + i, 12)} {phrase} {filler(4000 + i, 12)}" + (f" {items[i][1]}" if i % 50 == 0 and i < 300 else "")) for i in range(400)]
    met = []
    real = type(spark.range(1)).join

    def join(self, other, on=None, how=None):
        out = real(self, other, on, how)
        if on == "w":
            met.append(out.select("row", "item_id").distinct().count())
        return out

    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    with monkeypatch.context() as m:
        m.setattr(type(d), "join", join)
        got = {r.doc_id: tuple(r)[1:] for r in dc.hits(d, b, broadcast_grams=limit).collect()}
    want = brute(docs, items)
    assert got == want and met == [sum(x[2] for x in want.values())] and met[0] < 1000

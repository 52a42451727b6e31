import random

import numpy as np
from pyspark.sql import functions as F

from packetloom.llm import simhash
from tests.llm.conftest import filler


def test_pairs_within_four_bits_share_a_key():
    rng = random.Random(1)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(5)):
            y ^= 1 << b
        row, key = simhash.keys_of(np.array([x, y], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_golay_tables_cover_every_word_once():
    assert sorted(set(simhash.N_PATTERNS.tolist())) == [1, 6]
    assert int(simhash.N_PATTERNS.sum()) == sum((1, 23, 253, 1771, 8855))


def brute(fps):
    group = {f: f for f in fps}

    def find(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 4:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def cloud(n, bits, seed):
    """Fingerprints in a few clouds about random centres."""
    rng, out = random.Random(seed), set()
    for _ in range(4):
        c = rng.getrandbits(64)
        for _ in range(n):
            f = c
            for b in rng.sample(range(64), rng.randrange(bits)):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


def components_of(spark, fps):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint").repartition(3)
    return {r.node % (1 << 64): r.label for r in simhash.components(simhash.links(df)).collect()}


def same(fps, want, got):
    for f in fps:
        assert (f in got) == (sum(want[g] == want[f] for g in fps) > 1)
    for f in got:
        for g in got:
            assert (want[f] == want[g]) == (got[f] == got[g])


def test_components_equal_brute_force(spark):
    fps = cloud(40, 7, 3)
    same(fps, brute(fps), components_of(spark, fps))


def test_hot_keys_take_the_exact_other_way(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 3)
    monkeypatch.setattr(simhash, "_compared", patched(3))
    fps = cloud(25, 7, 4)
    same(fps, brute(fps), components_of(spark, fps))


def patched(most):
    source = simhash._compared

    def compared(batches):
        simhash.RUN = most  # in the worker
        yield from source(batches)

    return compared


def test_runs_cross_batches():
    import pandas as pd

    key = np.array([1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5, 5, 5])
    whole = [pd.DataFrame({"key": key[i : i + 2], "fp": np.arange(len(key))[i : i + 2]}) for i in range(0, len(key), 2)]
    seen = [(int(k), int(f), hot) for ks, fs, hot in simhash._runs(iter(whole), 3) for k, f in zip(ks, fs, strict=True)]
    assert sorted(x[:2] for x in seen) == list(zip(key.tolist(), range(len(key)), strict=True))
    assert {k for k, _, hot in seen if hot} == {3, 5}


def test_odd_documents(spark, odd_docs, no_docs):
    rows = simhash.grouped(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[100].fingerprint == by[101].fingerprint == by[102].fingerprint == "0" * 16
    assert by[101].component_id == by[102].component_id == 100
    assert by[104].component_id == 3
    assert simhash.grouped(no_docs).count() == 0
    kept = simhash.stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(3) == 1 and 104 not in ids and 101 not in ids and 100 in ids
    assert simhash.stage(spark, no_docs, "").count() == 0


def test_fingerprint_of_few_words():
    import xxhash

    assert simhash.fingerprint("One  TWO\nthree") == xxhash.xxh64_intdigest(b"one two three", 42)
    assert simhash.fingerprint("É A") == xxhash.xxh64_intdigest("É a".encode(), 42)


def test_copies_need_no_pairs(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same few words in every row").alias("text"))
    assert simhash.grouped(df).filter("component_id = 0").count() == 2000


def test_stage_keeps_one_row_of_each_group_whatever_its_id(spark):
    text = [filler(100 + k, 40) for k in range(6)]
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (None, text[2]), (None, text[3]), (None, text[3]), (None, text[0]), (7, text[4]), (6, text[4]), (None, text[4]), (8, text[5])]
    kept = simhash.stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted((r.text, r.doc_id) for r in kept) == sorted(zip(text, [1, 1, None, None, 6, 8], strict=True))

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import mixing, sharding
from tests.llm.conftest import filler


def water(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    rest, active, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while active:
        level = rest / sum(w[s] for s in active)
        over = [s for s in active if level * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in active}
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
            active.remove(s)
    return out


@pytest.mark.parametrize("blocks", [{}, {"block_words": 300, "block_rows": 20, "shard_words": 500}])
def test_targets_and_takes(spark, blocks):
    rng = random.Random(3)
    rows = [(i, filler(i, rng.randrange(0, 40)), "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}") for i in range(600)] + [(700, filler(1, 5), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df, **blocks).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(5), **blocks).collect()}
    assert {r.doc_id: r.taken for r in got} == again
    source, sizes, taken, target = {i: s for i, _, s in rows}, Counter(), Counter(), {}
    for r in got:
        assert r.size == len(rows[[x[0] for x in rows].index(r.doc_id)][1].split()) and r.taken in (0, r.size, 2 * r.size)
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    want = water(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(40, 0.01 * target[s])


def test_tree_shares_exactly():
    q = np.array([1000, 10, 0, 333])
    leaves = list(mixing.split(q, 7, 0, 7, 5))
    assert (sum(x[1] for x in leaves) == q).all()
    totals = [int(x[1].sum()) for x in leaves]
    assert max(totals) - min(totals) <= 3
    parts = [x for a in range(0, 7, 2) for x in mixing.split(q, 7, a, min(a + 2, 7), 5)]
    assert all(a == c and (b == d).all() and (at == at2).all() for (a, b, at), (c, d, at2) in zip(sorted(leaves, key=lambda x: x[0]), sorted(parts, key=lambda x: x[0]), strict=True))
    for s in range(4):
        spans = sorted((int(x[2][s]), int(x[2][s] + x[1][s])) for x in leaves if x[1][s])
        assert all(b == c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_mixing_odd_documents(spark, odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    assert out.count() == odd_docs.count() and out.filter("taken IS NULL OR taken > 2 * size").count() == 0
    assert mixing.mix(no_docs).count() == 0
    stage = mixing.stage(spark, odd_docs, "")
    assert stage.columns == odd_docs.columns and stage.count() > 0
    assert mixing.stage(spark, no_docs, "").count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


def test_shards_hold_every_row(spark, odd_docs, no_docs):
    rows, store = sharding.shard(odd_docs, target=2000)
    assert rows.count() == odd_docs.count()
    assert sorted(str(r.text) for r in rows.collect()) == sorted(str(r.text) for r in odd_docs.collect())
    m = store.manifest()
    assert m.agg(F.sum("rows")).first()[0] == odd_docs.count()
    assert sharding.stage(spark, odd_docs, "").count() == odd_docs.count()
    assert sharding.stage(spark, no_docs, "").count() == 0


def test_compaction_reaches_the_target_and_commits_once(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"))
    rows, store = sharding.shard(df, arrivals=32, target=100_000)
    sizes = [r.bytes for r in store.manifest().collect()]
    assert rows.count() == 4000 and len(sizes) < 8 and max(sizes) <= 120_000
    small = [s for s in sizes if s < 50_000]
    assert len(small) < sharding.FANOUT
    latest = store.versions()[-1]
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(store.manifest(), latest)


def test_appends_make_versions(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    _, store = sharding.shard(df, arrivals=1)
    before = store.versions()[-1]
    store.append(df.withColumn(store.size, F.lit(1).cast("long")), F.lit("late"))
    assert store.versions()[-1] == before + 1 and store.rows().count() == 20 and store.rows(before).count() == 10


def merged(shards, target, fanout=sharding.FANOUT):
    """The sizes of a store's shards after compaction, from (arrival, path, bytes), in plain Python."""
    import math

    shards, number = list(shards), 0
    while True:
        tiers = {}
        for a, p, b in sorted(shards):
            if b < target // 2:
                tiers.setdefault(math.floor(math.log(max(b, target // fanout**2, 1), fanout) + 1e-12), []).append((a, p, b))
        gone, new = set(), []
        for t, line in tiers.items():
            cuts, before = {}, 0
            for x in line:
                cuts.setdefault(before // target, []).append(x)
                before += x[2]
            for n, cut in cuts.items():
                total = sum(x[2] for x in cut)
                if len(cut) >= fanout or len(cut) > 1 and total >= target // 2:
                    gone |= {x[1] for x in cut}
                    number += 1
                    new.append((f"run-{t}-{n}", f"new{number}", total))
        if not gone:
            return sorted(x[2] for x in shards)
        shards = [x for x in shards if x[1] not in gone] + new


@pytest.mark.parametrize("target", [700, 5_000, 60_000])
def test_tiers_equal_plain_python(spark, target):
    rng = random.Random(target)
    df = spark.createDataFrame([(i, "x" * rng.choice((5, 40, 400))) for i in range(300)], "doc_id bigint, text string").repartition(3)
    size = F.length("text").cast("long")
    store = sharding.Store(spark, sharding.new_path(spark, "store"), df.withColumn("b", size).schema, "b")
    for k in range(5):
        store.append(df.filter(F.col("doc_id") % 5 == k).withColumn("b", size), F.lit(f"day{k}"))
    before = [(r.arrival, r.path, r.bytes) for r in store.manifest().collect()]
    store.compact(target)
    assert sorted(r.bytes for r in store.manifest().collect()) == merged(before, target)
    assert sorted(r.text for r in store.rows().collect()) == sorted(r.text for r in df.collect())


def test_readers_of_the_version_before_are_served(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"), F.lit(100).cast("long").alias("b"))
    store = sharding.Store(spark, sharding.new_path(spark, "store"), df.schema, "b")
    store.append(df, F.col("doc_id") % 16)
    held = store.rows()
    store.compact(100_000)
    assert held.count() == 2000 and store.versions() == [1, 2] and store.rows().count() == 2000
    store.append(df, F.lit("more"))
    store.vacuum(keep=1)
    assert store.versions() == [3] and store.rows().count() == 4000


def test_files_of_an_append_do_not_follow_the_splits(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WRITERS", 3)
    df = spark.range(1200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"), F.lit(100).cast("long").alias("b"))
    for splits in (12, 40):
        store = sharding.Store(spark, sharding.new_path(spark, "store"), df.schema, "b")
        store.append(df.repartition(splits), F.col("doc_id") % 4)
        assert store.manifest().count() <= 3 * 4 and store.rows().count() == 1200
    monkeypatch.setattr(sharding, "WRITER_BYTES", 10_000)  # 120,000 bytes: twelve tasks
    store = sharding.Store(spark, sharding.new_path(spark, "store"), df.schema, "b")
    store.append(df.repartition(40), F.lit("day"))
    assert store.manifest().count() == 12 and store.rows().count() == 1200


def test_an_empty_append_is_a_version_of_its_own(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).cast("long").alias("b"))
    store = sharding.Store(spark, sharding.new_path(spark, "store"), df.schema, "b")
    store.append(df, F.lit("day"))
    store.append(df.limit(0), F.lit("none"))
    assert store.versions() == [1, 2] and store.rows().count() == 10


def test_store_runs_without_python_workers(spark):
    """All statements of an append, a compaction and a read are column functions."""
    status = spark._jsparkSession.sharedState().statusStore()
    before = status.executionsCount()
    rows, store = sharding.shard(spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text")), target=100_000)
    rows.count()
    found = status.executionsList()
    plans = [found.apply(k).physicalPlanDescription() for k in range(found.size())][before:]
    assert len(plans) > 5 and any("InsertIntoHadoopFs" in p for p in plans)
    assert not [p for p in plans if re.search("Python|Pandas|ArrowEval", p)]

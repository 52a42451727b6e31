"""Windows, sweeps and assignments of one large key, dealt among many tasks, against NumPy and plain loops."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import grids, joins, ordered, scoring, stats

PARTS = [7, 60, 20_000]


def series(spark, seed, holes=0.0):
    """Two keys, one with nearly all rows, and one of a single row."""
    rng = random.Random(seed)
    rows = [(k, i, None if rng.random() < holes else rng.uniform(-5, 5)) for k, n in ((0, 300), (1, 9), (2, 1)) for i in range(n)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "k int, i int, v double").repartition(3)


@pytest.mark.parametrize("rows_per_part", PARTS)
def test_places_and_strides(spark, rows_per_part):
    rows, df = series(spark, 1)
    x, n = ordered.placed(df, ["k"], ["i"], rows_per_part)
    assert (n > 1) == (rows_per_part < 300)
    assert all(r.place == r.i for r in x.collect()) and x.count() == len(rows)
    got = sorted((r.k, r.i) for r in ordered.stride(df, 7, ["k"], ["i"], rows_per_part).collect())
    assert got == sorted((k, i) for k, i, _ in rows if i % 7 == 0)
    whole, _ = ordered.placed(df, [], ["k", "i"], rows_per_part)
    assert [r.place for r in whole.orderBy("k", "i").collect()] == list(range(len(rows)))


@pytest.mark.parametrize("rows_per_part", PARTS)
@pytest.mark.parametrize("width", [1, 7, 41])
def test_running_mean_over_blocks(spark, rows_per_part, width):
    rows, df = series(spark, 2)
    got = {(r.k, r.i): r.m for r in ordered.running_mean(df, "v", width, ["k"], ["i"], "m", rows_per_part, block=30).collect()}
    assert len(got) == len(rows)
    for k in (0, 1, 2):
        v = np.array([x for kk, _, x in rows if kk == k])
        want = np.convolve(np.pad(v, width // 2, mode="edge"), np.ones(width) / width, mode="valid")
        assert [got[k, i] for i in range(len(v))] == pytest.approx(want)


@pytest.mark.parametrize("rows_per_part", PARTS)
@pytest.mark.parametrize("holes", [0.3, 0.97])
def test_fill_over_holes_longer_than_a_range(spark, rows_per_part, holes):
    rows, df = series(spark, 3, holes)
    got = {(r.k, r.i): r.v for r in ordered.fill(df, "v", ["k"], ["i"], "linear", rows_per_part).collect()}
    mean = {(r.k, r.i): r.v for r in ordered.fill(df, "v", ["k"], ["i"], "mean").collect()}
    assert len(got) == len(mean) == len(rows)
    for k in (0, 1, 2):
        v = [(i, x) for kk, i, x in rows if kk == k]
        known = [(i, x) for i, x in v if x is not None]
        for i, x in v:
            if not known:
                assert got[k, i] is None and mean[k, i] is None
                continue
            assert got[k, i] == pytest.approx(float(np.interp(i, *zip(*known, strict=True))))
            assert mean[k, i] == pytest.approx(x if x is not None else float(np.mean([y for _, y in known])))


@pytest.mark.parametrize("rows_per_part", PARTS)
def test_resample_over_ranges(spark, rows_per_part):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(0, 5000)), rng.uniform(0, 9)) for k, n in ((0, 250), (1, 5)) for _ in range(n)]
    got = {(r.k, r.i): r.value for r in ordered.resample(spark.createDataFrame(rows, "k int, t double, v double"), "t", "v", 13.0, ["k"], rows_per_part).collect()}
    n = 0
    for k in (0, 1):
        by: dict = {}
        for kk, t, v in rows:
            if kk == k:
                by.setdefault(t, []).append(v)
        t = sorted(by)
        grid = np.arange(int((t[-1] - t[0]) // 13.0)) * 13.0 + t[0]
        assert [got[k, i] for i in range(len(grid))] == pytest.approx(np.interp(grid, t, [np.mean(by[x]) for x in t]))
        n += len(grid)
    assert len(got) == n


@pytest.mark.parametrize("rows_per_part", PARTS)
def test_coverage_sweep(spark, rows_per_part):
    rng = random.Random(5)
    rows = [(k, a := rng.randrange(0, 3000), a + rng.choice([0, 0, 1, 5, 40])) for k, n in ((0, 300), (1, 20)) for _ in range(n)] + [(2, 9, 3), (3, 5, 5), (3, 5, 5)]
    got = sorted(tuple(r) for r in grids.coverage(spark.createDataFrame(rows, "k int, lo int, hi int"), "lo", "hi", ["k"], rows_per_part).collect())
    want: list = []
    for k, lo, hi in sorted(r for r in rows if r[1] <= r[2]):
        if want and want[-1][0] == k and lo <= want[-1][2]:
            want[-1] = (k, want[-1][1], max(hi, want[-1][2]))
        else:
            want.append((k, lo, hi))
    assert got == want


def test_coverage_and_strides_have_no_window_per_key(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"))
    for out in (grids.coverage(df, "lo", "hi", ["k"], 50), ordered.stride(df, 3, ["k"], ["lo"], 50)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("part" in line for line in windows)


@pytest.mark.parametrize("rows_per_part", [10, 20_000])
def test_values_at_an_index(spark, rows_per_part):
    rng = random.Random(6)
    held = [(k, float(t), i, rng.random()) for k in (0, 1) for i, t in enumerate(sorted(rng.randrange(0, 900) for _ in range(60)))]
    points = [(i, rng.choice([0, 1, 7]), float(rng.randrange(-50, 2000))) for i in range(200)]
    a = spark.createDataFrame(held, "k int, t double, i int, v double").repartition(4)
    b = spark.createDataFrame(points, "p int, k int, t double")
    out = joins.at_index(b, a, "t", ["k"], ["t", "i"], ["v"], 10.0, block=8, rows_per_part=rows_per_part)
    by = {k: [r for r in held if r[0] == k] for k in (0, 1)}
    want = {p: by[k][int(min(max(round((t - by[k][0][1]) / 10.0), 0), 59))][3] for p, k, t in points if k in by}
    assert {r.p: r.v for r in out.collect()} == want


def test_sparse_assignment_is_optimal():
    rng = np.random.default_rng(7)
    for n in range(200):
        r, c = rng.integers(1, 6, 2)
        pairs = [(i, j, round(float(rng.random()), 3)) for i in range(r) for j in range(c) if rng.random() < 0.6]
        if not pairs:
            continue
        rows, cols, w = (np.array(x) for x in zip(*pairs, strict=True))
        got = scoring.matched(rows * 10, cols * 7, w)
        assert len({rows[p] for p in got}) == len({cols[p] for p in got}) == len(got)
        weight = {(i, j): x for i, j, x in pairs}
        most = max(sum(weight.get((i, p[i]), 0.0) for i in range(r)) for p in itertools.permutations(list(range(c)) + [-1] * int(r), int(r))) if r + c < 8 else None
        if most is not None:
            assert sum(w[p] for p in got) == pytest.approx(most), n


def test_long_chain_is_assigned_in_memory_of_its_pairs():
    """100000 intervals, each overlapping the next two of the other side: far beyond a dense matrix."""
    n = 100_000
    rows = np.repeat(np.arange(n), 2)
    cols = rows + np.tile([0, 1], n)
    w = np.tile([0.6, 0.5], n).astype(float)
    w[1::2] += np.arange(n) % 3 * 0.1
    t = time.time()
    got = scoring.matched(rows, cols, w)
    assert len(got) == n and time.time() - t < 60
    best = np.array([[0.0, -np.inf]])[0]  # of the rows so far: the last one took its own column, or the next
    for i in range(n):
        own, after = 0.6, w[2 * i + 1]
        best = np.array([max(best[0] + own, best[0] if i else 0.0), max(best.max() + after, -np.inf)])
    assert sum(w[p] for p in got) == pytest.approx(best.max())


def test_assignment_of_runs(spark):
    rng = random.Random(8)
    t = [(i, rng.randrange(2), a := rng.uniform(0, 3e5), a + rng.uniform(1e3, 2e4)) for i in range(60)]
    d = [(i, rng.randrange(2), a := rng.uniform(0, 3e5), a + rng.uniform(1e3, 2e4)) for i in range(60)]
    truth, found = spark.createDataFrame(t, "tid bigint, ds bigint, a0 double, a1 double"), spark.createDataFrame(d, "did bigint, ds bigint, b0 double, b1 double")
    got = scoring.assign(truth, found, 0.0).collect()
    for ds in (0, 1):
        pairs = [(i, j, (min(a1, b1) - max(a0, b0)) / (max(a1, b1) - min(a0, b0))) for i, s, a0, a1 in t if s == ds for j, r, b0, b1 in d if r == ds and min(a1, b1) > max(a0, b0)]
        rows, cols, w = (np.array(x) for x in zip(*pairs, strict=True))
        own = [r for r in got if r.ds == ds]
        assert sum(r.iou for r in own) == pytest.approx(sum(w[p] for p in scoring.matched(rows, cols, w)))
        assert len({r.tid for r in own}) == len({r.did for r in own}) == len(own)


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("values", ["distinct", "ties", "normal"])
def test_quantiles_of_large_and_small_keys(spark, values, few):
    rng = random.Random(9)
    draw = {"distinct": lambda: rng.random(), "ties": lambda: float(rng.choice([0, 0, 0, 0, 1, 2, 3])), "normal": lambda: round(rng.gauss(0, 1), 2)}[values]
    rows = [(k, draw()) for k, n in (("a", 6000), ("b", 40), ("c", 1), (None, 1500)) for _ in range(n)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    probs = {"p0": 0.0, "p1": 0.001, "p2": 0.05, "p3": 0.5, "p4": 0.99, "p5": 1.0}
    got = {r.k: r for r in stats.quantiles(df, F.col("v"), ["k"], probs, few).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, r in got.items():
        own = [v for kk, v in rows if kk == k]
        assert r.n == len(own) and [r[p] for p in probs] == pytest.approx(np.quantile(own, list(probs.values())))
    whole = stats.quantiles(df, F.col("v"), [], probs, few).collect()
    assert len(whole) == 1 and [whole[0][p] for p in probs] == pytest.approx(np.quantile([v for _, v in rows if v is not None], list(probs.values())))
    assert stats.quantiles(df.limit(0), F.col("v"), ["k"], probs, few).count() == 0


def test_distances_of_many_groups(spark):
    rng = random.Random(10)
    rows = [("ref", float(rng.randrange(60))) for _ in range(80)] + [(f"g{i}", float(rng.randrange(-5, 70))) for i in range(1200) for _ in range(1 + i % 4)] + [("g1", None), (None, 3.0)]
    got = {r.g: r.ks for r in stats.ks_distance(spark.createDataFrame(rows, "g string, v double"), "v", "g", "ref").collect()}
    by: dict = {}
    for g, v in rows:
        if g is not None and v is not None:
            by.setdefault(g, []).append(v)
    at = np.arange(-6.0, 71.0)
    share = lambda v: np.searchsorted(np.sort(v), at, side="right") / len(v)
    ref = share(by.pop("ref"))
    assert got == pytest.approx({g: np.abs(share(v) - ref).max() for g, v in by.items()})
    none = stats.ks_distance(spark.createDataFrame([("a", 1.0)], "g string, v double"), "v", "g", "ref").collect()
    assert [(r.g, r.ks) for r in none] == [("a", None)]


def test_inputs_of_numbers_and_distances_run_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(3000).selectExpr("id AS i", "cast(id % 2 AS string) AS g", "rand(3) AS v").mapInPandas(watched, "i bigint, g string, v double")
    ordered.numbered(df, ["v", "i"], "n", 100).write.format("noop").mode("overwrite").save()
    assert seen.value == 3000
    stats.ks_distance(df, "v", "g", "0").collect()
    assert seen.value == 6000
    stats.average_ranks(df, "v", ["g"], "r").select("r").collect()
    assert seen.value <= 12000  # ranks are joined to the rows

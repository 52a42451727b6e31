"""Operators against small tables with known answers, and against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions.bins import GridSpec
from packetloom.operators import grids, joins, ordered, scoring, signal, stats, tracing


def test_asof_is_strict_and_repeats_nothing(spark):
    left = spark.createDataFrame([(float(t),) for t in (0, 5, 9.999, 10, 15, 20, 25, 30, 35, 1e6)], "t double")
    right = spark.createDataFrame([(10.0, 1), (20.0, 2), (30.0, 3)], "ct double, code int")
    got = [r.code if r.code is not None else 9 for r in joins.asof_backward(left, right, "t", "ct", rows_per_part=3).orderBy("t").collect()]
    assert got == [9, 9, 9, 9, 1, 1, 2, 2, 3, 3]
    assert joins.asof_backward(left.limit(0), right, "t", "ct").count() == 0
    assert joins.asof_backward(left, right.limit(0), "t", "ct").filter("code IS NULL").count() == 10


def test_asof_forward_clamps(spark):
    left = spark.createDataFrame([(float(t),) for t in (0, 10, 10.5, 31)], "t double")
    right = spark.createDataFrame([(10.0, 1), (20.0, 2), (30.0, 3)], "ct double, code int")
    assert [r.code for r in joins.asof_forward(left, right, "t", "ct").orderBy("t").collect()] == [1, 1, 2, 3]


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([(t,) for t in (0.0, 15.0, 15.1, 99.0)], "t double")
    right = spark.createDataFrame([(10.0, 1), (20.0, 2)], "ct double, code int")
    assert [r.code for r in joins.nearest(left, right, "t", "ct").orderBy("t").collect()] == [1, 1, 2, 2]


def test_keyed_asof_matches_plain_python(spark):
    rng = random.Random(3)
    a = [(k, rng.uniform(0, 1e5), i) for i in range(300) for k in [rng.randrange(4)]]
    b = [(k, rng.uniform(0, 1e5), i) for i in range(60) for k in [rng.randrange(3)]]
    got = joins.asof_backward(spark.createDataFrame(a, "k int, t double, i int"), spark.createDataFrame(b, "k int, rt double, v int"), "t", "rt", ["k"], strict=False)
    want = {i: max([(rt, v) for kk, rt, v in b if kk == k and rt <= t], default=(None, None))[1] for k, t, i in a}
    assert {r.i: r.v for r in got.collect()} == want


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("rows_per_part", [7, 60, 10_000])
def test_neighbours_over_many_ranges_match_plain_python(spark, keys, rows_per_part):
    """Dense and empty stretches, repeated times, missing times and keys, ranges without right rows."""
    rng = random.Random(rows_per_part)
    time = lambda: float(rng.choice((rng.randrange(50), rng.randrange(50), rng.randrange(10_000))))
    a = [(rng.choice((1, 2, 3, None)), None if i % 40 == 0 else time(), i) for i in range(400)]
    b = [(rng.choice((1, 2)), time(), i) for i in range(60)]
    left, right = spark.createDataFrame(a, "k int, t double, i int"), spark.createDataFrame(b, "k int, rt double, v int")
    right = right if keys else right.drop("k")
    ok = lambda k, kk: not keys or k == kk
    before = {i: max([(rt, v) for kk, rt, v in b if ok(k, kk) and t is not None and rt < t], default=(None, None))[1] for k, t, i in a}
    assert {r.i: r.v for r in joins.asof_backward(left, right, "t", "rt", keys, rows_per_part=rows_per_part).collect()} == before
    near = {i: min([(abs(rt - t), rt, v) for kk, rt, v in b if ok(k, kk) and t is not None], default=(None, None, None))[:2] for k, t, i in a}
    got = joins.nearest(left, right, "t", "rt", keys, rows_per_part=rows_per_part).collect()
    assert {r.i: (abs(r.rt - r.t) if r.rt is not None else None, r.rt) for r in got} == near
    if not keys:
        last = max(rt for _, rt, _ in b)
        want = {i: (min([rt for _, rt, _ in b if rt >= t], default=last) if t is not None else None) for _, t, i in a}
        assert {r.i: r.rt for r in joins.asof_forward(left, right, "t", "rt", rows_per_part=rows_per_part).collect()} == want
    hops = {v: min([x for kk, x, _ in b if ok(k, kk) and x > rt], default=-1.0) for k, rt, v in b}
    spans = joins.intervals(right, "rt", keys, F.lit(-1.0), rows_per_part).collect()
    assert {r.v: r.hi for r in spans if r.hi != r.lo} == {v: h for v, h in hops.items() if v in {r.v for r in spans if r.hi != r.lo}} and len(spans) == 60


def test_crossing_grid(spark):
    c = spark.createDataFrame([(3600.0, 1, "BSI"), (5000.0, 2, "BSO"), (6000.0, 0, None)], "t double, code int, label string")
    rows = joins.crossing_fill(c, 0.0, 3 * 3600.0, 3600.0).orderBy("t").collect()
    assert [(r.t, r.code, r.label) for r in rows] == [(3600.0, 1, "BSI"), (7200.0, 0, "BSO"), (10800.0, 0, None), (14400.0, 0, None)]


def test_no_nested_loops(spark):
    left = spark.range(1000).select(F.col("id").cast("double").alias("t"))
    right = spark.range(50).select((F.col("id") * 20).cast("double").alias("ct"), F.col("id").alias("code"))
    for df in (joins.asof_backward(left, right, "t", "ct"), joins.in_intervals(left, right.withColumn("hi", F.col("ct") + 5), "t", "ct", "hi")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_closed_interval_holds_both_ends(spark):
    t = spark.range(300).select(F.col("id").cast("double").alias("t"))
    s = spark.createDataFrame([(60.0, 119.0), (100.0, 130.0), (5.0, 4.0)], "lo double, hi double")
    assert joins.in_intervals(t, s, "t", "lo", "hi", width=50.0).count() == 60 + 31
    assert joins.in_intervals(t, s, "t", "lo", "hi", how="left_anti", width=50.0).count() == 300 - 71


PEERS = "event_id bigint, segment_idx bigint, t0 double, t1 double, period_min double, is_duplicate boolean"


def test_peers(spark):
    rows = [(1, 1, 0.0, 100.0, 15.0, False), (2, 1, 40.0, 140.0, 60.0, False), (3, 1, 100.0, 200.0, 30.0, False), (4, 2, 0.0, 100.0, 15.0, False), (5, 1, 0.0, 100.0, 15.0, True), (6, 1, 50.0, 50.0, 9.0, False)]
    df = spark.createDataFrame(rows, PEERS)
    got = {r.event_id: (r.peer_event_ids, r.peer_overlap_frac) for r in joins.peers(df).collect()}
    assert got[1] == ([2], [0.6]) and got[2] == ([1], [0.6]) and got[3] == ([], [])
    assert got[4] == got[5] == got[6] == ([], [])
    assert {r.event_id: r.peer_event_ids for r in joins.peers(df, 0.0).collect()}[2] == [1, 3]
    with pytest.raises(ValueError):
        joins.peers(df, 1.5)


def test_running_mean_repeats_edges(spark):
    v = [random.Random(1).random() for _ in range(40)]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, i int, v double")
    got = [r.m for r in ordered.running_mean(df, "v", 7, ["k"], ["i"], "m").orderBy("i").collect()]
    assert got == pytest.approx(np.convolve(np.pad(v, 3, mode="edge"), np.ones(7) / 7, mode="valid"))


def test_resample_and_fill(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (0, 10.0, 10.0), (0, 25.0, 40.0)], "k int, t double, v double")
    got = [(r.i, r.value) for r in ordered.resample(df, "t", "v", 5.0, ["k"]).orderBy("i").collect()]
    assert got == [(0, 0.0), (1, 5.0), (2, 10.0), (3, 20.0), (4, 30.0)]
    h = spark.createDataFrame([(0, i, x) for i, x in enumerate([None, 1.0, None, None, 4.0, None])], "k int, i int, v double")
    assert [r.v for r in ordered.fill(h, "v", ["k"], ["i"], "linear").orderBy("i").collect()] == [1, 1, 2, 3, 4, 4]
    with pytest.raises(ValueError):
        ordered.fill(h, "v", ["k"], ["i"], "cubic")


SPEC = GridSpec(n_r=20, n_lat=18, n_lt=24, r=(0.0, 40.0))


def test_grid_totals(spark):
    rng = random.Random(5)
    rows = [(rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(-9, 9), rng.choice([0, 1, 2, 9, 5])) for _ in range(2000)]
    b = grids.with_bins(spark.createDataFrame(rows, "x double, y double, z double, code int"), SPEC)
    s = grids.dwell_stats(b).first()
    g = grids.dwell_regions(b, ["i_r", "i_lat", "i_lt"], 2.0).agg(*[F.sum(c).alias(c) for c in ("total", "region_0", "region_1", "region_2", "region_9")]).first()
    assert s.n_in + s.n_out == 2000 and g.total == 2.0 * s.n_in
    assert g.total - sum(g[f"region_{k}"] for k in grids.KNOWN) == 2.0 * b.filter("in_range AND code = 5").count()


def test_rate_floor(spark):
    dw = spark.createDataFrame([(1, 600.0), (2, 599.9), (3, 1000.0), (4, 700.0)], "b int, minutes double")
    e = spark.createDataFrame([(1, 300.0), (2, 10.0), (4, 900.0)], "b int, minutes double")
    assert {r.b: r.rate for r in grids.rate(e, dw, ["b"]).collect()} == {1: 0.5, 2: None, 3: 0.0, 4: 1.0}
    assert {r.b: r.rate for r in grids.rate(e, dw, ["b"], clip=False).collect()}[4] == pytest.approx(900 / 700)


def test_coverage_merges(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 7.0), (1, 10.0, 12.0), (1, 13.0, 14.0), (2, 1.0, 2.0)], "k int, lo double, hi double")
    assert sorted((r.k, r.lo, r.hi) for r in grids.coverage(df, "lo", "hi", ["k"]).collect()) == [(1, 0, 12), (1, 13, 14), (2, 1, 2)]


def test_separations_of_nothing(spark):
    empty = stats.separations(spark.createDataFrame([(1.0,)], "t double"), "t", 48.0)
    assert tuple(stats.separation_stats(empty).first()) == (0.0, 0.0, 0.0, 0)


def test_eigenvalues(spark):
    m = np.array([[2.0, 0.3, -0.1], [0.3, 1.0, 0.2], [-0.1, 0.2, 0.5]])
    got = spark.range(1).select(*stats.eigenvalues3(*[F.lit(float(m[i])) for i in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))])).first()
    assert tuple(got) == pytest.approx(np.linalg.eigvalsh(m))


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Over the whole matrix: least-cost assignment of all rows (no more than columns) by successive shortest paths."""
    n, m = cost.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            step = cost[p[j0] - 1] - u[p[j0]] - v[1:]
            better = free & (step < least[1:])
            least[1:][better], way[1:][better] = step[better], j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            d = least[j1]
            u[p[used]] += d
            v[used] -= d
            least[1:][free] -= d
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    return sorted((int(p[j]) - 1, j - 1) for j in range(1, m + 1) if p[j])


def test_perfect_detections_score_one(spark):
    t = spark.createDataFrame([(i, 1, 5e4 * i, 5e4 * i + 2e4) for i in range(3)], "tid bigint, ds bigint, a0 double, a1 double")
    d = t.toDF("did", "ds", "b0", "b1")
    assert sorted((r.tid, r.did, r.iou) for r in scoring.assign(t, d).collect()) == [(i, i, 1.0) for i in range(3)]


def plain_scores(truth, found):
    """The measures of one data set in plain Python, over the whole overlap matrix."""
    real, decoys = [t for t in truth if not t["decoy"]], [t for t in truth if t["decoy"]]
    iou = lambda t, d: max(0.0, min(t["a1"], d["b1"]) - max(t["a0"], d["b0"])) / (max(t["a1"], d["b1"]) - min(t["a0"], d["b0"]))
    m = np.array([[iou(t, d) for d in found] for t in real]).reshape(len(real), len(found))
    pairs = [] if not m.size else [(j, i) for i, j in hungarian(-m.T)] if len(real) > len(found) else hungarian(-m)
    tp = lambda v: sum(m[i, j] >= v for i, j in pairs)
    f1 = lambda n: (lambda p, r: 2 * p * r / (p + r) if p + r else 0.0)(n / len(found) if found else 1.0, n / len(real) if real else 1.0)
    hits = [(real[i], found[j], m[i, j]) for i, j in pairs if m[i, j] >= 0.2]
    errors = [abs(d["period"] - t["period"]) / t["period"] * 100 for t, d, _ in hits]
    seen = sum(any(iou(t, d) > 0.1 for d in found) for t in decoys)
    out = {"tp": len(hits), "f1": f1(len(hits)), "band_accuracy": sum(t["band"] == d["band"] for t, d, _ in hits) / len(hits) if hits else 1.0, "decoy_rejection": 1 - seen / len(decoys) if decoys else 1.0}
    out |= {"period_error_mean": float(np.mean(errors)) if hits else 0.0, "period_error_median": float(np.median(errors)) if hits else 0.0, "mean_iou": float(np.mean([x[2] for x in hits])) if hits else 0.0}
    out |= {"mean_latency": float(np.mean([d["peak"] - (t["a0"] + t["a1"]) / 2 for t, d, _ in hits])) if hits else 0.0}
    out |= {f"f1_{round(100 * v)}": f1(tp(v)) if real and found else 0.0 for v in (0.1, 0.2, 0.3, 0.5)}
    for g in scoring.DIFFICULTIES:
        n = sum(t["difficulty"] == g for t in real)
        out[f"recall_{g}"] = sum(t["difficulty"] == g for t, *_ in hits) / n if n else None
    return out


def test_scores_match_plain_python(spark):
    rng = random.Random(12)
    truth = [{"tid": i, "ds": rng.randrange(5), "a0": (a := rng.uniform(0, 3e5)), "a1": a + rng.uniform(3e3, 2e4), "period": rng.uniform(10, 100), "band": rng.choice("AB"), "difficulty": rng.choice(scoring.DIFFICULTIES[:3]), "decoy": rng.random() < 0.2} for i in range(80)]
    found = [{"did": i, "ds": rng.choice((0, 1, 2, 3, 6)), "b0": (b := rng.uniform(0, 3e5)), "b1": b + rng.uniform(3e3, 2e4), "period": rng.uniform(10, 100), "band": rng.choice("AB"), "peak": b + 1e3} for i in range(70)]
    rows = lambda x, schema: spark.createDataFrame([tuple(r.values()) for r in x], schema)
    t, f = rows(truth, scoring.TRUTH), rows(found, scoring.FOUND)
    got = {r.ds: r for r in scoring.scores(t, f).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6]
    want = {k: plain_scores([x for x in truth if x["ds"] == k], [x for x in found if x["ds"] == k]) for k in got}
    for k, w in want.items():
        for n, v in w.items():
            assert (got[k][n] is None) == (v is None) and (v is None or got[k][n] == pytest.approx(v)), (k, n)
    s = scoring.suite(scoring.scores(t, f), F.col("ds") % 2).first()
    tp, n_real = sum(w["tp"] for w in want.values()), sum(not x["decoy"] for x in truth)
    p, r = tp / len(found), tp / n_real
    assert s.f1 == pytest.approx(2 * p * r / (p + r)) and s.f1_30 == pytest.approx(np.mean([w["f1_30"] for w in want.values()]))
    period = 1 - sum(w["period_error_mean"] * w["tp"] for w in want.values()) / tp / 100
    five = [s.f1, s.band_accuracy, max(0.0, period), s.decoy_rejection, np.mean([w["mean_iou"] for w in want.values() if w["mean_iou"] > 0])]
    assert s.composite == pytest.approx(1 / sum(a / max(b, 1e-10) for a, b in zip(scoring.WEIGHTS, five, strict=True)))
    assert [x.tier for x in s.tiers] == ["0", "1"]


def test_welch_of_a_sine():
    x = 2 * np.sin(2 * np.pi * np.arange(2160) / 60)
    f, p = signal.welch(x, 60.0, 720)
    assert 1 / f[np.argmax(p)] == pytest.approx(3600)
    assert np.sum(p) * (f[1] - f[0]) == pytest.approx(2.0, rel=0.02)


@pytest.mark.parametrize("minutes", [30, 60, 120])
def test_detector_finds_packets(minutes):
    rng, n = np.random.default_rng(2), 2160
    i = np.arange(n)
    env = np.exp(-0.5 * ((i - 1000) / (3 * minutes)) ** 2) * 1.5
    a, b = (f(2 * np.pi * i / minutes) * env + rng.normal(size=n) / 10 for f in (np.sin, np.cos))
    found = signal.detect(rng.normal(size=n) / 10, a, b)
    assert len(found) == 1
    assert found[0]["period_sec"] == pytest.approx(minutes * 60, rel=0.05)
    assert abs(found[0]["i"] - 1000) < minutes and found[0]["stokes_d"] > 0.9 and abs(found[0]["ellipticity"]) > 0.8


def test_noise_alone_is_quiet():
    rng = np.random.default_rng(8)
    for method in ("chi2", "fdr", "mad"):
        assert len(signal.detect(*rng.normal(size=(3, 2160)), method=method)) <= 1
    with pytest.raises(ValueError):
        signal.detect(*rng.normal(size=(3, 2160)), method="pooled")


@pytest.mark.parametrize("ellipticity", [-1.0, -0.5, 0.0, 0.5, 1.0])
@pytest.mark.parametrize("tilt", [0.0, 30.0, 80.0])
def test_stokes_recovers_geometry(ellipticity, tilt):
    t, c, s = np.arange(2000) / 50, math.cos(math.radians(tilt)), math.sin(math.radians(tilt))
    u, v = np.cos(2 * np.pi * t), ellipticity * np.sin(2 * np.pi * t)
    e, angle, frac = signal.geometry(*signal.stokes(signal.analytic(c * u - s * v), signal.analytic(s * u + c * v)))
    assert abs(e) == pytest.approx(abs(ellipticity), abs=0.02) and frac == pytest.approx(1, abs=0.01)
    if abs(ellipticity) < 1:
        assert abs((angle - tilt + 90) % 180 - 90) < 2


@pytest.mark.parametrize("a", [0.3, 0.6, 0.9, 0.95, -0.5])
def test_lag1_recovers(a):
    rng, x = np.random.default_rng(6), [0.0]
    for e in rng.normal(size=20000):
        x.append(a * x[-1] + e)
    assert signal.lag1(np.array(x)) == pytest.approx(a, abs=0.02)


def test_labels_are_8_connected():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0]], bool)
    assert signal.labels(m).tolist() == [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 1, 0], [3, 0, 0, 0]]


def test_trace_matches_the_closed_form(spark):
    rows = [(i, float(r * math.cos(a)), 0.0, float(r * math.sin(a))) for i, (r, a) in enumerate([(3, 0.1), (8, -0.3), (15, 0.5), (0.5, 0.0), (5, 1.2)])]
    got = {r.i: r for r in tracing.enrich(spark.createDataFrame(rows, "i int, x double, y double, z double")).collect()}
    for i, (r, a) in enumerate([(3, 0.1), (8, -0.3), (15, 0.5)]):
        want = math.degrees(math.acos(1 / math.sqrt(r / math.cos(a) ** 2)))
        assert got[i].lat_north == pytest.approx(want, abs=0.1) and got[i].lat_south == pytest.approx(-want, abs=0.1) and got[i].closed
    assert got[3].lat_north is None


def test_segments_stay_whole_over_batches(spark):
    import pandas as pd

    rng = random.Random(7)
    rows = [(k, i, float(k * 1000 + i)) for k in range(40) for i in range(rng.randrange(1, 900))] + [(None, 1, 0.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seg bigint, i int, v double")
    one = lambda v: pd.DataFrame({"n": [len(v)], "first": [v[0]], "up": [bool((np.diff(v) == 1).all())]}) if len(v) > 5 else pd.DataFrame({"n": [], "first": [], "up": []})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    got = {r.seg: (r.n, r.first, r.up) for r in signal.per_segment(df, "seg", "i", ["v"], one, "n bigint, first double, up boolean").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = {k: sum(r[0] == k for r in rows) for k in range(40)}
    assert got == {k: (n, k * 1000.0, True) for k, n in sizes.items() if n > 5}


@pytest.mark.parametrize("rows_per_part", [9, 10_000])
def test_quantiles_ranks_and_numbers_over_ranges(spark, rows_per_part, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_PART", rows_per_part)
    for f in (joins.ranges, ordered.cumulated, ordered.numbered):
        monkeypatch.setattr(f, "__defaults__", tuple(rows_per_part if x == 20_000 else x for x in f.__defaults__))
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice((None, float(rng.randrange(30)), rng.random())), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, i bigint")
    got = {r.g: r for r in stats.quantiles(df, F.col("v"), ["g"], {"q1": 0.25, "med": 0.5, "top": 1.0}).collect()}
    for g in "ab":
        own = [v for k, v, _ in rows if k == g and v is not None]
        assert got[g].n == len(own) and (got[g].q1, got[g].med, got[g].top) == pytest.approx(tuple(np.quantile(own, (0.25, 0.5, 1.0))))
    live = df.dropna()
    ranks = {r.i: r.a for r in stats.average_ranks(live, "v", ["g"], "a").collect()}
    for k, v, i in rows:
        if v is not None:
            own = [x for g, x, _ in rows if g == k and x is not None]
            assert ranks[i] == sum(x < v for x in own) + (1 + sum(x == v for x in own)) / 2
    numbers = {r.i: r.n for r in ordered.numbered(df, ["v", "i"], "n").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
    assert numbers == {r[2]: k for k, r in enumerate(order)}


def test_pairs_need_three_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", None, 1.0)], "g string, x double, y double")
    with pytest.raises(ValueError, match="fewer than 3"):
        stats.paired(df, "x", "y", ["g"])


def test_second_degree_fit(spark):
    df = spark.range(1, 30).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("f"), F.exp(2 + 0.5 * F.ln("id") - 0.3 * F.ln("id") * F.ln("id")).alias("p"))
    assert stats.power_law_degree(df, "f", "p", ["g"], 2).first().coefficients == pytest.approx([2, 0.5, -0.3])


def test_fused_packets_are_split():
    """Maxima whose valley lies half power below the higher one are two packets; shallower ones are one."""
    n = 2000
    bump = lambda at: np.exp(-0.5 * ((np.arange(n) - at) / 150) ** 2)
    for low, parts in ((0.6, 2), (0.8, 1)):
        row = np.maximum(np.maximum(bump(600), 0.98 * bump(1400)), low * (np.abs(np.arange(n) - 1000) < 400))
        got = signal.split_ridge(row[None, :], {"i0": 0, "i1": n - 1, "row": 0, "i": 600, "power": 1.0}, 60.0)
        assert len(got) == parts
        if parts == 2:
            assert [x["i"] for x in got] == [600, 1400] and got[0]["i1"] == got[1]["i0"] and got[0]["power"] == pytest.approx(1.0)
    short = signal.split_ridge(np.array([[0.0, 1, 0, 1, 0]]), {"i0": 0, "i1": 4, "row": 0, "i": 1, "power": 1.0}, 60.0)
    assert len(short) == 1 and short[0]["i1"] == 4  # parts that are too short don't replace the ridge


def test_two_packets_are_two_events():
    rng, n = np.random.default_rng(3), 2160
    i = np.arange(n)
    env = 1.5 * (np.exp(-0.5 * ((i - 650) / 120) ** 2) + np.exp(-0.5 * ((i - 1500) / 120) ** 2)) + 0.25
    a, b = (f(2 * np.pi * i / 60) * env + rng.normal(size=n) / 10 for f in (np.sin, np.cos))
    found = sorted(x["i"] for x in signal.detect(rng.normal(size=n) / 10, a, b))
    assert len(found) == 2 and abs(found[0] - 650) < 60 and abs(found[1] - 1500) < 60


def test_prominence_of_plateaus_and_ends():
    x = np.array([3.0, 1, 2, 2, 1, 0, 2.5, 0.5, 4])
    assert signal.prominent(x, 0.5) == [2, 6] and signal.prominent(x, 1.5) == [6] and signal.prominent(np.ones(5), 0.0) == []


def test_vertex_stays_within_half_a_row():
    f = np.linspace(1e-4, 1e-3, 10)
    level = lambda *v: np.array([[x] for x in np.exp(v)])
    amp = np.ones((10, 1))
    amp[3:6] = level(0.0, 1.0, 0.9)
    p = signal.vertex(amp, f, 4, 0)
    assert 1 / f[5] < p < 1 / f[4]
    amp[3:6] = level(0.0, 0.1, 5.0)
    assert signal.vertex(amp, f, 4, 0) == 1 / f[4] and signal.vertex(amp, f, 0, 0) == 1 / f[0]


def test_phase_shift_of_a_lag():
    t = np.arange(1200) * 60.0
    delay, phase = signal.phase_shift(np.sin(2 * np.pi * (t - 900) / 3600), np.sin(2 * np.pi * t / 3600), 60.0, 3600.0)
    assert delay == 900 and phase == pytest.approx(90)


def test_red_noise_keeps_its_shape_without_noise_rows():
    f = np.linspace(1 / 5000, 1 / 4000, 20)
    x = np.cumsum(np.random.default_rng(1).normal(size=500))
    level = signal.red_noise(np.random.default_rng(2).exponential(size=(20, 500)), f, x, 60.0)
    assert (np.diff(level) < 0).all()

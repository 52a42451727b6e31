"""Interval levels, band masks and event grids against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions.bins import GridSpec, value_to_bin
from packetloom.operators import grids, joins, tracing

SPEC = GridSpec(n_r=20, n_lat=18, n_lt=24, r=(0.0, 40.0))
SPANS = "k int, lo double, hi double, band string"


def drawn(seed=1, n=60):
    """Points over a year, and intervals from a second to all of it."""
    rng = random.Random(seed)
    points = [(i, rng.randrange(3), float(rng.randrange(0, 31_000_000, 10))) for i in range(400)] + [(900, None, 5.0), (901, 1, None)]
    spans = [(rng.randrange(3), a := float(rng.randrange(0, 31_000_000, 10)), a + float(rng.choice([0, 10, 3600, 90_000, 2_000_000, 40_000_000]) * rng.random()), rng.choice("ABC")) for _ in range(n)]
    return points, [*spans, (1, 50.0, 40.0, "A"), (2, -1e7, -5e6, "B"), (None, 0.0, 9e9, "C"), (0, points[0][2], points[0][2], "C")]


def tables(spark, points, spans):
    return spark.createDataFrame(points, "i int, k int, t double"), spark.createDataFrame(spans, SPANS)


@pytest.mark.parametrize("width", [10.0, 3600.0, 1e6])
def test_intervals_of_all_lengths_meet_their_points(spark, width):
    points, spans = drawn()
    p, s = tables(spark, points, spans)
    want = sorted((i, lo, hi, b) for i, k, t in points for kk, lo, hi, b in spans if k is not None and k == kk and t is not None and lo <= t <= hi)
    got = joins.in_intervals(p, s, "t", "lo", "hi", ["k"], width=width)
    assert got.columns == ["i", "k", "t", "lo", "hi", "band"]
    assert sorted((r.i, r.lo, r.hi, r.band) for r in got.collect()) == want
    left = joins.in_intervals(p, s, "t", "lo", "hi", ["k"], how="left_anti", width=width)
    assert sorted(r.i for r in left.collect()) == sorted({i for i, *_ in points} - {w[0] for w in want})
    with pytest.raises(ValueError):
        joins.in_intervals(p, s, "t", "lo", "hi", how="full")


def test_a_long_interval_is_a_few_rows(spark):
    year = 365.25 * 86400.0
    s = spark.createDataFrame([(0.0, 13 * year), (-1e300, 1e300), (float("-inf"), float("inf")), (10.0, 20.0)], "lo double, hi double")
    rows, levels = joins._leveled(s, "lo", "hi", 60.0)
    n = {r.lo: r["count"] for r in rows.groupBy("lo").count().collect()}
    assert all(1 <= x < 100 for x in n.values()) and n[10.0] == 1 and levels[0] == 0
    p = spark.createDataFrame([(0.0,), (5 * year,), (-5.0,)], "t double")
    assert joins.in_intervals(p, s, "t", "lo", "hi", width=60.0).count() == 2 + 6


@pytest.mark.parametrize("width", [10.0, 3600.0])
def test_masks_gather_all_bands_once(spark, width):
    points, spans = drawn(7, 120)
    p, s = tables(spark, points, spans)
    bit = F.when(F.col("band") == "A", 1).when(F.col("band") == "B", 2).otherwise(4)
    got = joins.interval_masks(p.withColumn("x", F.col("i") * 2), s, "t", "lo", "hi", ["i"], bit, ["k"], width)
    assert got.columns == ["i", "k", "t", "x", "mask"]
    want = {}
    for i, k, t in points:
        for kk, lo, hi, b in spans:
            if k is not None and k == kk and t is not None and lo <= t <= hi:
                want[i] = want.get(i, 0) | {"A": 1, "B": 2, "C": 4}[b]
    rows = got.collect()
    assert {r.i: r.mask for r in rows} == want and len(rows) == len(want) and all(r.x == 2 * r.i for r in rows)


def test_masks_of_short_intervals_need_no_second_shuffle(spark):
    p = spark.range(1000).select(F.col("id").alias("i"), F.lit(1).alias("k"), F.col("id").cast("double").alias("t"))
    s = spark.createDataFrame([(1, 5.0, 9.0), (1, 7.0, 12.0)], "k int, lo double, hi double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = joins.interval_masks(p, s, "t", "lo", "hi", ["i"], F.lit(1), ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # the join's two sides


def samples(spark, n=1440):
    """A day at one place, a minute a sample, in one segment."""
    return spark.range(n).select(F.col("id").alias("i"), F.lit(1).alias("seg"), (F.col("id") * 60).cast("double").alias("t"), F.lit(15.0).alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("z"), (F.col("id") % 4).cast("int").alias("code"))


def gridded(spark, spans, own=None):
    s = spark.createDataFrame(spans, "seg int, lo double, hi double, band string")
    bit = F.when(F.col("band") == "A", 1).when(F.col("band") == "B", 2)
    x = own if own is not None else samples(spark)
    b = grids.with_bins(joins.interval_masks(x, s, "t", "lo", "hi", ["i"], bit, ["seg"]), SPEC)
    return grids.event_grids(b, ["A", "B"], {"position": (F.col("in_range"), [F.col("i_r"), F.col("i_lat"), F.col("i_lt")]), "polar": (F.col("in_range"), [F.col("i_r"), F.col("i_lt")])}).collect()


def test_event_grid_counts_shared_minutes_once(spark):
    out = gridded(spark, [(1, 3600.0, 3600.0 + 239 * 60, "A"), (1, 7200.0, 7200.0 + 299 * 60, "A"), (1, 10800.0, 10800.0 + 59 * 60, "B"), (2, 0.0, 9e9, "A"), (1, 0.0, 600.0, None)])
    got = {(r.schema, r.band): r for r in out}
    assert len(out) == len(got) == 6
    assert got["position", "A"].total == 360 and got["position", "B"].total == 60 and got["position", "total"].total == 360
    assert got["polar", "A"].k is None and got["position", "A"].k is not None
    assert [got["position", "B"][f"region_{c}"] for c in (0, 1, 2, 9)] == [15, 15, 15, 0]


def test_owned_part_of_a_segment(spark):
    own = grids.owned(samples(spark), "t", ["seg"], 3600.0, 7200.0)
    assert (own.count(), own.agg(F.min("i"), F.max("i")).first()) == (120, (60, 179))
    assert sum(r.total for r in gridded(spark, [(1, 0.0, 9e5, "A")], own) if r.schema == "position" and r.band == "total") == 120
    assert grids.owned(samples(spark).limit(0), "t", ["seg"], 0.0, 1.0).count() == 0


def test_traced_grids_trace_each_event_sample_once(spark):
    """The dipole's lines: what is traced is the union of the events, and the grids follow from it."""
    rng = random.Random(3)
    rows = [(i, 1, 60.0 * i, rng.uniform(-12, 12), rng.uniform(-12, 12), rng.uniform(-4, 4), rng.choice([0, 1, 2, 9])) for i in range(300)]
    x = spark.createDataFrame(rows, "i int, seg int, t double, x double, y double, z double, code int").withColumn("lt", F.pmod(F.degrees(F.atan2("y", "x")) / 15 + 12, F.lit(24.0)))
    spans = spark.createDataFrame([(1, 0.0, 6000.0, "A"), (1, 3000.0, 9000.0, "B"), (1, 3000.0, 9000.0, "A")], "seg int, lo double, hi double, band string")
    traced = spark.sparkContext.accumulator(0)

    def trace(df):
        def count(batches):
            for b in batches:
                traced.add(len(b))
                yield b

        counted = df.mapInPandas(count, df.schema)
        return tracing.enrich(counted).withColumn("l_eq", F.col("apex"))

    bit = F.when(F.col("band") == "A", 1).otherwise(2)
    out = grids.event_grids_traced(x, spans, "t", "lo", "hi", ["i"], bit, ["A", "B"], trace, SPEC, ["seg"]).collect()
    assert traced.value == 151
    lines = {r.i: r for r in tracing.enrich(x).withColumn("b", value_to_bin(F.col("apex"), 0.0, 40.0, 20)).collect()}
    for band, last in (("A", 150), ("B", 150), ("total", 150)):
        first = 50 if band == "B" else 0
        own = [lines[i] for i in range(first, last + 1)]
        for schema, closed in (("eq_r", False), ("eq_r_closed", True)):
            want = sum(1 for r in own if 0 <= r.apex < 40 and (r.closed or not closed) and not math.isnan(r.apex))
            assert sum(r.total for r in out if r.schema == schema and r.band == band) == want
        north = sum(1 for r in own if r.z >= 0 and r.lat_north is not None and not math.isnan(r.lat_north)) + sum(1 for r in own if r.z < 0 and r.lat_south is not None and not math.isnan(r.lat_south))
        assert sum(r.total for r in out if r.schema == "inv_lat" and r.band == band) == north


def test_scratch_refuses_machine_local_folders_on_a_cluster():
    from types import SimpleNamespace

    from packetloom import session

    conf = SimpleNamespace(get=lambda _: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        session.scratch(cluster, "x")

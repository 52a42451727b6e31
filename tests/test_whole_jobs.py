"""Queries without SQL do the whole job that their names say: all rows, all steps of the grid."""

import os

import numpy as np
import pandas as pd
import pytest

from packetloom.operators import tracing
from packetloom.plans import catalogue, q_signal
from packetloom.plans.registry import ev, pos

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def test_peak_trace_takes_the_nearest_sample_of_every_event(spark):
    got = catalogue.queries()["enr_peak_trace"](spark, D).toPandas().sort_values("event_id", ignore_index=True)
    events = ev(spark, D).select("event_id", "t").toPandas().sort_values("event_id", ignore_index=True)
    assert got.event_id.tolist() == events.event_id.tolist()
    p = pos(spark, D).toPandas().sort_values(["t", "id", "n"]).drop_duplicates("t")
    at = [int(np.argmin(np.abs(p.t.to_numpy() - t))) for t in events.t]  # the earlier of two as near
    start = p[["x", "y", "z"]].to_numpy(float)[at]
    ok = np.linalg.norm(start, axis=1) > 1
    want = tracing.trace(start[ok])
    signed = np.where(start[ok][:, 2] < 0, want.lat_south, want.lat_north)
    assert np.allclose(got.inv_lat[ok].to_numpy(float), signed, equal_nan=True) and np.allclose(got.apex[ok].to_numpy(float), want.apex)
    assert got.closed[ok].tolist() == want.closed.tolist() and not got.closed[~ok].any()


def test_footpoints_count_every_position(spark):
    got = catalogue.queries()["enr_footpoint"](spark, D).toPandas()
    assert got.n.sum() == q_signal.positions(spark, D).count()


@pytest.mark.parametrize("one, n_values", [(q_signal._cwt, 1), (q_signal._coherence, 2), *[(q_signal._masked(k), 1) for k in ("mad", "chi2", "fdr", "pooled")]])
def test_wavelet_rows_reach_every_band(one, n_values):
    rng = np.random.default_rng(5)
    out: pd.DataFrame = one(*[rng.normal(size=1536) for _ in range(n_values)])
    period = 1 / out.f
    assert len(out) == (500 if one is q_signal._cwt else 300)
    assert ((period > 4800) & (period < 9600)).sum() >= 3 and ((period > 2400) & (period < 4800)).sum() >= 6


def test_lines_stepped_together_are_those_stepped_alone(monkeypatch):
    """Room that ended lines leave is filled up; no line depends on what is stepped beside it."""
    import numpy as np

    from packetloom.operators import tracing

    start = np.random.default_rng(4).uniform(-20, 20, (40, 3))
    start[:3] = [[0.1, 0, 0.2], [0.0, 0.0, 3.0], [60.0, 5.0, 70.0]]  # within the planet, along the axis, open
    alone = [tuple(tracing.trace(start[k : k + 1]).iloc[0]) for k in range(len(start))]
    monkeypatch.setattr(tracing, "POOL", 6)
    np.testing.assert_allclose(tracing.trace(start).to_numpy(float), np.array(alone, dtype=float), rtol=0, atol=1e-9)


def test_a_sample_near_to_many_events_is_traced_once(spark, monkeypatch):
    from packetloom.operators import tracing
    from packetloom.plans import catalogue
    from packetloom.plans.registry import pos

    d, seen, enrich = "/root/testdata/sf0.001", [], tracing.enrich
    monkeypatch.setattr(tracing, "enrich", lambda df, **k: seen.append(df.count()) or enrich(df, **k))
    assert catalogue.queries()["enr_peak_trace"](spark, d).count() == spark.read.parquet(f"{d}/events.parquet").count()
    assert seen == [pos(spark, d).filter("t IS NOT NULL").select("t").distinct().count()]


def test_flags_are_sorted_only_where_order_is_asked_for(spark):
    """A report doesn't sort, and a sort has nothing to parse again."""
    from packetloom.sources import tables as src

    lines = spark.createDataFrame([("2005-002T00:00:30.5 FGM range 3",), ("nothing",), (None,), ("Each 2005-002T00:00:30",), ("2005-001 00:00:30 VHM",)], "value string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    report = src.flag_report(src.all_flags([src.parse_ranges(lines)], ordered=False), 1.0)
    assert "Sort" not in plan(report)
    assert not any("regexp_extract" in x for x in plan(src.parse_ranges(lines)).splitlines() if "Filter" in x)
    out = src.all_flags([src.parse_ranges(lines)])
    assert "regexp" not in plan(out) and [r.sensor for r in out.collect()] == ["VHM", "FGM"]

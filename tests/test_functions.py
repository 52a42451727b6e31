"""Column functions against analytic values and edge cases."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from packetloom.functions import bands, bins, coords, times
from packetloom.session import clean, require_columns


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit3(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_unit_vector_keeps_zero(spark):
    assert tuple(one(spark, *coords.unit_vector(lit3(0, 0, 0)))) == (0.0, 0.0, 0.0)
    assert tuple(one(spark, *coords.unit_vector(lit3(0, 3, 4)))) == pytest.approx((0, 0.6, 0.8))


@pytest.mark.parametrize("l_shell", [2.0, 5.0, 15.0, 30.0])
def test_invariant_latitude_of_equatorial_points(spark, l_shell):
    want = math.degrees(math.acos(1 / math.sqrt(l_shell)))
    assert one(spark, coords.invariant_latitude(*lit3(l_shell, 0, coords.DIPOLE_OFFSET_Z)))[0] == pytest.approx(want)
    below = one(spark, coords.invariant_latitude(*lit3(l_shell, 0, coords.DIPOLE_OFFSET_Z - 1e-9)))[0]
    assert below == pytest.approx(-want)


def test_invariant_latitude_inside_the_planet_is_null(spark):
    assert one(spark, coords.invariant_latitude(*lit3(0.5, 0, 0.037)))[0] is None


def test_local_time_quarters(spark):
    got = one(spark, *[coords.local_time(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 0), (0, 1), (-1, 0), (0, -1))])
    assert tuple(got) == pytest.approx((12, 18, 0, 6))


def test_rotation_keeps_length_and_returns(spark):
    t = F.lit(3.0e8)
    for a, b in (("KSM", "KSO"), ("KSO", "DIS"), ("S3C", "KSM"), ("DIP", "KSO")):
        v = coords.rotate_vector(lit3(1, 2, 3), a, b, t)
        back = one(spark, *coords.rotate_vector(v, b, a, t), coords.norm(v))
        assert tuple(back)[:3] == pytest.approx((1, 2, 3), abs=1e-3)
        assert back[3] == pytest.approx(math.sqrt(14), abs=1e-3)
    with pytest.raises(ValueError):
        coords.axes("XYZ", coords.sun_position(t))


def test_mfa_of_parallel_and_spherical(spark):
    par, p1, p2 = one(spark, *coords.mfa(lit3(10, 2, 1), lit3(0, 0, 2), lit3(0, 0, 5)))
    assert (par, p1, p2) == pytest.approx((2, 0, 0))
    th, ph = 1.1, 0.4
    sph = one(spark, *coords.mfa(lit3(10, th, ph), lit3(1, 2, 3), lit3(3, 1, 0.5), spherical=True))
    car = one(spark, *coords.mfa(coords.sph2car(lit3(10, th, ph)), coords.field_sph2car(lit3(1, 2, 3), F.lit(th), F.lit(ph)), coords.field_sph2car(lit3(3, 1, 0.5), F.lit(th), F.lit(ph))))
    assert tuple(sph) == pytest.approx(tuple(car))


def test_band_edges_are_half_open(spark):
    cases = {599.9: None, 600.0: "QP15", 1200.0: "QP30", 2399.9: "QP30", 4800.0: "QP120", 9600.0: None, 43200.0: None}
    got = one(spark, *[bands.band_of(F.lit(p)) for p in cases])
    assert tuple(got) == tuple(cases.values())
    assert bands.get_band("qp60")[0] == "QP60"
    with pytest.raises(KeyError):
        bands.get_band("QP61")


def test_polarization_tolerance_is_strict(spark):
    got = one(spark, *[bands.polarization_class(F.lit(float(p))) for p in (90, 61, 60, 30, 29, 179, 331, -90, 150)])
    assert tuple(got) == ("circular", "circular", "mixed", "mixed", "linear", "linear", "linear", "circular", "mixed")


def test_crossing_regions(spark):
    cases = {("BS", "I"): 1, ("BS", "O"): 2, ("MP", "I"): 0, ("MP", "O"): 1, ("X", "E_SW"): 2, ("X", "E_SP"): 0, ("X", "S1"): 9, ("X", "Q"): 9}
    assert tuple(one(spark, *[bands.crossing_region(F.lit(a), F.lit(b)) for a, b in cases])) == tuple(cases.values())


def test_bins_clip_and_drop(spark):
    got = one(spark, *[bins.value_to_bin(F.lit(v), 0.0, 10.0, 5) for v in (-1.0, 0.0, 1.99, 2.0, 10.0, 11.0)])
    assert tuple(got) == (0, 0, 0, 1, 4, 4)
    assert one(spark, bins.bin_edges(0.0, 10.0, 5))[0] == [0, 2, 4, 6, 8, 10]


def test_lt_sector_wraps(spark):
    got = one(spark, *[bins.in_lt_range(F.lit(v), 0.0, 2.0) for v in (22.0, 23.9, 0.0, 1.99, 2.0, 12.0)])
    assert tuple(got) == (True, True, True, True, False, False)


def test_doy_and_iso(spark):
    texts = ["2005-032T01:02:03.5", "x 2005-032 01:02:03", "garbage", "2005-366T00:00:00"]
    got = [one(spark, times.parse_doy(F.lit(t)))[0] for t in texts]
    assert got[:3] == [datetime.datetime(2005, 2, 1, 1, 2, 3, 500000), datetime.datetime(2005, 2, 1, 1, 2, 3), None]
    assert one(spark, times.parse_iso(F.lit("a 2001-02-03T04:05:06 b")))[0] == datetime.datetime(2001, 2, 3, 4, 5, 6)
    assert one(spark, times.parse_iso(F.lit("none")))[0] is None


def test_epochs(spark):
    got = one(spark, *[times.epoch_to_j2000(F.lit(1.2e9), F.lit(e)) for e in ("J2000", "i2000", "etime", "ctime", "other")])
    assert tuple(got) == pytest.approx((1.2e9, 1.2e9 + 32.184, 1.2e9, 1.2e9 + 23 - 1072958367.816, None))


def test_nan_is_null_and_columns_are_required(spark):
    assert one(spark, clean(F.lit(float("nan"))))[0] is None
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.range(1).toDF("a"), "a", "b")


def test_local_time_on_the_diagonals(spark):
    """Positions on a diagonal but for the last digits of their difference stand in the hour that begins there, as in SQL."""
    import duckdb

    v = [(v / 100, k) for v in range(1020, 3040) for k in range(100) if abs(abs(v / 100 - 20.3) - abs(k / 5 - 10.1)) < 1e-9]
    df = spark.createDataFrame(v, "v double, k int").select("v", "k", (F.col("v") - 20.3).alias("x"), (F.col("k") / 5.0 - 10.1).alias("y"))
    got = {(r.v, r.k): (r.lt, r.a) for r in df.select("v", "k", coords.local_time(F.col("x"), F.col("y")).alias("lt"), coords.azimuth(F.col("x"), F.col("y")).alias("a")).collect()}
    pairs = ", ".join(f"({a!r}::DOUBLE, {k})" for a, k in v)
    want = duckdb.sql(f"SELECT v, k, ((12 + atan2(y, x) * 12 / pi()) % 24 + 24) % 24, atan2(y, x) FROM (SELECT v, k, v - 20.3 AS x, k / 5.0 - 10.1 AS y FROM (VALUES {pairs}) t(v, k))").fetchall()
    assert len(want) > 150 and got == {(a, k): (lt, at) for a, k, lt, at in want}


def test_a_half_second_is_parsed_to_the_even_one(spark, tmp_path):
    import datetime

    from packetloom.plans import catalogue

    t = [datetime.datetime(2024, 1, 1, 0, 0, s, 500000) for s in (0, 1, 2, 3)]
    rows = [(i, x, 1, "view", 1.0, '{"k": 1}') for i, x in enumerate(t)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.s - 1704067200 for r in catalogue.queries()["fn_parse_dt"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 4}


def test_phase_is_six_degrees_a_minute_of_lag():
    import numpy as np

    from packetloom.operators import signal

    for lag in range(60):  # a pulse that comes later by the lag
        x, y = np.zeros(512), np.zeros(512)
        y[200], x[200 + lag] = 1.0, 1.0
        assert signal.phase_shift(x, y, 60.0, 3600.0) == (lag * 60.0, (lag * 6.0) % 360)

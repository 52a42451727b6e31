"""Text formats and round trips on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from packetloom.session import scratch
from packetloom.sources import tables as src


def lines(spark, *text):
    return spark.createDataFrame([(i, t) for i, t in enumerate(text)], "o int, value string")


def test_text_table(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  2005-01-01T00:00:00  1 2 3 4 5 6 7\n2005-01-01T00:05:00 1 NaN x 4 5 6 7\n2005-01-01T00:10:00 1 2 3 4 5 6 7\n")
    df = src.read_table(spark, str(tmp_path / "a.txt"), "KSM", "2005-01-01 00:03:00", "2005-01-01 00:08:00")
    (row,) = df.collect()
    assert (row.ts, row.bx, row.by, row.bz, row.z) == (datetime.datetime(2005, 1, 1, 0, 5), 1.0, None, None, 7.0)
    assert df.schema["bx"].metadata["units"] == "nT" and len(src.LAYOUTS["KRTP"]) == 9


def test_select_opens_only_its_years(spark):
    path = scratch(spark, "years")
    df = spark.createDataFrame([(datetime.datetime(y, m, 1), float(y)) for y in (2004, 2005, 2006) for m in (1, 6, 12)], "ts timestamp, v double")
    src.write_years(df, path)
    out = src.select_data(spark, path, "2004-12-31 00:00:00", "2005-06-01 00:00:00", 86400 * 40)
    assert sorted((r.ts.year, r.ts.month) for r in out.collect()) == [(2004, 12), (2005, 1), (2005, 6)]
    assert "PartitionFilters: [isnotnull(year" in out._jdf.queryExecution().executedPlan().toString()


def test_segment_errors_when_empty(spark):
    df = spark.createDataFrame([(datetime.datetime(2005, 1, 1, 0, m), 180.0, 90.0) for m in (0, 1, 2, 5)], "ts timestamp, th double, phi double")
    rows, dt = src.read_segment(df, "KRTP")
    assert dt == 60.0 and rows.first().phi == pytest.approx(1.5707963)
    with pytest.raises(ValueError):
        src.read_segment(df.limit(0), "KRTP")


def test_crossing_list(spark):
    out = src.parse_crossings(lines(spark, "2005 32 6 30 BS I 1.5 -2 0.5", "too short", "# 1 2 3 4 5 6 7")).collect()
    assert [(r.t, r.crossing_type, r.direction, r.y) for r in out] == [(datetime.datetime(2005, 2, 1, 6, 30), "BS", "I", -2.0)]


def test_range_and_spurious_and_timing(spark):
    (a, b) = src.parse_ranges(lines(spark, "2005-001T00:00:00.5,  VHM and FGM changed to Range 3", "Time 2005-001T00:00:00", "2005-002T00:00:00 FGM odd")).orderBy("start_time").collect()
    assert (a.sensor, a.description, (a.end_time - a.start_time).seconds) == ("ALL", "ALL to range 3", 60) and b.description == "FGM to range ?"
    assert src.parse_spurious(lines(spark, "2005-001 00:00:00", "nothing")).count() == 1
    (t,) = src.parse_timing(lines(spark, "f,2005-01-01T00:00:00,2005-01-01T01:00:00, why, not", "f,x,y,z", "")).collect()
    assert t.description == "backwards timing: why, not" and t.severity == "negligible"


def test_mode_blocks(spark):
    text = ("preamble", "2005-001T00:00:00 ALL DATA turns off", " more to 2005-002T00:00:00", "2005-003T00:00:00 VHM", "goes scalar/vector", "2005-004T00:00:00 FGM maintenance", "2005-005T00:00:00 reset")
    out = src.parse_modes(lines(spark, *text), "o").orderBy("start_time").collect()
    got = [(r.sensor, r.severity, r.description, (r.end_time - r.start_time).total_seconds()) for r in out]
    assert got == [("ALL", "critical", "instrument off", 86400), ("VHM", "high", "mode switch: scalar/vector", 120), ("FGM", "high", "instrument maintenance", 300), ("ALL", "critical", "instrument reset", 600)]


def test_calibration_pairs(spark):
    text = ("2005-001T00:00:00 FGM SCAS commences", "2005-001T00:30:00 ceases", "2005-001T02:00:00 VHM calibration commences", "2005-001T02:10:00 noted", "2005-001T03:00:00 ceases")
    out = src.parse_calibrations(lines(spark, *text), "o").orderBy("start_time").collect()
    assert [(r.description, (r.end_time - r.start_time).total_seconds()) for r in out] == [("SCAS activity", 1800), ("calibration (no end time)", 3600), ("SCAS event", 300)]


def test_flags_window_and_csv(spark):
    a = src.parse_spurious(lines(spark, "2009-001T00:00:00", "2011-001T00:00:00", "2013-001T00:00:00"))
    empty = src.parse_timing(spark.createDataFrame([], "value string"))
    out = src.all_flags([a, empty], "2010-01-01 00:00:00", "2012-01-01 00:00:00")
    assert out.count() == 1
    path = scratch(spark, "flags")
    out.write.option("header", "true").csv(path)
    assert spark.read.schema(src.FLAGS).option("header", "true").csv(path).collect() == out.collect()
    assert src.all_flags([empty]).count() == 0


def test_event_record_refuses_taken_names(spark):
    df = spark.range(1).select(F.col("id"), F.struct(F.lit(3600.0).alias("period_sec"), F.lit("QP60").alias("band")).alias("peak"))
    assert src.event_record(df).first().asDict() == {"id": 0, "period_min": 60.0, "band": "QP60"}
    with pytest.raises(ValueError, match="band"):
        src.event_record(df, {"band": F.lit("x")})


def test_background_missing(spark, tmp_path):
    assert src.background(spark, str(tmp_path / "none")) is None


def test_resolution_keeps_every_kth_line_of_each_file(spark, tmp_path):
    line = lambda m: f"2004-01-0{1 + m // 1440}T{m // 60 % 24:02d}:{m % 60:02d}:00 {m} 0 0 0 0 0 0"
    for name, step in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.TAB").write_text("\n".join(line(m) for m in range(0, 60, step)) + "\n")
    rows = src.read_table(spark, str(tmp_path), "KSM", resolution_s=300.0).collect()
    assert sorted(r.bx for r in rows) == sorted([*range(0, 60, 5), *range(0, 60, 4)])
    same = src.read_table(spark, str(tmp_path), "KSM", resolution_s=1.0)
    assert same.count() == 90
    src.write_years(src.read_table(spark, str(tmp_path / "a.TAB"), "KSM").selectExpr("*", "'KSM' AS coords"), str(tmp_path / "years"), ("coords",))
    got = src.select_data(spark, str(tmp_path / "years"), "2004-01-01 00:10:00", "2004-01-01 00:20:00", 300, "KSM", 300.0)
    assert sorted(r.bx for r in got.collect()) == [5, 10, 15, 20, 25]
    assert src.select_data(spark, str(tmp_path / "years"), "2004-01-01 00:10:00", "2004-01-01 00:20:00", coords="KSO").count() == 0


def test_mission_without_rows_is_an_error(spark, tmp_path):
    src.write_years(spark.sql("SELECT TIMESTAMP '2005-03-01 00:00:00' AS ts, 1.0 AS x"), str(tmp_path / "m"))
    assert src.load_mission(spark, str(tmp_path / "m"), 2004, 2005).count() == 1
    with pytest.raises(ValueError, match="no rows"):
        src.load_mission(spark, str(tmp_path / "m"), 2010, 2012)

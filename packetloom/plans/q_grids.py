"""Queries of the occupancy, event and rate grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import coords
from packetloom.functions.bins import GridSpec, in_lt_range, value_to_bin
from packetloom.operators import grids, joins
from packetloom.plans.q_functions import LT, MLAT, RHO, apply_filter
from packetloom.plans.registry import CAT, EV, POS, cat, ev, pos, query, r6

SPEC = GridSpec(n_r=20, n_lat=18, n_lt=24, r=(0.0, 40.0))
EVP = f"(SELECT event_id, user_id, t, k, value - 20.3 AS x, k / 5.0 - 10.1 AS y, event_id % 17 - 8.2 AS z, k % 4 AS code FROM {EV})"


def binned_sql(base: str) -> str:
    return f"""(SELECT *, r >= 0 AND r < 40 AND lat >= -90 AND lat < 90 AND lt >= 0 AND lt < 24 AS in_range, CAST(floor(r / 40 * 20) AS INTEGER) AS i_r,
  CAST(floor((lat + 90) / 180 * 18) AS INTEGER) AS i_lat, CAST(floor(lt / 24 * 24) AS INTEGER) AS i_lt FROM (SELECT *, {RHO} AS r, {MLAT} AS lat, {LT} AS lt FROM {base}))"""


B = binned_sql(POS)
BE = binned_sql(EVP)


def binned(spark: SparkSession, d: str) -> DataFrame:
    return grids.with_bins(pos(spark, d), SPEC)


def event_positions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return ev(spark, d).select("event_id", "user_id", "t", "k", (F.col("value") - 20.3).alias("x"), (k / 5.0 - 10.1).alias("y"), (F.col("event_id") % 17 - F.lit(8.2)).alias("z"), (k % 4).alias("code"))


def event_binned(spark: SparkSession, d: str) -> DataFrame:
    return grids.with_bins(event_positions(spark, d), SPEC)


CELLS = "i_r, i_lat, i_lt"
KEYS = ["i_r", "i_lat", "i_lt"]
DW = f"(SELECT {CELLS}, CAST(count(*) AS DOUBLE) AS minutes FROM {B} WHERE in_range GROUP BY {CELLS})"


@query("agg_dwell3d", f"SELECT * FROM {DW}")
def agg_dwell3d(spark: SparkSession, d: str) -> DataFrame:
    return grids.dwell(binned(spark, d), KEYS)


_REG = ", ".join(f"CAST(count(*) FILTER (WHERE code = {k}) AS DOUBLE) AS region_{k}" for k in grids.KNOWN)


@query("agg_dwell_region", f"SELECT {CELLS}, CAST(count(*) AS DOUBLE) AS total, {_REG} FROM {B} WHERE in_range GROUP BY {CELLS}")
def agg_dwell_region(spark: SparkSession, d: str) -> DataFrame:
    return grids.dwell_regions(binned(spark, d), KEYS)


_SH = "(sqrt(x*x + y*y + (z - 0.037)*(z - 0.037)) / pow(cos(radians(lat)), 2))"
_INV = f"(CASE WHEN {_SH} >= 1 THEN (CASE WHEN z - 0.037 < 0 THEN -1 ELSE 1 END) * degrees(acos(least(1.0, 1 / sqrt({_SH})))) END)"


@query("agg_dwell_invlat", f"SELECT CAST(floor(({_INV} + 90) / 10) AS INTEGER) AS i_inv, i_lt, CAST(count(*) AS DOUBLE) AS total, {_REG} FROM {B} WHERE {_INV} >= -90 AND {_INV} < 90 AND lt >= 0 AND lt < 24 GROUP BY 1, 2")
def agg_dwell_invlat(spark: SparkSession, d: str) -> DataFrame:
    b = binned(spark, d).withColumn("inv", coords.invariant_latitude(F.col("x"), F.col("y"), F.col("z")))
    b = b.withColumn("in_range", (F.col("inv") >= -90) & (F.col("inv") < 90) & (F.col("lt") < 24)).withColumn("i_inv", value_to_bin(F.col("inv"), -90.0, 90.0, 18))
    return grids.dwell_regions(b, ["i_inv", "i_lt"])


@query("agg_dwell_weak", f"SELECT {CELLS}, CAST(count(*) AS DOUBLE) AS total, {_REG} FROM {B} WHERE in_range AND disc * 40 < 2 GROUP BY {CELLS}")
def agg_dwell_weak(spark: SparkSession, d: str) -> DataFrame:
    return grids.dwell_regions(binned(spark, d).filter(F.col("disc") * 40 < 2), KEYS)


@query("agg_dwell_eqr", f"SELECT CAST(floor({_SH} / 40 * 20) AS INTEGER) AS i_l, i_lt, CAST(count(*) AS DOUBLE) AS minutes FROM {B} WHERE {_SH} >= 0 AND {_SH} < 40 AND lt >= 0 AND lt < 24 AND code < 3 GROUP BY 1, 2")
def agg_dwell_eqr(spark: SparkSession, d: str) -> DataFrame:
    zo = F.col("z") - coords.DIPOLE_OFFSET_Z
    l_eq = coords.shell(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + zo * zo), F.col("lat"))
    return grids.closed_field_r(binned(spark, d), l_eq, F.col("code") < 3, True, SPEC)


_FOOTLAT = "(CASE WHEN z >= 0 THEN abs(y) * 6.1 ELSE -abs(x) * 3.3 END)"
_REG60 = ", ".join(f"CAST(count(*) FILTER (WHERE code = {k}) AS DOUBLE) * 60 AS region_{k}" for k in grids.KNOWN)


@query("agg_dwell_traced", f"SELECT CAST(floor(({_FOOTLAT} + 90) / 10) AS INTEGER) AS i_inv, i_lt, CAST(count(*) AS DOUBLE) * 60 AS total, {_REG60} FROM {B} WHERE {_FOOTLAT} >= -90 AND {_FOOTLAT} < 90 AND lt >= 0 AND lt < 24 AND disc < 0.08 GROUP BY 1, 2")
def agg_dwell_traced(spark: SparkSession, d: str) -> DataFrame:
    b = binned(spark, d).withColumns({"lat_north": F.abs("y") * 6.1, "lat_south": -F.abs("x") * 3.3, "closed": F.col("disc") < 0.08})
    return grids.dwell_traced(b, SPEC, closed_only=True)


@query("agg_bincache", f"""SELECT 'polar' AS schema, i_r AS i, i_lt AS j, CAST(count(*) AS DOUBLE) AS minutes FROM {B} WHERE in_range GROUP BY ALL
UNION ALL SELECT 'meridian', i_r, i_lat, CAST(count(*) AS DOUBLE) FROM {B} WHERE in_range GROUP BY ALL
UNION ALL SELECT 'weak', i_lat, i_lt, CAST(count(*) AS DOUBLE) FROM {B} WHERE in_range AND disc * 40 < 2 GROUP BY ALL""")
def agg_bincache(spark: SparkSession, d: str) -> DataFrame:
    ok, c = F.col("in_range"), F.col
    return grids.schemas(binned(spark, d), {"polar": (ok, c("i_r"), c("i_lt")), "meridian": (ok, c("i_r"), c("i_lat")), "weak": (ok & (c("disc") * 40 < 2), c("i_lat"), c("i_lt"))})


@query("agg_dwell_driver", f"""WITH g AS (SELECT CAST(year(make_timestamp(CAST(t AS BIGINT) * 1000000)) AS INTEGER) AS year, code, count(*) AS n FROM {B} WHERE in_range GROUP BY ALL)
SELECT year, code, n, round(100.0 * n / sum(n) OVER (PARTITION BY year), 6) AS percent, CAST(date_diff('hour', make_date(year, 1, 1), make_date(year + 1, 1, 1)) AS INTEGER) AS expected_hours FROM g""")
def agg_dwell_driver(spark: SparkSession, d: str) -> DataFrame:
    """All years in one job, with each region's share of its year and the hours the year has."""
    from pyspark.sql import Window

    b = binned(spark, d).filter("in_range").withColumn("year", F.year(F.timestamp_seconds(F.col("t").cast("long"))))
    g = b.groupBy("year", "code").agg(F.count(F.lit(1)).alias("n"))
    day = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    g = g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))
    return g.withColumn("expected_hours", F.date_diff(day(F.col("year") + 1), day(F.col("year"))) * 24)


_HITS = f"(SELECT DISTINCT s.event_id, c.band FROM {EV} s JOIN {CAT} c ON s.user_id = c.segment_idx AND s.t >= c.t0 AND s.t <= c.t1 WHERE c.band IS NOT NULL)"


BANDS = ["QP15", "QP30", "QP60", "QP120"]
#: What a segment owns of its samples, in seconds: all but two days at its start and what lies beyond 29 days.
LEAD, LENGTH = 2 * 86400.0, 27 * 86400.0
OWNED = f"(SELECT e.* FROM {EVP} e JOIN (SELECT user_id, min(t) AS a FROM {EVP} GROUP BY 1) g USING (user_id) WHERE t >= a + {LEAD} AND t < a + {LEAD + LENGTH})"


def band_spans(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).filter("band IS NOT NULL").select(F.col("segment_idx").alias("user_id"), "t0", "t1", "band")


def band_bit() -> Column:
    """The band's bit in a mask."""
    return F.call_function("shiftleft", F.lit(1), F.array_position(F.array(*[F.lit(b) for b in BANDS]), F.col("band")).cast("int") - 1)


def owned_samples(spark: SparkSession, d: str) -> DataFrame:
    return grids.owned(event_positions(spark, d), "t", ["user_id"], LEAD, LENGTH)


def event_grid(spark: SparkSession, d: str) -> DataFrame:
    met = joins.interval_masks(owned_samples(spark, d), band_spans(spark, d), "t", "t0", "t1", ["event_id"], band_bit(), ["user_id"])
    b = grids.with_bins(met, SPEC).withColumn("inv", coords.invariant_latitude(F.col("x"), F.col("y"), F.col("z")))
    lt, inv = (F.col("lt") >= 0) & (F.col("lt") < 24), (F.col("inv") >= -90) & (F.col("inv") < 90)
    flat = [value_to_bin(F.col("inv"), -90.0, 90.0, 18), F.col("i_lt")]
    named = {"position": (F.col("in_range"), [F.col("i_r"), F.col("i_lat"), F.col("i_lt")]), "inv_lat": (inv & lt, flat), "weak_field": (inv & lt & (F.col("k") / 25 < 2), flat)}
    return grids.event_grids(b, BANDS, named)


@query("agg_trace_loss", f"SELECT code, count(*) AS n, round(100.0 * (1 - count(*) FILTER (WHERE disc < 0.08) / count(*)), 6) AS loss FROM {B} WHERE in_range GROUP BY 1")
def agg_trace_loss(spark: SparkSession, d: str) -> DataFrame:
    """Share of each region's mapped time whose line isn't closed and so is missing from the traced grid."""
    b = binned(spark, d).filter("in_range").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("disc") < 0.08).alias("closed"))
    return b.select("code", "n", r6(100.0 * (1 - F.col("closed") / F.col("n")), "loss"))


_OWN_HITS = f"(SELECT DISTINCT s.event_id, c.band FROM {OWNED} s JOIN {CAT} c ON s.user_id = c.segment_idx AND s.t >= c.t0 AND s.t <= c.t1 WHERE c.band IS NOT NULL)"
_MINUTES = f"(SELECT h.band, b.* FROM (SELECT * FROM {_OWN_HITS} UNION ALL SELECT DISTINCT event_id, 'total' FROM {_OWN_HITS}) h JOIN {BE} b USING (event_id))"
_FLAT = f"CAST(floor(({_INV} + 90) / 10) AS INTEGER) AS i, i_lt AS j, -1 AS k, CAST(count(*) AS DOUBLE) AS total, {_REG}"


@query("agg_event_grid", f"""WITH m AS {_MINUTES} SELECT 'position' AS schema, band, i_r AS i, i_lat AS j, i_lt AS k, CAST(count(*) AS DOUBLE) AS total, {_REG} FROM m WHERE in_range GROUP BY band, i_r, i_lat, i_lt
UNION ALL SELECT 'inv_lat', band, {_FLAT} FROM m WHERE {_INV} >= -90 AND {_INV} < 90 AND lt >= 0 AND lt < 24 GROUP BY band, 3, 4
UNION ALL SELECT 'weak_field', band, {_FLAT} FROM m WHERE {_INV} >= -90 AND {_INV} < 90 AND lt >= 0 AND lt < 24 AND m.k / 25.0 < 2 GROUP BY band, 3, 4""")
def agg_event_grid(spark: SparkSession, d: str) -> DataFrame:
    """Owned minutes within events of each band and of any, on three schemas, in total and by region; k is -1 where a schema has two bins."""
    return event_grid(spark, d).withColumn("k", F.coalesce("k", F.lit(-1)))


@query("agg_event_grid_mission", f"SELECT band, i_r, i_lt, CAST(count(*) AS DOUBLE) AS minutes FROM {_HITS} h JOIN {BE} b USING (event_id) WHERE in_range GROUP BY ALL")
def agg_event_grid_mission(spark: SparkSession, d: str) -> DataFrame:
    from packetloom.plans.q_joins import join_interval_event

    return grids.dwell(event_binned(spark, d).join(join_interval_event(spark, d), "event_id"), ["band", "i_r", "i_lt"])


def _stored_trace(x: DataFrame) -> DataFrame:
    """Footpoints, crossing and whether the line is closed, by rules that SQL can follow, in place of a tracer."""
    return x.withColumns({"lat_north": F.abs("y") * 6.1, "lat_south": -F.abs("x") * 3.3, "l_eq": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) * 1.1, "closed": F.col("k") % 5 != 0})


def traced_grid(spark: SparkSession, d: str) -> DataFrame:
    x = event_positions(spark, d).withColumn("lt", coords.local_time(F.col("x"), F.col("y")))
    return grids.event_grids_traced(x, band_spans(spark, d), "t", "t0", "t1", ["event_id"], band_bit(), BANDS, _stored_trace, SPEC, ["user_id"])


_EQ = "(sqrt(x*x + y*y) * 1.1)"
_TR = lambda name, i, ok: f"SELECT '{name}' AS schema, band, CAST(floor({i}) AS INTEGER) AS i, i_lt AS j, CAST(count(*) AS DOUBLE) AS total, {_REG} FROM m WHERE lt >= 0 AND lt < 24 AND {ok} GROUP BY band, 3, 4"
_ON_FOOT, _ON_EQ = f"{_FOOTLAT} >= -90 AND {_FOOTLAT} < 90", f"{_EQ} >= 0 AND {_EQ} < 40"


@query("agg_event_grid_traced", f"""WITH m AS (SELECT h.band, b.* FROM (SELECT * FROM {_HITS} UNION ALL SELECT DISTINCT event_id, 'total' FROM {_HITS}) h JOIN {BE} b USING (event_id))
{_TR('inv_lat', f'({_FOOTLAT} + 90) / 10', _ON_FOOT)} UNION ALL {_TR('inv_lat_closed', f'({_FOOTLAT} + 90) / 10', _ON_FOOT + ' AND m.k % 5 <> 0')}
UNION ALL {_TR('eq_r', f'{_EQ} / 2', _ON_EQ)} UNION ALL {_TR('eq_r_closed', f'{_EQ} / 2', _ON_EQ + ' AND m.k % 5 <> 0')}""")
def agg_event_grid_traced(spark: SparkSession, d: str) -> DataFrame:
    """Footpoint latitude and equatorial crossing of the lines within events, all and closed ones."""
    return traced_grid(spark, d).drop("k")


@query("agg_walk_bins", f"""WITH w AS (SELECT c.event_id AS ev, b.i_r, b.i_lt, 1.0::DOUBLE AS m FROM {CAT} c JOIN {BE} b ON b.user_id = c.segment_idx AND b.t >= c.t0 AND b.t <= c.t1 WHERE c.k % 10 <> 0 AND in_range),
f AS (SELECT c.event_id AS ev, b.i_r, b.i_lt, (c.t1 - c.t0) / 60 AS m FROM {CAT} c JOIN {BE} b ON b.event_id = c.event_id WHERE c.k % 10 = 0 AND in_range)
SELECT i_r, i_lt, round(sum(m), 4) AS minutes, count(DISTINCT ev) AS n_events FROM (SELECT * FROM w UNION ALL SELECT * FROM f) GROUP BY ALL""")
def agg_walk_bins(spark: SparkSession, d: str) -> DataFrame:
    """Events walked along their segment's samples; those without a segment stand in their peak's bin with their duration."""
    b, c = event_binned(spark, d).filter("in_range"), cat(spark, d)
    spans = c.filter("k % 10 <> 0").select(F.col("event_id").alias("ev"), F.col("segment_idx").alias("user_id"), "t0", "t1")
    walked = joins.in_intervals(b.select("user_id", "t", "i_r", "i_lt"), spans, "t", "t0", "t1", ["user_id"]).select("ev", "i_r", "i_lt", F.lit(1.0).alias("m"))
    fallback = c.filter("k % 10 = 0").join(b.select("event_id", "i_r", "i_lt"), "event_id").select(F.col("event_id").alias("ev"), "i_r", "i_lt", ((F.col("t1") - F.col("t0")) / 60).alias("m"))
    return walked.union(fallback).groupBy("i_r", "i_lt").agg(F.round(F.sum("m"), 4).alias("minutes"), F.countDistinct("ev").alias("n_events"))


_ISL = f"""(SELECT segment_idx, island, min(t0) AS lo, max(t1) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY segment_idx ORDER BY t0, t1) AS island FROM (SELECT *,
  CASE WHEN t0 > max(t1) OVER (PARTITION BY segment_idx ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY segment_idx ORDER BY t0, t1) = 1 THEN 1 ELSE 0 END AS new FROM {CAT})) GROUP BY 1, 2)"""


@query("agg_coverage", f"SELECT segment_idx, count(*) AS n, round(sum(hi - lo), 3) AS covered FROM {_ISL} GROUP BY 1")
def agg_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = grids.coverage(cat(spark, d).select("segment_idx", "t0", "t1"), "t0", "t1", ["segment_idx"])
    return c.groupBy("segment_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("t1") - F.col("t0")), 3).alias("covered"))


_FOOT = f"(SELECT c.event_id AS ev, 'polar' AS grid, b.i_r * 24 + b.i_lt AS bin, CAST(count(*) AS DOUBLE) AS minutes FROM {CAT} c JOIN {BE} b ON b.user_id = c.segment_idx AND b.t >= c.t0 AND b.t <= c.t1 WHERE in_range GROUP BY ALL)"


def footprint(spark: SparkSession, d: str) -> DataFrame:
    """Minutes of each event in each bin it passes: overlapping events count each for itself."""
    b = event_binned(spark, d).filter("in_range").select("user_id", "t", (F.col("i_r") * 24 + F.col("i_lt")).alias("bin"))
    spans = cat(spark, d).select(F.col("event_id").alias("ev"), F.col("segment_idx").alias("user_id"), "t0", "t1")
    j = joins.in_intervals(b, spans, "t", "t0", "t1", ["user_id"])
    return j.groupBy("ev", F.lit("polar").alias("grid"), "bin").agg(F.count(F.lit(1)).cast("double").alias("minutes"))


query("agg_footprint", f"SELECT * FROM {_FOOT}")(footprint)


@query("agg_footprint_total", f"SELECT bin, sum(minutes) AS minutes FROM {_FOOT} WHERE ev IN (SELECT event_id FROM {CAT} WHERE q_factor > 5) GROUP BY bin")
def agg_footprint_total(spark: SparkSession, d: str) -> DataFrame:
    chosen = apply_filter(cat(spark, d), "q_factor > 5").select(F.col("event_id").alias("ev"))
    return footprint(spark, d).join(chosen, "ev", "left_semi").groupBy("bin").agg(F.sum("minutes").alias("minutes"))


_RG = f"(SELECT i_r, i_lt, CAST(count(*) AS DOUBLE) AS m FROM {B} WHERE in_range GROUP BY ALL)"
_EG = f"(SELECT i_r, i_lt, CAST(count(*) AS DOUBLE) AS m FROM {B} WHERE in_range AND code = 1 GROUP BY ALL)"
_RATE = f"(SELECT d.i_r, d.i_lt, CASE WHEN d.m >= 60 THEN least(greatest(coalesce(e.m, 0) / d.m, 0), 1) END AS rate FROM {_RG} d LEFT JOIN {_EG} e ON d.i_r = e.i_r AND d.i_lt = e.i_lt)"


def polar_rate(spark: SparkSession, d: str) -> DataFrame:
    b = binned(spark, d)
    return grids.rate(grids.dwell(b.filter("code = 1"), ["i_r", "i_lt"]), grids.dwell(b, ["i_r", "i_lt"]), ["i_r", "i_lt"], 60.0)


@query("agg_rate", f"SELECT i_r, i_lt, round(rate, 6) AS rate FROM {_RATE}")
def agg_rate(spark: SparkSession, d: str) -> DataFrame:
    return polar_rate(spark, d).select("i_r", "i_lt", r6(F.col("rate"), "rate"))


@query("agg_filtered_map", f"""WITH f AS (SELECT bin, sum(minutes) AS m FROM {_FOOT} WHERE ev IN (SELECT event_id FROM {CAT} WHERE q_factor > 2) GROUP BY bin),
dd AS (SELECT i_r * 24 + i_lt AS bin, CAST(count(*) AS DOUBLE) AS m FROM {BE} WHERE in_range GROUP BY ALL)
SELECT dd.bin, CASE WHEN dd.m >= 20 THEN round(coalesce(f.m, 0) / dd.m, 6) END AS rate FROM dd LEFT JOIN f USING (bin)""")
def agg_filtered_map(spark: SparkSession, d: str) -> DataFrame:
    """A user's predicate on events, their footprints' total, and its ratio to the dwell time."""
    chosen = apply_filter(cat(spark, d), "q_factor > 2").select(F.col("event_id").alias("ev"))
    e = footprint(spark, d).join(chosen, "ev", "left_semi").groupBy("bin").agg(F.sum("minutes").alias("minutes"))
    b = event_binned(spark, d).filter("in_range").groupBy((F.col("i_r") * 24 + F.col("i_lt")).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("minutes"))
    return grids.rate(e, b, ["bin"], 20.0, clip=False).select("bin", r6(F.col("rate"), "rate"))


@query("agg_lt_sector", f"SELECT i_r, i_lat, sum(minutes) AS minutes FROM {DW} WHERE i_lt + 0.5 >= 22 OR i_lt + 0.5 < 2 GROUP BY 1, 2")
def agg_lt_sector(spark: SparkSession, d: str) -> DataFrame:
    return grids.lt_sector(grids.dwell(binned(spark, d), KEYS), 0.0, 2.0, SPEC, ["i_r", "i_lat"])


@query("agg_lat_profile", f"SELECT CAST(floor((i_lat + 0.5) * 10 / 30) AS INTEGER) AS i_lat5, sum(minutes) AS minutes FROM {DW} GROUP BY 1")
def agg_lat_profile(spark: SparkSession, d: str) -> DataFrame:
    return grids.lat_profile(grids.dwell(binned(spark, d), KEYS), SPEC, 30.0)


_SEC = "(i_lt + 0.5 >= 9 AND i_lt + 0.5 < 15)"


@query("agg_sector_ratio", f"""WITH a AS (SELECT i_lat, sum(minutes) AS m FROM {DW} WHERE {_SEC} GROUP BY 1), e AS (SELECT i_lat, CAST(count(*) AS DOUBLE) AS m FROM {B} WHERE in_range AND code = 1 AND {_SEC} GROUP BY 1)
SELECT a.i_lat, CASE WHEN a.m >= 100 THEN round(least(coalesce(e.m, 0) / a.m, 1), 6) END AS rate FROM a LEFT JOIN e USING (i_lat)""")
def agg_sector_ratio(spark: SparkSession, d: str) -> DataFrame:
    b = binned(spark, d)
    part = lambda x: grids.lt_sector(grids.dwell(x, ["i_lat", "i_lt"]), 12.0, 3.0, SPEC, ["i_lat"])
    return grids.rate(part(b.filter("code = 1")), part(b), ["i_lat"], 100.0).select("i_lat", r6(F.col("rate"), "rate"))


@query("agg_eq_slice", f"SELECT i_r, i_lt, sum(minutes) AS minutes FROM {DW} WHERE abs(i_lat * 10 + 5 - 90) < 15 GROUP BY 1, 2")
def agg_eq_slice(spark: SparkSession, d: str) -> DataFrame:
    g = grids.dwell(binned(spark, d), KEYS).filter(F.abs(F.col("i_lat") * 10 + 5 - 90) < 15)
    return g.groupBy("i_r", "i_lt").agg(F.sum("minutes").alias("minutes"))


@query("agg_meridian", f"SELECT i_r, i_lat, sum(minutes) AS minutes FROM {DW} WHERE i_lt + 0.5 >= 22.5 OR i_lt + 0.5 <= 1.5 GROUP BY 1, 2")
def agg_meridian(spark: SparkSession, d: str) -> DataFrame:
    """A wedge about midnight, both ends inclusive."""
    mid = F.col("i_lt") + 0.5
    return grids.dwell(binned(spark, d), KEYS).filter((mid >= 22.5) | (mid <= 1.5)).groupBy("i_r", "i_lat").agg(F.sum("minutes").alias("minutes"))


_LS = "((i_r * 2 + 1) / pow(greatest(abs(cos(radians(i_lat * 10 - 85.0))), 0.001), 2))"


@query("agg_lshell_regrid", f"SELECT CAST(floor({_LS} / 80 * 40) AS INTEGER) AS i_l, sum(minutes) AS minutes FROM {DW} WHERE {_LS} < 80 GROUP BY 1")
def agg_lshell_regrid(spark: SparkSession, d: str) -> DataFrame:
    cosine = F.greatest(F.abs(F.cos(F.radians(F.col("i_lat") * 10 - F.lit(85.0)))), F.lit(1e-3))
    g = grids.dwell(binned(spark, d), KEYS).withColumn("l", (F.col("i_r") * 2 + 1) / F.pow(cosine, F.lit(2.0))).filter("l < 80")
    return g.groupBy(F.floor(F.col("l") / 80 * 40).cast("int").alias("i_l")).agg(F.sum("minutes").alias("minutes"))


@query("agg_meridional", f"SELECT i_r, i_lat, sum(minutes) AS minutes FROM {DW} GROUP BY 1, 2")
def agg_meridional(spark: SparkSession, d: str) -> DataFrame:
    return grids.dwell(binned(spark, d), KEYS).groupBy("i_r", "i_lat").agg(F.sum("minutes").alias("minutes"))


@query("agg_weak_maglat", f"SELECT i_lat, i_lt, count(*) AS n FROM {B} WHERE code = 0 AND disc * 40 > 0 AND disc * 40 < 2 AND lat >= -90 AND lat < 90 AND lt < 24 GROUP BY 1, 2")
def agg_weak_maglat(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("disc") * 40
    return binned(spark, d).filter((F.col("code") == 0) & (b > 0) & (b < 2) & (F.col("lat") < 90) & (F.col("lt") < 24)).groupBy("i_lat", "i_lt").agg(F.count(F.lit(1)).alias("n"))


@query("agg_coarsen", f"SELECT i_lt // 4 AS i_lt, i_r, CASE WHEN sum(minutes) >= 180 THEN sum(minutes) END AS minutes FROM {DW} GROUP BY 1, 2")
def agg_coarsen(spark: SparkSession, d: str) -> DataFrame:
    g = grids.coarsen(grids.dwell(binned(spark, d), KEYS), "i_lt", 24, 6, ["i_r"])
    return g.withColumn("minutes", F.when(F.col("minutes") >= 180, F.col("minutes")))


@query("agg_sheet_frac", f"""SELECT i_r, i_lt, CASE WHEN count(*) > 60 THEN round(least(greatest(CAST(count(*) FILTER (WHERE disc * 40 < 2) AS DOUBLE) / count(*), 0), 1), 6) END AS frac FROM {B} WHERE in_range GROUP BY 1, 2""")
def agg_sheet_frac(spark: SparkSession, d: str) -> DataFrame:
    g = binned(spark, d).filter("in_range").groupBy("i_r", "i_lt").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("disc") * 40 < 2).alias("w"))
    return g.select("i_r", "i_lt", F.when(F.col("n") > 60, r6(F.least(F.greatest(F.col("w") / F.col("n"), F.lit(0.0)), F.lit(1.0)), "f")).alias("frac"))


@query("agg_lt_fieldline", f"SELECT i_lat, count(*) AS n FROM {B} WHERE {_INV} >= 60 AND {_INV} < 80 AND (lt >= 21 OR lt < 3) GROUP BY 1")
def agg_lt_fieldline(spark: SparkSession, d: str) -> DataFrame:
    """Dwell against magnetic latitude along field lines of an invariant latitude and a sector."""
    inv = coords.invariant_latitude(F.col("x"), F.col("y"), F.col("z"))
    b = binned(spark, d).filter((inv >= 60) & (inv < 80) & in_lt_range(F.col("lt"), 0.0, 3.0))
    return b.groupBy("i_lat").agg(F.count(F.lit(1)).alias("n"))


@query("agg_poisson_band")
def agg_poisson_band(spark: SparkSession, d: str) -> DataFrame:
    """16 and 84 % bounds of each latitude's rate over 500 Poisson resamples of its events."""
    b = binned(spark, d).filter("in_range")
    g = b.groupBy("i_lat").agg(F.count(F.lit(1)).alias("dwell"), F.count_if(F.col("code") == 1).alias("events"))

    @F.pandas_udf("double")
    def draw(key: pd.Series, mean: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([float(np.random.Generator(np.random.PCG64(int(k))).poisson(m)) for k, m in zip(key, mean, strict=True)])

    r = g.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(500))))
    r = r.withColumn("rate", draw(F.col("i_lat") * 1000 + F.col("draw"), F.col("events").cast("double")) / F.col("dwell"))
    return r.groupBy("i_lat").agg(F.percentile("rate", 0.16).alias("lo"), F.percentile("rate", 0.84).alias("hi"))


@query("win_smooth2d", f"""WITH k AS (SELECT o, exp(-0.5 * (o / 1.5) * (o / 1.5)) AS w FROM range(-6, 7) r(o)), r AS (SELECT * FROM {_RATE}),
g AS (SELECT a.i AS i, b.j AS j, coalesce(r.rate, 0) AS v, CASE WHEN r.rate IS NULL THEN 0.0 ELSE 1.0 END AS u FROM range(0, 20) a(i) CROSS JOIN range(0, 24) b(j) LEFT JOIN r ON r.i_r = a.i AND r.i_lt = b.j),
p AS (SELECT t.i AS i, g.j, sum(g.v * w) AS v, sum(g.u * w) AS u FROM range(0, 20) t(i) CROSS JOIN k JOIN g ON g.i = CASE WHEN ((t.i + o) % 40 + 40) % 40 < 20 THEN ((t.i + o) % 40 + 40) % 40 ELSE 39 - ((t.i + o) % 40 + 40) % 40 END GROUP BY 1, 2),
q AS (SELECT p.i, t.j AS j, sum(p.v * w) AS v, sum(p.u * w) AS u FROM range(0, 24) t(j) CROSS JOIN k JOIN p ON p.j = ((t.j + o) % 24 + 24) % 24 GROUP BY 1, 2)
SELECT CAST(i AS INTEGER) AS i_r, CAST(j AS INTEGER) AS i_lt, CASE WHEN u > 1e-12 THEN round(v / u, 6) END AS rate FROM q""")
def win_smooth2d(spark: SparkSession, d: str) -> DataFrame:
    full = spark.range(480).select(F.floor(F.col("id") / 24).cast("int").alias("i_r"), (F.col("id") % 24).cast("int").alias("i_lt"))
    g = full.join(polar_rate(spark, d), ["i_r", "i_lt"], "left")
    return grids.smooth(g, "i_r", "i_lt", "rate", 1.5, 20, 24).select("i_r", "i_lt", r6(F.col("rate"), "rate"))

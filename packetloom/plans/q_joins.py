"""Queries of the join patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import joins
from packetloom.plans.registry import CAT, CROSS, EV, cat, crossings, ev, query, r6

_SAMPLES = f"(SELECT event_id, t FROM {EV} WHERE event_type <> 'error')"


def samples(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).filter("event_type <> 'error'").select("event_id", "t")


@query("join_asof_region", f"SELECT s.event_id, CAST(coalesce(c.code, 9) AS INTEGER) AS region FROM {_SAMPLES} s ASOF LEFT JOIN {CROSS} c ON s.t > c.ct")
def join_asof_region(spark: SparkSession, d: str) -> DataFrame:
    out = joins.asof_backward(samples(spark, d), crossings(spark, d).drop("cid"), "t", "ct")
    return out.select("event_id", F.coalesce("code", F.lit(9)).cast("int").alias("region"))


@query("join_asof_forward", f"""SELECT s.event_id, coalesce(c.cid, (SELECT arg_max(cid, ct) FROM {CROSS})) AS cid FROM {_SAMPLES} s ASOF LEFT JOIN {CROSS} c ON s.t <= c.ct""")
def join_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return joins.asof_forward(samples(spark, d), crossings(spark, d).drop("code"), "t", "ct").select("event_id", "cid")


_HOURS = """(SELECT CAST(1704067200 + slot * 3600 AS DOUBLE) AS ht, slot FROM range(1, 721) r(slot))"""


@query("join_crossing_fill", f"""SELECT round(ht, 3) AS t, CAST(coalesce(c.code, 9) AS INTEGER) AS code FROM {_HOURS} h ASOF LEFT JOIN {CROSS} c ON h.ht >= c.ct""")
def join_crossing_fill(spark: SparkSession, d: str) -> DataFrame:
    c = crossings(spark, d).withColumn("label", F.lit(None).cast("string")).withColumnRenamed("ct", "t")
    return joins.crossing_fill(c, 1704067200.0, 1704067200.0 + 719 * 3600.0 + 3599, 3600.0).select(F.round("t", 3).alias("t"), "code")


@query("join_nearest", f"""SELECT s.event_id, CASE WHEN b.ct IS NULL OR a.ct - s.t < s.t - b.ct THEN a.cid ELSE b.cid END AS cid,
  CASE WHEN b.ct IS NULL OR a.ct - s.t < s.t - b.ct THEN a.ct - s.t ELSE s.t - b.ct END > 300 AS gap
FROM {_SAMPLES} s ASOF LEFT JOIN {CROSS} b ON s.t >= b.ct ASOF LEFT JOIN {CROSS} a ON s.t <= a.ct""")
def join_nearest(spark: SparkSession, d: str) -> DataFrame:
    out = joins.nearest(samples(spark, d), crossings(spark, d).drop("code"), "t", "ct")
    return out.select("event_id", "cid", (F.abs(F.col("ct") - F.col("t")) > 300).alias("gap"))


@query("join_region_nearest", f"""SELECT s.event_id, coalesce(arg_min(f.code, (abs(f.t - s.t), f.event_id)), 9) AS code
FROM (SELECT event_id, user_id, t FROM {EV} WHERE event_type = 'purchase') s LEFT JOIN (SELECT event_id, user_id, t, k % 4 AS code FROM {EV} WHERE event_type = 'error') f USING (user_id) GROUP BY s.event_id""")
def join_region_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Code of the nearest flag of the event's own segment; the first of two as near."""
    e = ev(spark, d)
    s = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    f = e.filter("event_type = 'error'").groupBy("user_id", F.col("t").alias("ft")).agg(F.min_by("k", "event_id").alias("k"), F.min("event_id").alias("fid"))
    out = joins.neighbours(s, f, "t", "ft", ["user_id"], after=True)
    at = F.col("l.t")
    gap = lambda n: F.abs(F.col(f"{n}.ft") - at)
    closer = F.col("after").isNull() | (gap("before") < gap("after")) | ((gap("before") == gap("after")) & (F.col("before.fid") < F.col("after.fid")))
    code = F.when(closer, F.col("before.k")).otherwise(F.col("after.k")) % 4
    return out.select("l.event_id", F.coalesce(code, F.lit(9)).alias("code"))


_PHASES = {"n": "value", "s": "(k * 7.5) % 360", "nd": "event_id % 360", "sd": "(k * 3) % 360"}


@query("join_phase_index", f"""WITH p AS (SELECT user_id, {', '.join(f'list(CAST({e} AS DOUBLE) ORDER BY t, event_id) AS a_{n}' for n, e in _PHASES.items())}, min(t) AS t0 FROM {EV} WHERE event_type = 'view' GROUP BY user_id),
x AS (SELECT e.event_id, p.*, CAST(least(greatest(round_even((t - t0) / 36000.0, 0), 0), len(a_n) - 1) AS INTEGER) + 1 AS ix FROM {EV} e JOIN p USING (user_id) WHERE event_type = 'click')
SELECT event_id, {', '.join(f'round(a_{n}[ix], 6) AS phase_{n}' for n in _PHASES)} FROM x""")
def join_phase_index(spark: SparkSession, d: str) -> DataFrame:
    """Values of the segment's four series at the elapsed time over the cadence, rounded half to even and clamped."""
    e, c = ev(spark, d), F.col
    made = {"n": c("value"), "s": F.pmod(c("k") * F.lit(7.5), F.lit(360.0)), "nd": (c("event_id") % 360).cast("double"), "sd": ((c("k") * 3) % 360).cast("double")}
    rows = e.filter("event_type = 'view'").select("user_id", "t", "event_id", *[v.alias(n) for n, v in made.items()])
    got = joins.at_index(e.filter("event_type = 'click'").select("event_id", "user_id", "t"), rows, "t", ["user_id"], ["t", "event_id"], list(made), 36000.0)
    return got.select("event_id", *[r6(c(n), f"phase_{n}") for n in made])


_AT = {"r": "max(value)", "lat": "degrees(min(value) / 200)", "lt": "(degrees(max(k) / 20.0) / 15 + 12) % 24", "phase_n": "max(k * 7.5 % 360)", "phase_s": "min(k * 3.5 % 360)", "phase_nd": "max(event_id % 360)", "phase_sd": "min(event_id % 180)"}


@query("join_peak_enrich", f"""WITH s AS (SELECT user_id, CAST(floor(t / 3600) AS BIGINT) AS slot, min(k) AS code, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _AT.items())} FROM {EV} GROUP BY 1, 2)
SELECT c.event_id, {', '.join(f'round(s.{n}, 6) AS {n}' for n in _AT)}, s.code % 4 AS region FROM {CAT} c JOIN s ON c.segment_idx = s.user_id AND s.slot = CAST(floor((c.t0 + c.t1) / 2 / 3600) AS BIGINT)""")
def join_peak_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Distance, latitude, local time, region and four phases of the sample at each event's peak, its time rounded to the samples' step."""
    c, turn = F.col, lambda v: F.pmod(v.cast("double"), F.lit(360.0))
    at = {
        "r": F.max("value"), "lat": F.degrees(F.min("value") / 200), "lt": F.pmod(F.degrees(F.max("k") / 20.0) / 15 + 12, F.lit(24.0)), "phase_n": F.max(turn(c("k") * 7.5)), "phase_s": F.min(turn(c("k") * 3.5)),
        "phase_nd": F.max((c("event_id") % 360).cast("double")), "phase_sd": F.min((c("event_id") % 180).cast("double")),
    }
    s = ev(spark, d).groupBy("user_id", F.floor(c("t") / 3600).alias("slot")).agg(F.min("k").alias("code"), *[v.alias(n) for n, v in at.items()])
    x = cat(spark, d).withColumn("slot", F.floor((c("t0") + c("t1")) / 2 / 3600))
    j = x.join(s, (x["segment_idx"] == s["user_id"]) & (x["slot"] == s["slot"]))
    return j.select("event_id", *[r6(c(n), n) for n in at], (c("code") % 4).alias("region"))


_HIT = f"SELECT DISTINCT s.event_id, c.band FROM {EV} s JOIN {CAT} c ON s.user_id = c.segment_idx AND s.t >= c.t0 AND s.t <= c.t1 WHERE c.band IS NOT NULL"


@query("join_interval_event", _HIT)
def join_interval_event(spark: SparkSession, d: str) -> DataFrame:
    spans = cat(spark, d).filter("band IS NOT NULL").select(F.col("segment_idx").alias("user_id"), "t0", "t1", "band")
    return joins.in_intervals(ev(spark, d).select("event_id", "user_id", "t"), spans, "t", "t0", "t1", ["user_id"]).select("event_id", "band").distinct()


@query("join_interval_quality", f"SELECT event_id FROM {EV} s WHERE NOT EXISTS (SELECT 1 FROM {CROSS} f WHERE s.t >= f.ct AND s.t <= f.ct + 60)")
def join_interval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Samples that no quality flag covers."""
    flags = crossings(spark, d).select(F.col("ct").alias("lo"), (F.col("ct") + 60).alias("hi"))
    return joins.in_intervals(ev(spark, d).select("event_id", "t"), flags, "t", "lo", "hi", how="left_anti", width=600.0).select("event_id")


@query("join_peers", f"""WITH c AS (SELECT *, k % 9 = 0 AS dup FROM {CAT}),
p AS (SELECT a.event_id, b.event_id AS peer, b.period_min, (least(a.t1, b.t1) - greatest(a.t0, b.t0)) / least(a.t1 - a.t0, b.t1 - b.t0) AS frac FROM c a JOIN c b
  ON a.segment_idx = b.segment_idx AND a.event_id <> b.event_id AND NOT a.dup AND NOT b.dup AND least(a.t1, b.t1) > greatest(a.t0, b.t0) AND a.t1 > a.t0 AND b.t1 > b.t0)
SELECT c.event_id, coalesce(string_agg(CAST(peer AS VARCHAR), ',' ORDER BY peer) FILTER (WHERE frac >= 0.5), '') AS peers,
  coalesce(string_agg(CAST(CAST(round(frac * 1000) AS INTEGER) AS VARCHAR), ',' ORDER BY peer) FILTER (WHERE frac >= 0.5), '') AS fracs FROM c LEFT JOIN p USING (event_id) GROUP BY c.event_id""")
def join_peers(spark: SparkSession, d: str) -> DataFrame:
    out = joins.peers(cat(spark, d).withColumn("is_duplicate", F.col("k") % 9 == 0))
    frac = F.transform("peer_overlap_frac", lambda x: F.round(x * 1000).cast("int").cast("string"))
    return out.select("event_id", F.concat_ws(",", F.transform("peer_event_ids", lambda x: x.cast("string"))).alias("peers"), F.concat_ws(",", frac).alias("fracs"))


_TRUTH = f"(SELECT event_id AS tid, user_id AS ds, t AS a0, t + 7200 AS a1 FROM {EV} WHERE event_type = 'purchase')"
_DET = f"(SELECT event_id AS did, user_id AS ds, t - 1800 AS b0, t + 5400 AS b1 FROM {EV} WHERE event_type = 'view')"


def truth(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return ev(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("tid"), F.col("user_id").alias("ds"), t.alias("a0"), (t + 7200).alias("a1"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return ev(spark, d).filter("event_type = 'view'").select(F.col("event_id").alias("did"), F.col("user_id").alias("ds"), (t - 1800).alias("b0"), (t + 5400).alias("b1"))


@query("join_iou", f"""SELECT tid, did, round(greatest(least(a1, b1) - greatest(a0, b0), 0) / (greatest(a1, b1) - least(a0, b0)), 5) AS iou FROM {_TRUTH} JOIN {_DET} USING (ds) WHERE least(a1, b1) > greatest(a0, b0)""")
def join_iou(spark: SparkSession, d: str) -> DataFrame:
    from packetloom.operators.scoring import iou_pairs

    return iou_pairs(truth(spark, d), detections(spark, d)).select("tid", "did", F.round("iou", 5).alias("iou"))


@query("join_assign")
def join_assign(spark: SparkSession, d: str) -> DataFrame:
    from packetloom.operators.scoring import assign

    return assign(truth(spark, d), detections(spark, d)).select("ds", "tid", "did", F.round("iou", 6).alias("iou"))


_E3 = f"(SELECT CAST(floor(value) AS BIGINT) AS b, k % 5 AS g, count(*) * 1.0::DOUBLE AS m FROM {EV} WHERE event_type = 'click' GROUP BY 1, 2)"
_D3 = f"(SELECT CAST(floor(value) AS BIGINT) AS b, k % 5 AS g, count(*) * 1.0::DOUBLE AS m FROM {EV} GROUP BY 1, 2)"


@query("join_ratio", f"SELECT d.b, d.g, CASE WHEN d.m >= 10 THEN round(least(greatest(coalesce(e.m, 0) / d.m, 0), 1), 6) END AS rate FROM {_D3} d LEFT JOIN {_E3} e ON d.b = e.b AND d.g = e.g")
def join_ratio(spark: SparkSession, d: str) -> DataFrame:
    from packetloom.operators.grids import rate

    e = ev(spark, d).withColumn("b", F.floor("value")).withColumn("g", F.col("k") % 5)
    grid = lambda x: x.groupBy("b", "g").agg(F.count(F.lit(1)).cast("double").alias("minutes"))
    return rate(grid(e.filter("event_type = 'click'")), grid(e), ["b", "g"], 10.0).select("b", "g", r6(F.col("rate"), "rate"))


@query("join_window_slice", f"SELECT p.event_id AS peak, count(*) AS n, round(avg(s.value), 6) AS mean FROM {EV} p JOIN {EV} s ON p.user_id = s.user_id AND s.t >= p.t - 43200 AND s.t <= p.t + 43200 WHERE p.event_type = 'purchase' GROUP BY 1")
def join_window_slice(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an event's segment within twelve hours of its peak."""
    e = ev(spark, d)
    spans = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("peak"), "user_id", (F.col("t") - 43200).alias("lo"), (F.col("t") + 43200).alias("hi"))
    j = joins.in_intervals(e.select("user_id", "t", "value"), spans, "t", "lo", "hi", ["user_id"], width=43200.0)
    return j.groupBy("peak").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"))


@query("join_id_align", f"SELECT coalesce(a.event_id, b.event_id) AS event_id, a.event_id IS NULL AS extra FROM (SELECT event_id FROM {CAT} WHERE band IS NOT NULL) a FULL JOIN (SELECT event_id FROM {CAT} WHERE k > 10) b USING (event_id) WHERE a.event_id IS NULL OR b.event_id IS NULL")
def join_id_align(spark: SparkSession, d: str) -> DataFrame:
    """Ids that only one of two tables has."""
    c = cat(spark, d)
    a, b = c.filter("band IS NOT NULL").select(F.col("event_id").alias("a")), c.filter("k > 10").select(F.col("event_id").alias("b"))
    j = a.join(b, F.col("a") == F.col("b"), "full_outer").filter("a IS NULL OR b IS NULL")
    return j.select(F.coalesce("a", "b").alias("event_id"), F.col("a").isNull().alias("extra"))

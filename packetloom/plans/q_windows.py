"""Queries of the ordered logic, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import coords
from packetloom.operators import greedy, ordered, stats
from packetloom.plans.q_stats import SIG, quads, signal
from packetloom.plans.registry import CAT, EV, cat, crossings, ev, query, r6

c = F.col
RUN = """(sum(v) OVER (PARTITION BY seg ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
  + greatest(0, 3 - i) * first_value(v) OVER (PARTITION BY seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  + greatest(0, 3 - (63 - i)) * last_value(v) OVER (PARTITION BY seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 7"""


@query("win_running_avg", f"SELECT seg, i, round({RUN}, 6) AS m FROM {SIG}")
def win_running_avg(spark: SparkSession, d: str) -> DataFrame:
    return ordered.running_mean(signal(spark, d), "v", 7, ["seg"], ["i"], "m").select("seg", c("i").cast("long").alias("i"), r6(c("m"), "m"))


@query("win_detrend", f"SELECT seg, i, round(v - {RUN}, 6) AS d FROM {SIG}")
def win_detrend(spark: SparkSession, d: str) -> DataFrame:
    return ordered.running_mean(signal(spark, d), "v", 7, ["seg"], ["i"], "m").select("seg", c("i").cast("long").alias("i"), r6(c("v") - c("m"), "d"))


def _mean5(v: str) -> str:
    edge = lambda f: f"{f}({v}) OVER (PARTITION BY seg ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"(sum({v}) OVER (PARTITION BY seg ORDER BY j ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 2 - j) * {edge('first_value')} + greatest(0, j - 18) * {edge('last_value')}) / 5"


_TRIADS = "(SELECT vec_id AS seg, j, CAST(embedding[3*j+1] AS DOUBLE) AS a, CAST(embedding[3*j+2] AS DOUBLE) AS b, CAST(embedding[3*j+3] AS DOUBLE) AS c FROM embeddings, range(0, 21) r(j))"
_MEANS = f"(SELECT seg, j, a, b, c, {', '.join(f'{_mean5(v)} AS m{v}' for v in 'abc')} FROM {_TRIADS})"


@query("win_mfa_perturb", f"""WITH m AS (SELECT *, sqrt(ma*ma + mb*mb + mc*mc) AS mn, sqrt((a+1)*(a+1) + (b+2)*(b+2)) AS h FROM {_MEANS}),
u AS (SELECT seg, j, a - ma AS x, b - mb AS y, c - mc AS z, ma / mn AS p, mb / mn AS q, mc / mn AS s, -(b+2) / h AS f1, (a+1) / h AS f2 FROM m),
k AS (SELECT *, sqrt(pow(f2*s, 2) + pow(f1*s, 2) + pow(f1*q - f2*p, 2)) AS n FROM u), e AS (SELECT *, f2*s/n AS e1, -f1*s/n AS e2, (f1*q - f2*p)/n AS e3 FROM k),
v AS (SELECT seg, j, x*p + y*q + z*s AS par, x*e1 + y*e2 + z*e3 AS perp1, x*(q*e3 - s*e2) + y*(s*e1 - p*e3) + z*(p*e2 - q*e1) AS perp2 FROM e)
SELECT seg, CAST(j AS INTEGER) AS j, round(par, 6) AS par, round(perp1, 6) AS perp1, round(perp2, 6) AS perp2, round(sqrt(par*par + perp1*perp1 + perp2*perp2), 6) AS size FROM v""")
def win_mfa_perturb(spark: SparkSession, d: str) -> DataFrame:
    """Perturbation of each component about its running mean, projected on the mean field's basis."""
    x = quads(spark, d, 3)
    for n in "abc":
        x = ordered.running_mean(x, n, 5, ["seg"], ["j"], f"m{n}")
    pert = tuple(c(n) - c(f"m{n}") for n in "abc")
    v = coords.mfa((c("a") + 1.0, c("b") + 2.0, c("c")), pert, tuple(c(f"m{n}") for n in "abc"))
    return x.select("seg", "j", *[r6(e, n) for e, n in zip(v, ("par", "perp1", "perp2"), strict=True)], r6(F.sqrt(coords.dot(v, v)), "size"))


@query("win_linear_detrend", f"""WITH f AS (SELECT seg, regr_slope(v, i) AS s, regr_intercept(v, i) AS a, count(*) AS n FROM {SIG} GROUP BY 1) SELECT seg, i, round(CASE WHEN n >= 3 THEN v - a - s * i ELSE v END, 6) AS d FROM {SIG} JOIN f USING (seg)""")
def win_linear_detrend(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("seg")
    x = signal(spark, d).withColumn("i", c("i").cast("long"))
    fit = c("v") - F.regr_intercept("v", "i").over(w) - F.regr_slope("v", "i").over(w) * c("i")
    return x.select("seg", "i", r6(F.when(F.count(F.lit(1)).over(w) >= 3, fit).otherwise(c("v")), "d"))


@query("win_region_intervals", f"""SELECT cid, code, round(ct, 3) AS lo, round(coalesce(lead(ct) OVER (ORDER BY ct), 1706745600), 3) AS hi FROM (SELECT t AS ct, k % 4 AS code, event_id AS cid FROM {EV} WHERE event_type = 'error')
QUALIFY coalesce(lead(ct) OVER (ORDER BY ct), 1706745600) > ct""")
def win_region_intervals(spark: SparkSession, d: str) -> DataFrame:
    from packetloom.operators.joins import intervals

    x = intervals(crossings(spark, d), "ct", end=F.lit(1706745600.0)).filter("hi > lo")
    return x.select("cid", "code", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


A, Z = 1704326400.0, 1704585600.0


@query("win_region_spans", f"""WITH x AS (SELECT t AS lo, lead(t, 1, 1706745600.0) OVER (ORDER BY t) AS hi, k % 4 AS code FROM {EV} WHERE event_type = 'error'),
y AS (SELECT greatest(lo, {A}) AS lo, least(hi, {Z}) AS hi, code FROM x WHERE hi > {A} AND lo < {Z})
SELECT round(lo, 3) AS lo, round(hi, 3) AS hi, code FROM y WHERE hi > lo UNION ALL SELECT {A}::DOUBLE, round(min(lo), 3), 9 FROM y HAVING min(lo) > {A}""")
def win_region_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans clipped to a window, with a leading unknown one."""
    from packetloom.operators.joins import intervals

    x = intervals(crossings(spark, d), "ct", end=F.lit(1706745600.0)).filter((c("hi") > A) & (c("lo") < Z))
    x = x.select(F.greatest("lo", F.lit(A)).alias("lo"), F.least("hi", F.lit(Z)).alias("hi"), "code").filter("hi > lo")
    lead = x.agg(F.min("lo").alias("hi")).filter(c("hi") > A).select(F.lit(A).alias("lo"), "hi", F.lit(9).alias("code"))
    return x.union(lead).select(F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "code")


def sparse_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).withColumnRenamed("t0", "t").filter("period_min > 0")


#: The walk event by event: k are the kept rows that the window still reaches, out the duplicate that a step makes.
_GREEDY = f"""e AS (SELECT row_number() OVER (ORDER BY t, event_id) AS n, t, event_id, period_min, q_factor FROM (SELECT event_id, t0 AS t, period_min, q_factor FROM {CAT} WHERE period_min > 0)),
w AS (SELECT 0::BIGINT AS n, []::STRUCT(t DOUBLE, i BIGINT, p DOUBLE, q DOUBLE)[] AS k, NULL::BIGINT AS out
UNION ALL SELECT n, CASE WHEN hit IS NULL THEN list_append(l, {{'t': t, 'i': event_id, 'p': period_min, 'q': q_factor}}) WHEN q_factor > l[hit].q THEN list_concat(l[:hit - 1], list_prepend({{'t': t, 'i': event_id, 'p': period_min, 'q': q_factor}}, l[hit + 1:])) ELSE l END,
  CASE WHEN hit IS NULL THEN NULL WHEN q_factor > l[hit].q THEN l[hit].i ELSE event_id END
FROM (SELECT *, list_max(list_filter(range(1, len(l) + 1), lambda j: abs(period_min - l[j].p) / greatest(l[j].p, 1e-9) <= 0.10)) AS hit
FROM (SELECT e.*, w.k[coalesce(list_max(list_filter(range(1, len(w.k) + 1), lambda j: e.t - w.k[j].t > 7200.0)), 0) + 1:] AS l FROM w JOIN e ON e.n = w.n + 1)))"""


@query("win_dedup_catalogue", f"WITH RECURSIVE {_GREEDY} SELECT event_id, event_id IN (SELECT out FROM w WHERE out IS NOT NULL) AS is_duplicate FROM e")
def win_dedup_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The whole catalogue is one walk: copies in neighbouring segments are what it is for."""
    x = sparse_catalogue(spark, d).select("event_id", "t", "period_min", "q_factor")
    return greedy.tag_duplicates(x, 7200.0, 0.10).select("event_id", "is_duplicate")


@query("win_dedup_collapse", f"WITH RECURSIVE {_GREEDY} SELECT event_id, round(t, 3) AS t, period_min, q_factor FROM e WHERE event_id NOT IN (SELECT out FROM w WHERE out IS NOT NULL)")
def win_dedup_collapse(spark: SparkSession, d: str) -> DataFrame:
    x = sparse_catalogue(spark, d).select("event_id", "t", "period_min", "q_factor")
    return greedy.collapse_duplicates(x, 7200.0, 0.10).withColumn("t", F.round("t", 3))


_PEAKS = f"""e AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, user_id AS s, t, event_id, value AS p FROM {EV} WHERE value > 0),
w AS (SELECT DISTINCT s, 0::BIGINT AS n, []::STRUCT(t DOUBLE, p DOUBLE)[] AS k, NULL::BIGINT AS kept FROM e
UNION ALL SELECT s, n, CASE WHEN near THEN l ELSE list_append(l, {{'t': t, 'p': p}}) END, CASE WHEN near THEN NULL ELSE event_id END
FROM (SELECT *, len(list_filter(l, lambda x: abs(log2(p / x.p)) < 0.5)) > 0 AS near FROM (SELECT e.*, list_filter(w.k, lambda x: e.t - x.t < 7200.0) AS l FROM w JOIN e ON e.s = w.s AND e.n = w.n + 1)))"""


@query("win_dedup_peaks", f"WITH RECURSIVE {_PEAKS} SELECT event_id, s AS segment_idx, t, p AS period_min FROM e WHERE event_id IN (SELECT kept FROM w WHERE kept IS NOT NULL)")
def win_dedup_peaks(spark: SparkSession, d: str) -> DataFrame:
    return greedy.dedup_peaks(sparse_catalogue(spark, d).select("event_id", "segment_idx", "t", "period_min"), ["segment_idx"])


@query("win_resample", f"""WITH g AS (SELECT user_id, t, value, min(t) OVER (PARTITION BY user_id) AS t0, CAST(floor((max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id)) / 3600) AS BIGINT) AS n FROM {EV}),
q AS (SELECT DISTINCT user_id, unnest(range(0, n)) AS i, t0 FROM g), p AS (SELECT user_id, i, t0 + i * 3600.0 AS tg FROM q),
j AS (SELECT p.user_id, p.i, p.tg, a.t AS ta, a.value AS va, b.t AS tb, b.value AS vb FROM p ASOF JOIN {EV} a ON p.user_id = a.user_id AND p.tg >= a.t ASOF JOIN {EV} b ON p.user_id = b.user_id AND p.tg <= b.t)
SELECT user_id, i, round(CASE WHEN tb > ta THEN va + (vb - va) * (tg - ta) / (tb - ta) ELSE va END, 4) AS value FROM j""")
def win_resample(spark: SparkSession, d: str) -> DataFrame:
    return ordered.resample(ev(spark, d), "t", "value", 3600.0, ["user_id"]).select("user_id", "i", F.round("value", 4).alias("value"))


HOLES = f"(SELECT seg, i, CASE WHEN (seg * 7 + i) % 5 = 0 THEN NULL ELSE v END AS v FROM {SIG})"


@query("win_nan_fill", f"""WITH h AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY seg ORDER BY i ROWS UNBOUNDED PRECEDING) AS pa, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY seg ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM {HOLES})
SELECT h.seg, h.i, round(CASE WHEN h.v IS NOT NULL THEN h.v WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (h.i - pa) / (pb - pa) END, 6) AS linear, round(coalesce(h.v, avg(h.v) OVER (PARTITION BY h.seg)), 6) AS mean, round(coalesce(h.v, 0), 6) AS zero
FROM h LEFT JOIN {HOLES} a ON a.seg = h.seg AND a.i = pa LEFT JOIN {HOLES} b ON b.seg = h.seg AND b.i = pb""")
def win_nan_fill(spark: SparkSession, d: str) -> DataFrame:
    x = signal(spark, d).withColumn("i", c("i").cast("long")).withColumn("linear", F.when((c("seg") * 7 + c("i")) % 5 != 0, c("v")))
    x = x.withColumn("mean", c("linear")).withColumn("zero", c("linear"))
    for how in ("linear", "mean", "zero"):
        x = ordered.fill(x, how, ["seg"], ["i"], how)
    return x.select("seg", "i", *[r6(c(n), n) for n in ("linear", "mean", "zero")])


@query("samp_stride", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS rn FROM {EV}) WHERE rn % 7 = 0")
def samp_stride(spark: SparkSession, d: str) -> DataFrame:
    return ordered.stride(ev(spark, d), 7, ["user_id"], ["t", "event_id"]).select("event_id")


@query("win_ridge_interp", f"""WITH p AS (SELECT seg, i, ln(v * v) AS y, arg_max(i, v * v) OVER (PARTITION BY seg) AS top FROM {SIG} WHERE v <> 0), n AS (SELECT seg, i, top, y, lag(y) OVER w AS a, lead(y) OVER w AS b FROM p WINDOW w AS (PARTITION BY seg ORDER BY i))
SELECT seg, round(i + CASE WHEN a - 2 * y + b < 0 THEN 0.5 * (a - b) / (a - 2 * y + b) ELSE 0 END, 5) AS peak FROM n WHERE i = top""")
def win_ridge_interp(spark: SparkSession, d: str) -> DataFrame:
    """Peak place by a parabola through the logs of three neighbours; at an edge the peak itself."""
    w = Window.partitionBy("seg").orderBy("i")
    x = signal(spark, d).filter("v <> 0").withColumn("y", F.ln(c("v") * c("v"))).withColumn("top", F.max_by("i", c("v") * c("v")).over(Window.partitionBy("seg")))
    x = x.withColumn("a", F.lag("y").over(w)).withColumn("b", F.lead("y").over(w)).filter("i = top")
    bend = c("a") - 2 * c("y") + c("b")
    return x.select("seg", F.round(c("i") + F.when(bend < 0, 0.5 * (c("a") - c("b")) / bend).otherwise(0.0), 5).alias("peak"))


@query("sort_event_ids", f"SELECT event_id, row_number() OVER (ORDER BY (t0 + t1) / 2, segment_idx, event_id) - 1 AS id FROM {CAT}")
def sort_event_ids(spark: SparkSession, d: str) -> DataFrame:
    """Dense numbers by peak time, so that no task holds the whole table."""
    x = cat(spark, d).select("event_id", "segment_idx", ((c("t0") + c("t1")) / 2).alias("peak"))
    return ordered.numbered(x, ["peak", "segment_idx", "event_id"], "id").select("event_id", "id")


@query("topk_examples", f"""SELECT pool, event_id FROM (SELECT CASE WHEN k >= 80 THEN 'circular' WHEN k <= 20 THEN 'linear' END AS pool, event_id, band, period_min FROM {CAT}) WHERE pool IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY pool ORDER BY coalesce(band = 'QP60', false) DESC, period_min DESC, event_id) = 1""")
def topk_examples(spark: SparkSession, d: str) -> DataFrame:
    x = cat(spark, d).withColumn("pool", F.when(c("k") >= 80, "circular").when(c("k") <= 20, "linear")).filter("pool IS NOT NULL")
    best = F.struct(F.coalesce(c("band") == "QP60", F.lit(False)).alias("pref"), c("period_min").alias("v"), (-c("event_id")).alias("id"))
    return x.groupBy("pool").agg(F.max_by("event_id", best).alias("event_id"))


@query("topk_vmax", f"SELECT event_type, round(quantile_cont(value, 0.99), 6) AS hi, round(quantile_cont(value, 0.05), 6) AS lo FROM {EV} WHERE isfinite(value) GROUP BY 1")
def topk_vmax(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).filter(~F.isnan("value") & (F.abs("value") < float("inf")))
    return stats.quantiles(e, c("value"), ["event_type"], {"hi": 0.99, "lo": 0.05}).select("event_type", r6(c("hi"), "hi"), r6(c("lo"), "lo"))


@query("set_union_flags", f"SELECT event_id, 'range_change' AS flag FROM {EV} WHERE k % 10 = 1 UNION ALL SELECT event_id, 'mode_change' FROM {EV} WHERE k % 10 = 2 UNION ALL SELECT event_id, 'calibration' FROM {EV} WHERE k % 5 = 1")
def set_union_flags(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    of = lambda m, r, n: e.filter(c("k") % m == r).select("event_id", F.lit(n).alias("flag"))
    return of(10, 1, "range_change").unionByName(of(10, 2, "mode_change")).unionByName(of(5, 1, "calibration"))


@query("set_union_bands", f"SELECT DISTINCT s.event_id FROM {EV} s JOIN {CAT} c ON s.user_id = c.segment_idx AND s.t >= c.t0 AND s.t <= c.t1 WHERE c.band IS NOT NULL")
def set_union_bands(spark: SparkSession, d: str) -> DataFrame:
    from packetloom.plans.q_joins import join_interval_event

    return join_interval_event(spark, d).select("event_id").distinct()


@query("set_timeline", f"SELECT event_id, round(t0, 3) AS t, band FROM {CAT}")
def set_timeline(spark: SparkSession, d: str) -> DataFrame:
    return cat(spark, d).select("event_id", F.round("t0", 3).alias("t"), "band")

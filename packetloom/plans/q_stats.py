"""Queries of the summaries and scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions.bands import band_of
from packetloom.operators import joins, scoring, stats
from packetloom.plans.q_grids import _MINUTES, event_grid
from packetloom.plans.q_joins import _DET, _TRUTH, detections, truth
from packetloom.plans.registry import CAT, EV, cat, ev, query, r6, table

c = F.col
SEP = f"(SELECT user_id, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t)) / 3600 AS hours FROM {EV})"
SIG = "(SELECT vec_id AS seg, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"


def signal(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a series of 64 samples: (seg, label, i, v)."""
    return table(spark, d, "embeddings").select(c("vec_id").alias("seg"), "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", c("v").cast("double"))


@query("agg_block_avg", f"SELECT seg, CAST(floor(i / 10) AS BIGINT) AS b, round(avg(v), 6) AS v FROM {SIG} GROUP BY 1, 2")
def agg_block_avg(spark: SparkSession, d: str) -> DataFrame:
    """Means of blocks of ten, the last one partial."""
    return signal(spark, d).groupBy("seg", F.floor(c("i") / 10).alias("b")).agg(r6(F.avg("v"), "v"))


@query("agg_group_bins", f"""SELECT CAST(b AS INTEGER) AS bin, count(event_id) AS n, coalesce(min(event_id), -1) AS first FROM range(0, 20) r(b) LEFT JOIN (SELECT event_id, floor((value - 0) / 60 * 20) AS k FROM {EV} WHERE value >= 0 AND value < 60) e ON e.k = r.b GROUP BY 1""")
def agg_group_bins(spark: SparkSession, d: str) -> DataFrame:
    """Members per bin: empty bins stay, values out of range go."""
    e = ev(spark, d).filter((c("value") >= 0) & (c("value") < 60)).groupBy(F.floor(c("value") / 60 * 20).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    spine = spark.range(20).select(c("id").cast("int").alias("bin"))
    return spine.join(e, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first", F.lit(-1)).alias("first"))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return stats.separations(ev(spark, d), "t", 48.0, ["user_id"])


@query("win_separation", f"SELECT user_id, round(hours, 6) AS hours FROM {SEP} WHERE hours > 0 AND hours <= 48")
def win_separation(spark: SparkSession, d: str) -> DataFrame:
    return gaps(spark, d).select("user_id", r6(c("hours"), "hours"))


@query("agg_sep_stats", f"SELECT user_id, round(coalesce(quantile_cont(hours, 0.5), 0), 6) AS median, round(coalesce(avg(hours), 0), 6) AS mean, round(coalesce(stddev_pop(hours), 0), 6) AS std, count(*) AS n FROM {SEP} WHERE hours > 0 AND hours <= 48 GROUP BY 1")
def agg_sep_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.separation_stats(gaps(spark, d), ["user_id"])
    return s.select("user_id", *[r6(c(x), x) for x in ("median", "mean", "std")], "n")


@query("agg_sep_hist", f"""WITH h AS (SELECT hours FROM {SEP} WHERE hours > 0 AND hours <= 48), g AS (SELECT CAST(least(floor(hours / 48 * 24), 23) AS INTEGER) AS bin, count(*) AS n FROM h GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / ((SELECT count(*) FROM h) * 2.0), 6) AS density FROM range(0, 24) r(b) LEFT JOIN g ON g.bin = b""")
def agg_sep_hist(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(gaps(spark, d), "hours", 0.0, 48.0, 24).select("bin", "n", r6(c("density"), "density"))


@query("agg_kde", f"""WITH h AS (SELECT hours FROM {SEP} WHERE hours > 0 AND hours <= 48), s AS (SELECT 0.2 * stddev_samp(hours) AS h, count(*) AS n FROM h)
SELECT CAST(i AS INTEGER) AS i, round(sum(exp(-0.5 * pow((i * 48.0 / 499 - hours) / s.h, 2))) / (any_value(s.n) * any_value(s.h) * sqrt(2 * pi())), 6) AS density FROM range(0, 500) r(i), h, s GROUP BY 1""")
def agg_kde(spark: SparkSession, d: str) -> DataFrame:
    return stats.kde(gaps(spark, d), "hours", 0.0, 48.0, 500, 0.2).select("i", r6(c("density"), "density"))


@query("agg_quantile_spectra", "SELECT l_linenumber % 4 AS quadrant, CAST(l_quantity AS INTEGER) AS f, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_quantile_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles by quadrant and frequency."""
    li = table(spark, d, "lineitem").select((c("l_linenumber") % 4).alias("quadrant"), c("l_quantity").cast("int").alias("f"), "l_extendedprice")
    q = stats.quantiles(li, c("l_extendedprice"), ["quadrant", "f"], {"med": 0.5, "q1": 0.25, "q3": 0.75})
    return q.select("quadrant", "f", *[F.round(x, 4).alias(x) for x in ("med", "q1", "q3")], "n")


_MED = "(SELECT CAST(l_quantity AS INTEGER) AS f, CAST(l_quantity AS INTEGER) % 5 AS band, quantile_cont(l_extendedprice * (1 + l_tax), 0.5) AS m FROM lineitem GROUP BY 1, 2)"


@query("agg_band_fwhm", f"""WITH m AS (SELECT *, max(m) OVER (PARTITION BY band) AS top, arg_max(f, m) OVER (PARTITION BY band) AS peak FROM {_MED})
SELECT band, round(any_value(top), 4) AS top, CASE WHEN count(*) FILTER (WHERE m >= top / 2) > 1 THEN CAST(min(f) FILTER (WHERE m >= top / 2) AS DOUBLE) ELSE any_value(peak) * 0.8 END AS lo,
  CASE WHEN count(*) FILTER (WHERE m >= top / 2) > 1 THEN CAST(max(f) FILTER (WHERE m >= top / 2) AS DOUBLE) ELSE any_value(peak) * 1.2 END AS hi FROM m GROUP BY band""")
def agg_band_fwhm(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies above half the maximum of each band's median; a fifth around the peak if it stands alone."""
    li = table(spark, d, "lineitem").select(c("l_quantity").cast("int").alias("f"), (c("l_extendedprice") * (1 + c("l_tax"))).alias("p"))
    m = stats.quantiles(li, c("p"), ["f"], {"m": 0.5}).withColumn("band", c("f") % 5)
    m = m.withColumn("top", F.max("m").over(Window.partitionBy("band")))
    half = c("m") >= c("top") / 2
    g = m.groupBy("band").agg(F.max("top").alias("top"), F.max_by("f", "m").alias("peak"), F.count_if(half).alias("n"), F.min(F.when(half, c("f"))).alias("a"), F.max(F.when(half, c("f"))).alias("b"))
    edge = lambda x, k: F.when(c("n") > 1, c(x).cast("double")).otherwise(c("peak") * F.lit(k))
    return g.select("band", F.round("top", 4).alias("top"), edge("a", 0.8).alias("lo"), edge("b", 1.2).alias("hi"))


@query("agg_band_peak", f"SELECT segment_idx, band, round(max(q_factor), 6) AS ratio, arg_max(event_id, (q_factor, event_id)) AS at, max(q_factor) > 5 AS triggered FROM {CAT} WHERE band IS NOT NULL GROUP BY 1, 2")
def agg_band_peak(spark: SparkSession, d: str) -> DataFrame:
    g = cat(spark, d).filter("band IS NOT NULL").groupBy("segment_idx", "band")
    return g.agg(r6(F.max("q_factor"), "ratio"), F.max_by("event_id", F.struct("q_factor", "event_id")).alias("at"), (F.max("q_factor") > 5).alias("triggered"))


@query("agg_rayleigh", f"""WITH g AS (SELECT band, count(*) AS n, sum(cos(k * 0.0628)) AS a, sum(sin(k * 0.0628)) AS b FROM {CAT} WHERE band IS NOT NULL GROUP BY 1), r AS (SELECT *, sqrt(a*a + b*b) / n AS r FROM g)
SELECT band, n, round(r, 6) AS r, round(n * r * r, 6) AS z, round(least(1.0, exp(sqrt(1 + 4.0*n + 4.0*(CAST(n AS DOUBLE)*n - pow(n*r, 2))) - (1 + 2*n))), 6) AS p FROM r""")
def agg_rayleigh(spark: SparkSession, d: str) -> DataFrame:
    r = stats.rayleigh(cat(spark, d).filter("band IS NOT NULL"), c("k") * F.lit(0.0628), ["band"])
    return r.select("band", "n", *[r6(c(x), x) for x in ("r", "z", "p")])


_FOLD = f"(SELECT CAST(n AS VARCHAR) AS phase, band, CAST(floor(((k * n * 7.5) % 360) / 15) AS INTEGER) AS bin FROM {CAT}, (VALUES (1), (2)) v(n) WHERE band IS NOT NULL)"


@query("agg_phase_fold", f"""SELECT p.phase, p.band, CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT phase, band FROM {_FOLD}) p CROSS JOIN range(0, 24) r(b) LEFT JOIN (SELECT phase, band, bin, count(*) AS n FROM {_FOLD} GROUP BY 1, 2, 3) f ON f.phase = p.phase AND f.band = p.band AND f.bin = b""")
def agg_phase_fold(spark: SparkSession, d: str) -> DataFrame:
    """Events per 15 degrees of each phase and band, empty bins too."""
    phase = lambda n: F.struct(F.lit(str(n)).alias("phase"), F.floor(F.pmod(c("k") * n * F.lit(7.5), F.lit(360.0)) / 15).cast("int").alias("bin"))
    x = cat(spark, d).filter("band IS NOT NULL").select("band", F.explode(F.array(phase(1), phase(2))).alias("p")).select("p.phase", "band", "p.bin")
    return stats.folded(x, ["phase", "band"], "bin", 24)


_LABELS = ("all", "short", "long", "high_q", "late")
_CONDS = {"all": "true", "short": "period_min < 20", "long": "period_min >= 20", "high_q": "q_factor > 5", "late": "event_id % 3 = 2"}


@query("agg_region_groups", " UNION ALL ".join(f"SELECT '{n}' AS grp, count(*) AS n, round(quantile_cont(period_min, 0.5), 6) AS med, round(100.0 * count(*) FILTER (WHERE band = 'QP15') / count(*), 6) AS qp15, round(100.0 * count(*) / (SELECT count(*) FROM {CAT}), 6) AS retained FROM {CAT} WHERE {w}" for n, w in _CONDS.items()))
def agg_region_groups(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping comparison groups in one pass: each event carries all labels that fit."""
    x = cat(spark, d)
    labels = F.array_compact(F.array(*[F.when(F.expr(w), F.lit(n)) for n, w in _CONDS.items()]))
    x = x.withColumn("grp", F.explode(labels)).select("grp", "period_min", "band")
    g = x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("band") == "QP15").alias("b"))
    mid = stats.quantiles(x, c("period_min"), ["grp"], {"med": 0.5}).select("grp", "med")
    return g.join(mid, "grp", "left").select("grp", "n", r6(c("med"), "med"), r6(100.0 * c("b") / c("n"), "qp15"), r6(100.0 * c("n") / F.max(F.when(c("grp") == "all", c("n"))).over(Window.partitionBy(F.lit(0))), "retained"))  # a row per label


@query("agg_ks", f"""WITH v AS (SELECT event_type, value, count(*) AS n FROM {EV} GROUP BY 1, 2), r AS (SELECT value, n FROM v WHERE event_type = 'error'), t AS (SELECT event_type, sum(n) AS n FROM v GROUP BY 1),
u AS (SELECT g.event_type AS grp, x.value, coalesce(v.n, 0) AS n, coalesce(r.n, 0) AS m FROM (SELECT DISTINCT event_type FROM v WHERE event_type <> 'error') g CROSS JOIN (SELECT DISTINCT value FROM v) x LEFT JOIN v ON v.event_type = g.event_type AND v.value = x.value LEFT JOIN r ON r.value = x.value),
f AS (SELECT grp, abs(sum(n) OVER w / sum(n) OVER (PARTITION BY grp) - sum(m) OVER w / sum(m) OVER (PARTITION BY grp)) AS gap FROM u WINDOW w AS (PARTITION BY grp ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT grp, round(CAST(max(gap) AS DOUBLE), 6) AS ks FROM f GROUP BY 1""")
def agg_ks(spark: SparkSession, d: str) -> DataFrame:
    return stats.ks_distance(ev(spark, d), "value", "event_type", "error").select(c("event_type").alias("grp"), r6(c("ks"), "ks"))


def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation, from Student's t by the continued fraction of the incomplete beta."""

    def beta_tail(x: float, a: float, b: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta_tail(1 - x, b, a)
        f, cc, dd = 1.0, 1.0, 0.0
        for i in range(300):
            m = i // 2
            num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            dd = 1 / (1 + num * dd or 1e-300)
            cc = 1 + num / cc or 1e-300
            f *= cc * dd
            if abs(1 - cc * dd) < 1e-12:
                break
        return front * (f - 1) / a

    out = []
    for x, k in zip(r, n, strict=True):
        df = k - 2
        out.append(0.0 if abs(x) >= 1 else beta_tail(1 - x * x, df / 2, 0.5))
    return pd.Series(out)


@query("agg_corr", f"""WITH r AS (SELECT event_type, value, k, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS b FROM {EV})
SELECT event_type, count(*) AS n, round(corr(value, k), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def agg_corr(spark: SparkSession, d: str) -> DataFrame:
    """Pearson and Spearman correlations over rows with both values; Spearman's from mean ranks."""
    e = stats.paired(ev(spark, d), "value", "k", ["event_type"])
    e = stats.average_ranks(stats.average_ranks(e, "value", ["event_type"], "a"), "k", ["event_type"], "b")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("value", "k"), "pearson"), r6(F.corr("a", "b"), "spearman"))


@query("agg_corr_p")
def agg_corr_p(spark: SparkSession, d: str) -> DataFrame:
    g = ev(spark, d).groupBy("event_type").agg(F.corr("value", "k").alias("r"), F.count(F.lit(1)).cast("double").alias("n"))
    return g.select("event_type", "r", F.pandas_udf(p_value, "double")("r", "n").alias("p"))


@query("agg_power_bins", f"SELECT seg, CAST(b AS INTEGER) AS b, round(quantile_cont(v * v, 0.5), 6) AS power FROM {SIG}, range(1, 8) r(b) WHERE i >= greatest(1, b * 8 - 4) AND i <= least(63, b * 8 + 4) GROUP BY 1, 2")
def agg_power_bins(spark: SparkSession, d: str) -> DataFrame:
    """Median power about centre indices, clipped to 1..n-1."""
    s = signal(spark, d).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(7))))
    s = s.filter((c("i") >= F.greatest(F.lit(1), c("b") * 8 - 4)) & (c("i") <= F.least(F.lit(63), c("b") * 8 + 4)))
    return s.groupBy("seg", "b").agg(r6(F.percentile(c("v") * c("v"), 0.5), "power"))


_PL = f"(SELECT seg, CAST(i AS DOUBLE) AS f, v * v AS p FROM {SIG} WHERE i > 0 AND v <> 0)"


@query("agg_powerlaw", f"SELECT seg, round(regr_slope(ln(p), ln(f)), 5) AS slope, round(regr_intercept(ln(p), ln(f)), 5) AS intercept, count(*) AS n FROM {_PL} GROUP BY 1")
def agg_powerlaw(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d).select("seg", c("i").cast("double").alias("f"), (c("v") * c("v")).alias("p"))
    out = stats.power_law(s, "f", "p", ["seg"])
    return out.select("seg", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), "n")


_NAMED = {"low": (1, 10), "high": (10, 40)}


@query("agg_powerlaw_bands", " UNION ALL ".join(f"SELECT seg, '{n}' AS name, round(regr_slope(ln(p), ln(f)), 5) AS slope, count(*) AS n FROM {_PL} WHERE f >= {lo} AND f <= {hi} GROUP BY 1" for n, (lo, hi) in _NAMED.items()))
def agg_powerlaw_bands(spark: SparkSession, d: str) -> DataFrame:
    """Slopes in named ranges of frequency."""
    s = signal(spark, d).select("seg", c("i").cast("double").alias("f"), (c("v") * c("v")).alias("p"))
    return stats.spectral_slopes(s, "f", "p", ["seg"], _NAMED).select("seg", "name", F.round("slope", 5).alias("slope"), "n")


_DET3 = "({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


@query("agg_powerlaw_degree2", f"""WITH m AS (SELECT seg, count(*) AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM (SELECT seg, ln(f) AS x, ln(p) AS y FROM {_PL}) GROUP BY 1)
SELECT seg, round({_DET3.format(a="s0", b="s1", c="t0", d="s1", e="s2", f="t1", g="s2", h="s3", i="t2")} / {_DET3.format(a="s0", b="s1", c="s2", d="s1", e="s2", f="s3", g="s2", h="s3", i="s4")}, 3) AS bend FROM m""")
def agg_powerlaw_degree2(spark: SparkSession, d: str) -> DataFrame:
    """Bend of a second-degree fit in log power over log frequency."""
    s = signal(spark, d).select("seg", c("i").cast("double").alias("f"), (c("v") * c("v")).alias("p"))
    return stats.power_law_degree(s, "f", "p", ["seg"], 2).select("seg", F.round(F.get("coefficients", F.lit(2)), 3).alias("bend"))


@query("agg_powerlaw_bg", f"""WITH b AS (SELECT seg, regr_slope(ln(p), ln(f)) AS s, regr_intercept(ln(p), ln(f)) AS a FROM {_PL} WHERE f < 20 OR f >= 40 GROUP BY 1)
SELECT seg, CAST(f AS INTEGER) AS f, round(p / exp(a + s * ln(f)), 3) AS ratio FROM {_PL} JOIN b USING (seg)""")
def agg_powerlaw_bg(spark: SparkSession, d: str) -> DataFrame:
    """Power over the background that is fitted outside the search band."""
    s = signal(spark, d).select("seg", c("i").cast("double").alias("f"), (c("v") * c("v")).alias("p")).filter("f > 0 AND p > 0")
    b = stats.power_law(s.filter("f < 20 OR f >= 40"), "f", "p", ["seg"]).select("seg", "slope", "intercept")
    return s.join(b, "seg").select("seg", c("f").cast("int").alias("f"), F.round(c("p") / F.exp(c("intercept") + c("slope") * F.ln("f")), 3).alias("ratio"))


_Q4 = "(SELECT vec_id AS seg, CAST(embedding[4*j+1] AS DOUBLE) AS a, CAST(embedding[4*j+2] AS DOUBLE) AS b, CAST(embedding[4*j+3] AS DOUBLE) AS c, CAST(embedding[4*j+4] AS DOUBLE) AS d FROM embeddings, range(0, 16) r(j))"


def quads(spark: SparkSession, d: str, width: int) -> DataFrame:
    """Each vector as rows of ``width`` values, named a, b, c, d."""
    e = table(spark, d, "embeddings").select(c("vec_id").alias("seg"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(64 // width - 1))).alias("j"))
    return e.select("seg", "j", *[F.get("embedding", c("j") * width + k).cast("double").alias("abcd"[k]) for k in range(width)])


@query("agg_stokes", f"""WITH s AS (SELECT seg, avg(a*a + b*b + c*c + d*d) AS i, avg(a*a + b*b - c*c - d*d) AS q, avg(2*(a*c + b*d)) AS u, avg(2*(b*c - a*d)) AS v FROM {_Q4} GROUP BY 1)
SELECT seg, round(i, 6) AS i, round(q, 6) AS q, round(u, 6) AS u, round(v, 6) AS v, round(sqrt(q*q + u*u + v*v) / i, 6) AS d FROM s""")
def agg_stokes(spark: SparkSession, d: str) -> DataFrame:
    s = stats.stokes(quads(spark, d, 4), c("a"), c("b"), c("c"), c("d"), ["seg"])
    return s.select("seg", *[r6(c(x), x) for x in "iquvd"])


_Q3 = "(SELECT vec_id AS seg, CAST(embedding[3*j+1] AS DOUBLE) AS a, CAST(embedding[3*j+2] AS DOUBLE) AS b, CAST(embedding[3*j+3] AS DOUBLE) AS c FROM embeddings, range(0, 21) r(j))"


@query("agg_mva", f"""WITH m AS (SELECT seg, var_samp(a) AS xx, var_samp(b) AS yy, var_samp(c) AS zz, covar_samp(a, b) AS xy, covar_samp(a, c) AS xz, covar_samp(b, c) AS yz FROM {_Q3} GROUP BY 1),
p AS (SELECT *, (xx+yy+zz)/3 AS q, sqrt((pow(xx-(xx+yy+zz)/3,2) + pow(yy-(xx+yy+zz)/3,2) + pow(zz-(xx+yy+zz)/3,2) + 2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM m),
f AS (SELECT *, acos(greatest(-1.0, least(1.0, ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz)) / (2*p*p*p)))) / 3 AS phi FROM p),
e AS (SELECT seg, q + 2*p*cos(phi) AS hi, q + 2*p*cos(phi + 2*pi()/3) AS lo, 3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + 2*pi()/3)) AS mid FROM f)
SELECT seg, round(mid / lo, 4) AS mid_lo, round(lo / hi, 5) AS lo_hi FROM e""")
def agg_mva(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of the eigenvalues of each segment's covariance (at least three rows each)."""
    q = quads(spark, d, 3)
    cov = [F.covar_samp(x, y).alias(x + y) for x, y in ("aa", "bb", "cc", "ab", "ac", "bc")]
    m = q.groupBy("seg").agg(*cov, F.count(F.lit(1)).alias("n"))
    lo, mid, hi = stats.eigenvalues3(c("aa"), c("bb"), c("cc"), c("ab"), c("ac"), c("bc"))
    ok = lambda v: F.when(c("n") >= 3, v).otherwise(0.0)
    return m.select("seg", F.round(ok(F.try_divide(mid, lo)), 4).alias("mid_lo"), F.round(ok(F.try_divide(lo, hi)), 5).alias("lo_hi"))


@query("agg_ar1", f"""WITH x AS (SELECT seg, i, v - avg(v) OVER (PARTITION BY seg) AS d FROM {SIG}), y AS (SELECT seg, d, lag(d) OVER (PARTITION BY seg ORDER BY i) AS b FROM x)
SELECT seg, round(greatest(-0.99, least(0.99, sum(d * b) / sum(d * d))), 6) AS a FROM y GROUP BY 1""")
def agg_ar1(spark: SparkSession, d: str) -> DataFrame:
    return stats.ar1(signal(spark, d), "v", "i", ["seg"]).select("seg", r6(c("a"), "a"))


_ROWS = f"(SELECT seg, label, CAST(floor(i / 8) AS BIGINT) AS f, quantile_cont(abs(v), 0.5) AS med FROM {SIG} GROUP BY 1, 2, 3)"


_AMP = "(SELECT a.seg, a.label, CAST(floor(a.i / 8) AS BIGINT) AS f, sqrt(abs(a.v) * abs(b.v)) AS x FROM {s} a JOIN {s} b ON a.seg = b.seg AND b.i = a.i + 32)".format(s=SIG)
_STAT = f"(SELECT r.label, r.f, r.seg, r.med, quantile_cont(abs(x.x - r.med), 0.5) AS mad FROM (SELECT label, f, seg, quantile_cont(x, 0.5) AS med FROM {_AMP} GROUP BY 1, 2, 3) r JOIN {_AMP} x USING (label, f, seg) GROUP BY 1, 2, 3, 4)"


@query("agg_bg_archive", " UNION ALL ".join(f"SELECT label AS region, f, '{w}' AS what, count(*) AS n, round(quantile_cont({w}, 0.16), 6) AS p16, round(quantile_cont({w}, 0.5), 6) AS p50, round(quantile_cont({w}, 0.84), 6) AS p84 FROM {_STAT} GROUP BY 1, 2" for w in ("med", "mad")))
def agg_bg_archive(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over segments, by region, of the median and MAD of each row of the two components' geometric mean.

    A vector's halves are its components here; a row is eight samples.
    """
    v = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.sqrt(F.abs(F.get("embedding", k)).cast("double") * F.abs(F.get("embedding", k + 32)).cast("double")))
    x = table(spark, d, "embeddings").select(c("vec_id").alias("seg"), "label", F.posexplode(v).alias("i", "x")).withColumn("f", F.floor(c("i") / 8))
    rows = stats.median_and_spread(x, c("x"), ["seg", "label", "f"])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), c(n).alias("x")) for n in ("med", "mad")])).alias("e")
    q = stats.quantiles(rows.select(c("label").alias("region"), "f", each).select("region", "f", "e.*"), c("x"), ["region", "f", "what"], {"p16": 0.16, "p50": 0.5, "p84": 0.84})
    return q.select("region", "f", "what", "n", *[r6(c(x), x) for x in ("p16", "p50", "p84")])


@query("agg_field_range", f"SELECT seg, round(greatest(max(a) - min(a), max(b) - min(b), max(c) - min(c)), 6) AS span, round(least(min(a), min(b), min(c)), 6) AS lo, round(greatest(max(a), max(b), max(c)), 6) AS hi FROM {_Q3} GROUP BY 1")
def agg_field_range(spark: SparkSession, d: str) -> DataFrame:
    span = F.greatest(*[F.max(x) - F.min(x) for x in "abc"])
    return quads(spark, d, 3).groupBy("seg").agg(r6(span, "span"), r6(F.least(*[F.min(x) for x in "abc"]), "lo"), r6(F.greatest(*[F.max(x) for x in "abc"]), "hi"))


@query("agg_dup_report", f"SELECT band, count(*) AS n, count(*) FILTER (WHERE k % 9 = 0) AS dups, round(100.0 * count(*) FILTER (WHERE k % 9 = 0) / count(*), 6) AS percent FROM {CAT} WHERE band IS NOT NULL GROUP BY 1")
def agg_dup_report(spark: SparkSession, d: str) -> DataFrame:
    g = cat(spark, d).filter("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("k") % 9 == 0).alias("dups"))
    return g.withColumn("percent", r6(100.0 * c("dups") / c("n"), "percent"))


@query("agg_peer_counts", f"""WITH c AS (SELECT *, k % 9 = 0 AS dup FROM {CAT}), p AS (SELECT a.event_id, count(*) AS n FROM c a JOIN c b ON a.segment_idx = b.segment_idx AND a.event_id <> b.event_id AND NOT a.dup AND NOT b.dup AND least(a.t1, b.t1) > greatest(a.t0, b.t0)
  AND a.t1 > a.t0 AND b.t1 > b.t0 AND (least(a.t1, b.t1) - greatest(a.t0, b.t0)) / least(a.t1 - a.t0, b.t1 - b.t0) >= 0.5 GROUP BY 1)
SELECT CAST(coalesce(p.n, 0) AS INTEGER) AS peers, count(*) AS n FROM c LEFT JOIN p USING (event_id) GROUP BY 1""")
def agg_peer_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many events have how many peers."""
    x = joins.peers(cat(spark, d).withColumn("is_duplicate", c("k") % 9 == 0))
    return x.groupBy(F.size("peer_event_ids").alias("peers")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_cutoff_curve", f"SELECT CAST(cut AS DOUBLE) AS cut, count(*) FILTER (WHERE k / 100.0 >= cut) AS kept, round(100.0 * count(*) FILTER (WHERE k / 100.0 >= cut) / count(*), 6) AS percent FROM {CAT}, (VALUES (0.5), (0.6), (0.7), (0.8), (0.9)) v(cut) GROUP BY 1")
def agg_cutoff_curve(spark: SparkSession, d: str) -> DataFrame:
    x = cat(spark, d).withColumn("cut", F.explode(F.array(*[F.lit(v) for v in (0.5, 0.6, 0.7, 0.8, 0.9)])))
    g = x.groupBy("cut").agg(F.count_if(c("k") / 100.0 >= c("cut")).alias("kept"), F.count(F.lit(1)).alias("n"))
    return g.select("cut", "kept", r6(100.0 * c("kept") / c("n"), "percent"))


_PHS = "((k * 7.5) % 360)"


@query("agg_phase_frac", f"""SELECT user_id, CASE WHEN count(*) >= 10 THEN round(avg(CASE WHEN abs({_PHS} - 90) < 30 OR abs({_PHS} - 270) < 30 THEN 1.0 ELSE 0 END), 6) END AS circular, CASE WHEN count(*) >= 10 THEN round(avg(CASE WHEN abs({_PHS} - 180) < 30 THEN 1.0 ELSE 0 END), 6) END AS opposed, count(*) AS n FROM {EV} GROUP BY 1""")
def agg_phase_frac(spark: SparkSession, d: str) -> DataFrame:
    p = F.pmod(c("k") * F.lit(7.5), F.lit(360.0))
    near = lambda *a: F.avg(F.greatest(*[(F.abs(p - x) < 30).cast("double") for x in a], F.lit(0.0)))
    g = ev(spark, d).groupBy("user_id").agg(near(90.0, 270.0).alias("x"), near(180.0).alias("y"), F.count(F.lit(1)).alias("n"))
    ok = lambda v, n: F.when(c("n") >= 10, r6(c(v), n)).alias(n)
    return g.select("user_id", ok("x", "circular"), ok("y", "opposed"), "n")


_CLS = f"(SELECT CASE WHEN abs({_PHS} - 90) < 30 OR abs({_PHS} - 270) < 30 THEN 'circular' WHEN {_PHS} < 30 OR {_PHS} > 330 OR abs({_PHS} - 180) < 30 THEN 'linear' ELSE 'mixed' END AS cls, abs(value / 100) AS ell FROM {EV})"


@query("agg_phase_crosstab", f"SELECT cls, CASE WHEN ell >= 0.5 THEN 'round' WHEN ell >= 0.2 THEN 'oval' ELSE 'flat' END AS shape, count(*) AS n, round(avg(ell), 6) AS mean FROM {_CLS} GROUP BY 1, 2")
def agg_phase_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Classes by phase against classes by ellipticity."""
    p, ell = F.pmod(c("k") * F.lit(7.5), F.lit(360.0)), F.abs(c("value") / 100)
    near = lambda x: F.abs(p - x) < 30
    cls = F.when(near(90.0) | near(270.0), "circular").when((p < 30) | (p > 330) | near(180.0), "linear").otherwise("mixed")
    shape = F.when(ell >= 0.5, "round").when(ell >= 0.2, "oval").otherwise("flat")
    return ev(spark, d).groupBy(cls.alias("cls"), shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(ell), "mean"))


_CHECKED = f"(SELECT band, t0, t1, period_min FROM {CAT} WHERE band IS NOT NULL UNION ALL SELECT 'total', t0, t1, period_min FROM {CAT} WHERE band IS NOT NULL)"


@query("agg_selfcheck", f"""WITH m AS {_MINUTES}, g AS (SELECT band, CAST(count(*) FILTER (WHERE in_range) AS DOUBLE) AS grid FROM m GROUP BY 1),
e AS (SELECT band, sum(t1 - t0) / 60 + count(*) AS x, round(min(period_min), 6) AS lo, round(quantile_cont(period_min, 0.5), 6) AS med, round(max(period_min), 6) AS hi FROM {_CHECKED} GROUP BY 1)
SELECT band, round(x, 3) AS expected, coalesce(grid, 0) AS grid, round(coalesce(grid, 0) - x, 3) AS diff, abs(coalesce(grid, 0) - x) > 60 AS warn, lo, med, hi FROM e LEFT JOIN g USING (band)""")
def agg_selfcheck(spark: SparkSession, d: str) -> DataFrame:
    """The event grid's minutes against the events' own: their lengths and one closing minute each; a warning beyond an hour."""
    x = cat(spark, d).filter("band IS NOT NULL").withColumn("band", F.explode(F.array("band", F.lit("total"))))
    e = x.groupBy("band").agg((F.sum(c("t1") - c("t0")) / 60 + F.count(F.lit(1))).alias("x"), r6(F.min("period_min"), "lo"), r6(F.max("period_min"), "hi"))
    mid = stats.quantiles(x, c("period_min"), ["band"], {"med": 0.5}).select("band", r6(c("med"), "med"))
    g = event_grid(spark, d).filter("schema = 'position'").groupBy("band").agg(F.sum("total").alias("grid"))
    out = e.join(mid, "band").join(g, "band", "left").withColumn("grid", F.coalesce("grid", F.lit(0.0)))
    diff = c("grid") - c("x")
    return out.select("band", F.round("x", 3).alias("expected"), "grid", F.round(diff, 3).alias("diff"), (F.abs(diff) > 60).alias("warn"), "lo", "med", "hi")


_MATCH = f"""(SELECT tid, did, ds, iou FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY iou DESC, did) AS a FROM (SELECT tid, did, ds, greatest(least(a1, b1) - greatest(a0, b0), 0) / (greatest(a1, b1) - least(a0, b0)) AS iou FROM {_TRUTH} JOIN {_DET} USING (ds))) WHERE a = 1 AND iou > 0.1)"""


def score_rows(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as truth, one in seven a decoy, and views as detections, by user."""
    e = ev(spark, d)
    more = e.select(c("event_id").alias("id"), c("value").alias("period"), band_of(c("value") * 60).alias("band"), F.element_at(F.array(*[F.lit(g) for g in scoring.DIFFICULTIES]), (c("k") % 4 + 1).cast("int")).alias("difficulty"), (c("k") % 7 == 0).alias("decoy"), c("t").alias("peak"))
    t = truth(spark, d).join(more.drop("peak"), c("tid") == c("id")).drop("id")
    return scoring.scores(t, detections(spark, d).join(more.select("id", "period", "band", "peak"), c("did") == c("id")).drop("id"))


@query("agg_score")
def agg_score(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of each data set, from the optimal assignment."""
    return score_rows(spark, d)


@query("agg_score_suite")
def agg_score_suite(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all data sets, in four tiers."""
    return scoring.suite(score_rows(spark, d), c("ds") % 4)


@query("agg_score_decoys", f"SELECT ds, count(*) AS n, round(avg(CASE WHEN best > 0.1 THEN 0.0 ELSE 1.0 END), 6) AS rejected FROM (SELECT tid, ds, coalesce(max(iou), 0) AS best FROM {_TRUTH} t LEFT JOIN (SELECT tid AS x, iou FROM {_MATCH}) m ON m.x = t.tid GROUP BY 1, 2) GROUP BY 1")
def agg_score_decoys(spark: SparkSession, d: str) -> DataFrame:
    """Share of decoys that no detection overlaps by more than a tenth."""
    t = truth(spark, d)
    best = scoring.iou_pairs(t, detections(spark, d)).groupBy("tid").agg(F.max("iou").alias("best"))
    j = t.join(best, "tid", "left")
    return j.groupBy("ds").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.coalesce("best", F.lit(0.0)) <= 0.1).cast("double")), "rejected"))


_TIER = f"(SELECT k % 5 AS tier, count(*) AS n, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS hits, avg(value / 100) AS iou FROM {EV} GROUP BY 1)"


@query("agg_composite", f"""SELECT CAST(sum(hits) AS BIGINT) AS hits, sum(n)::BIGINT AS n, round(sum(hits) / sum(n), 6) AS micro, round(count(*) / sum(1.0 / (hits / n)), 6) AS harmonic,
  round(1.0 / (0.35 / (sum(hits) / sum(n)) + 0.20 / avg(iou) + 0.15 / (sum(hits) / sum(n)) + 0.15 / avg(iou) + 0.15 / max(hits / n)), 6) AS composite FROM {_TIER}""")
def agg_composite(spark: SparkSession, d: str) -> DataFrame:
    """The weighted harmonic composite of totals by tier."""
    g = ev(spark, d).groupBy((c("k") % 5).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("value") > 10).alias("hits"), F.avg(c("value") / 100).alias("iou"))
    recall = F.try_divide(c("hits").cast("double"), c("n"))
    s = g.agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), (F.count(F.lit(1)) / F.sum(1.0 / recall)).alias("harmonic"), F.avg("iou").alias("iou"), F.max(recall).alias("best"))
    micro = c("hits") / c("n")
    return s.select("hits", "n", r6(micro, "micro"), r6(c("harmonic"), "harmonic"), r6(scoring.harmonic([micro, c("iou"), micro, c("iou"), c("best")]), "composite"))


_PTS = "(SELECT l_orderkey AS line, l_linenumber AS i, l_quantity AS x, l_extendedprice / 1000 AS y, l_tax * 100 AS z FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1)"


def trace_points(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as the ordered points of a trace."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return li.select(c("l_orderkey").alias("line"), c("l_linenumber").alias("i"), c("l_quantity").alias("x"), (c("l_extendedprice") / 1000).alias("y"), (c("l_tax") * 100).alias("z"))


@query("agg_arc_length", f"""WITH s AS (SELECT line, i, sqrt(x*x+y*y+z*z) AS r, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS ds FROM {_PTS} WINDOW w AS (PARTITION BY line ORDER BY i))
SELECT line, round(coalesce(sum(ds), 0), 4) AS length, round(max(r), 4) AS l, arg_max(i, r) AS equator, round(any_value(foot), 6) AS foot FROM s JOIN (SELECT line AS fl, degrees(asin(arg_min(z / sqrt(x*x+y*y+z*z), i))) AS foot FROM {_PTS} GROUP BY 1) f ON fl = line GROUP BY 1""")
def agg_arc_length(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("line").orderBy("i")
    step = F.sqrt(sum((F.pow(c(a) - F.lag(a).over(w), F.lit(2.0)) for a in "yz"), F.pow(c("x") - F.lag("x").over(w), F.lit(2.0))))
    s = trace_points(spark, d).withColumn("ds", step).withColumn("r", F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z")))
    return s.groupBy("line").agg(F.round(F.coalesce(F.sum("ds"), F.lit(0.0)), 4).alias("length"), F.round(F.max("r"), 4).alias("l"), F.max_by("i", "r").alias("equator"), r6(F.degrees(F.asin(F.min_by(c("z") / c("r"), "i"))), "foot"))


@query("agg_conj_lat", f"SELECT line, CASE WHEN min(abs(r - 30)) <= 0.5 THEN round(arg_min(lat, abs(r - 30)), 6) END AS lat FROM (SELECT line, sqrt(x*x+y*y+z*z) AS r, degrees(asin(z / sqrt(x*x+y*y+z*z))) AS lat FROM {_PTS}) GROUP BY 1")
def agg_conj_lat(spark: SparkSession, d: str) -> DataFrame:
    """Latitude of the point nearest to a radius; null if none comes within one half."""
    p = trace_points(spark, d).withColumn("r", F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z")))
    gap, lat = F.abs(c("r") - 30), F.degrees(F.asin(c("z") / c("r")))
    return p.groupBy("line").agg(F.when(F.min(gap) <= 0.5, r6(F.min_by(lat, gap), "lat")).alias("lat"))


@query("agg_sign_changes", f"""WITH a AS (SELECT seg, i, sign(v - lag(v) OVER (PARTITION BY seg ORDER BY i)) AS s FROM {SIG}), b AS (SELECT seg, s, lag(s) OVER (PARTITION BY seg ORDER BY i) AS p FROM a WHERE s <> 0)
SELECT seg, count(*) FILTER (WHERE s <> p) AS n FROM b GROUP BY 1""")
def agg_sign_changes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("seg").orderBy("i")
    a = signal(spark, d).withColumn("s", F.signum(c("v") - F.lag("v").over(w))).filter("s <> 0")
    return a.withColumn("p", F.lag("s").over(w)).groupBy("seg").agg(F.count_if(c("s") != c("p")).alias("n"))

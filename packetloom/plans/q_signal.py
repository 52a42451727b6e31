"""Queries of the spectral, wavelet and tracing operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import coords
from packetloom.functions.bands import polarization_class
from packetloom.operators import signal as sg
from packetloom.operators import stats, tracing
from packetloom.operators.ordered import numbered, stride
from packetloom.plans.q_stats import SIG, signal
from packetloom.plans.registry import ev, pos, query, table
from packetloom.session import scratch, staged

c = F.col
DT = 60.0


def _dft(n: int, step: int, average: bool) -> str:
    frames = (64 - n) // step + 1
    dft = f"""SELECT seg, fr, kf, pow(sum(v * w * cos(2 * pi() * kf * j / {n})), 2) + pow(sum(v * w * sin(2 * pi() * kf * j / {n})), 2) AS p FROM (
  SELECT seg, fr, i - fr * {step} AS j, v, 0.5 - 0.5 * cos(2 * pi() * (i - fr * {step}) / {n}) AS w FROM {SIG}, range(0, {frames}) f(fr) WHERE i >= fr * {step} AND i < fr * {step} + {n}), range(0, {n // 2 + 1}) k(kf) GROUP BY 1, 2, 3"""
    scale = f"p * CASE WHEN kf IN (0, {n // 2}) THEN 1 ELSE 2 END * {DT} / {0.375 * n}"
    return f"SELECT seg, kf AS f, round(avg({scale}), 5) AS psd FROM ({dft}) GROUP BY 1, 2" if average else f"SELECT seg, fr AS t, kf AS f, round({scale}, 5) AS psd FROM ({dft})"


def psd(spark: SparkSession, d: str) -> DataFrame:
    def one(v: np.ndarray) -> pd.DataFrame:
        f, p = sg.welch(v, DT, 32)
        return pd.DataFrame({"f": np.arange(len(f)), "freq": f, "psd": p})

    return sg.per_segment(signal(spark, d), "seg", "i", ["v"], one, "f bigint, freq double, psd double")


@query("sig_welch", _dft(32, 16, True))
def sig_welch(spark: SparkSession, d: str) -> DataFrame:
    return psd(spark, d).select("seg", "f", F.round("psd", 5).alias("psd"))


@query("sig_spectrogram", _dft(16, 16, False))
def sig_spectrogram(spark: SparkSession, d: str) -> DataFrame:
    def one(v: np.ndarray) -> pd.DataFrame:
        f, p = sg.spectra(v, DT, 16, 0)
        return pd.DataFrame({"t": np.repeat(np.arange(len(p)), len(f)), "f": np.tile(np.arange(len(f)), len(p)), "psd": p.ravel()})

    return sg.per_segment(signal(spark, d), "seg", "i", ["v"], one, "t bigint, f bigint, psd double").withColumn("psd", F.round("psd", 5))


SAMPLES = 1536  # of a segment


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's values at their place: 72 vectors are a segment of 1536 samples in three components (seg, comp, i, v)."""
    e = table(spark, d, "embeddings").select(F.floor(c("vec_id") / 72).alias("seg"), (c("vec_id") % 3).alias("comp"), (F.floor(c("vec_id") % 72 / 3) * 64).alias("at"), F.posexplode("embedding").alias("j", "v"))
    return e.select("seg", "comp", (c("at") + c("j")).alias("i"), c("v").cast("double").alias("v"))


def waves(spark: SparkSession, d: str) -> DataFrame:
    """The segments with their components side by side: (seg, i, p, a, b); a component that ends early is zero from there."""
    return _placed(spark, d).groupBy("seg", "i").agg(*[F.coalesce(F.max(F.when(c("comp") == k, c("v"))), F.lit(0.0)).alias(n) for k, n in enumerate("pab")])


def regions(spark: SparkSession, d: str) -> DataFrame:
    """(seg, region): the label of each segment's first vector."""
    e = table(spark, d, "embeddings").select(F.floor(c("vec_id") / 72).alias("seg"), "vec_id", "label")
    return e.groupBy("seg").agg(F.min_by("label", "vec_id").cast("double").alias("region"))


# the same in SQL: components in rows and side by side
PLACED = "(SELECT vec_id // 72 AS seg, vec_id % 3 AS comp, vec_id % 72 // 3 * 64 + r.j - 1 AS i, CAST(embedding[r.j] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(j))"
WAVES = "(SELECT seg, i, {} FROM {} GROUP BY 1, 2)".format(", ".join(f"coalesce(max(CASE WHEN comp = {k} THEN v END), 0) AS {n}" for k, n in enumerate("pab")), PLACED)


def _wave(name: str, values: list[str], one, schema: str):
    """Register a grouped-map query over the wave segments: its result is rows of each segment's own samples."""
    query(name)(lambda spark, d: sg.per_segment(waves(spark, d), "seg", "i", values, one, schema))


def each_component(spark: SparkSession, d: str, one, schema: str) -> DataFrame:
    """``one`` on every component of every segment: (seg, comp, its columns)."""
    x = _placed(spark, d).select((c("seg") * 3 + c("comp")).alias("key"), "i", "v")
    out = sg.per_segment(x, "key", "i", ["v"], one, schema)
    name = F.element_at(F.array(*[F.lit(n) for n in "pab"]), (c("key") % 3 + 1).cast("int"))
    return out.select(F.floor(c("key") / 3).alias("seg"), name.alias("comp"), *[x for x in out.columns if x != "key"])


def _each(name: str, one, schema: str):
    """Register a grouped-map query over every component by itself."""
    query(name)(lambda spark, d: each_component(spark, d, one, schema))


def _background(v: np.ndarray) -> pd.DataFrame:
    f, p = sg.welch(v, DT, 512)
    return pd.DataFrame({"f": f[1:], "psd": p[1:], "background": sg.background(f[1:], p[1:], 51)})


_each("sig_background", _background, "f double, psd double, background double")


def _ratio(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    f = sg.welch(a, DT, 512)[0][1:]
    each = [sg.welch(x, DT, 512)[1][1:] for x in (p, a, b)]
    bg = sg.background(f, sum(each), 51)
    return pd.DataFrame({"f": f, "par": each[0] / bg, "perp1": each[1] / bg, "perp2": each[2] / bg, "total": sum(each) / bg})


_RATIO = "f double, par double, perp1 double, perp2 double, total double"
_wave("sig_power_ratio", ["p", "a", "b"], _ratio, _RATIO)


def _analyze(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Detrended by a three-hour mean, then spectra over their background."""
    flat = [x - np.convolve(np.pad(x, 90, mode="edge"), np.ones(181) / 181, mode="valid") for x in (p, a, b)]
    return _ratio(*flat)


_wave("sig_analyze", ["p", "a", "b"], _analyze, _RATIO)
_SMOOTH = ", ".join(f"({k - 10}, {float(w)!r})" for k, w in enumerate(np.linalg.pinv(np.vander(np.arange(-10, 11), 4, increasing=True))[0]))


@query("sig_savgol", f"""WITH x AS (SELECT *, max(i) OVER (PARTITION BY seg, comp) AS last FROM {PLACED})
SELECT a.seg, ['p', 'a', 'b'][a.comp + 1] AS comp, a.i, round(sum(k.w * b.v), 6) + 0.0 AS s FROM x a CROSS JOIN (VALUES {_SMOOTH}) k(o, w) JOIN x b ON b.seg = a.seg AND b.comp = a.comp AND b.i = greatest(0, least(a.last, a.i + k.o)) GROUP BY ALL""")
def sig_savgol(spark: SparkSession, d: str) -> DataFrame:
    """Third-degree smoothing over 21 samples."""
    one = lambda v: pd.DataFrame({"i": np.arange(len(v)), "s": sg.savgol(v, 21, 3)})
    return each_component(spark, d, one, "i bigint, s double").withColumn("s", F.round("s", 6) + F.lit(0.0))




def _cwt(v: np.ndarray) -> pd.DataFrame:
    f, w = sg.morlet(v, DT, 500)  # masks and coherence have 300 rows
    return pd.DataFrame({"f": f, "mean_power": np.mean(np.abs(w) ** 2, axis=1), "top": np.argmax(np.abs(w), axis=1)})


_each("sig_cwt", _cwt, "f double, mean_power double, top bigint")


@query("sig_xcorr", f"SELECT a.seg, CAST(l AS INTEGER) AS lag, round(sum(a.v * b.v), 5) AS r FROM {SIG} a, range(-5, 6) r(l), {SIG} b WHERE b.seg = a.seg AND b.i = a.i + l GROUP BY 1, 2")
def sig_xcorr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation at bounded lags by a join on the shifted place."""
    a = signal(spark, d).select("seg", "i", "v").withColumn("lag", F.explode(F.sequence(F.lit(-5), F.lit(5))))
    b = signal(spark, d).select(c("seg").alias("s"), c("i").alias("j"), c("v").alias("u"))
    j = a.join(b, (c("s") == c("seg")) & (c("j") == c("i") + c("lag")))
    return j.groupBy("seg", "lag").agg(F.round(F.sum(c("v") * c("u")), 5).alias("r"))


def _phase(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(sg.running_phase(a, b, 240, 60, 60.0), columns=["i", "phase"])


_LAGGED = f"""w AS (SELECT seg, i, a, b, n, s.first FROM (SELECT *, max(i) OVER (PARTITION BY seg) + 1 AS n FROM {WAVES}), range(0, 1536, 60) s(first) WHERE i >= s.first AND i < s.first + 240 AND s.first + 240 <= n),
z AS (SELECT seg, first, i, a - avg(a) OVER (PARTITION BY seg, first) AS a, b - avg(b) OVER (PARTITION BY seg, first) AS b FROM w),
r AS (SELECT x.seg, x.first, x.i - y.i AS lag, sum(x.a * y.b) AS r FROM z x JOIN z y ON x.seg = y.seg AND x.first = y.first GROUP BY 1, 2, 3)"""


@query("win_running_phase", f"""WITH {_LAGGED}, t AS (SELECT seg, CAST(first AS BIGINT) AS i, ((arg_max(lag, r) * 6.0) % 360 + 360) % 360 AS p FROM r GROUP BY 1, 2)
SELECT seg, i, CAST(p AS DOUBLE) AS phase, CASE WHEN abs(p - 90) < 30 OR abs(p - 270) < 30 THEN 'circular' WHEN p < 30 OR abs(p - 180) < 30 OR p > 330 THEN 'linear' ELSE 'mixed' END AS class FROM t""")
def win_running_phase(spark: SparkSession, d: str) -> DataFrame:
    out = sg.per_segment(waves(spark, d), "seg", "i", ["a", "b"], _phase, "i bigint, phase double")
    return out.withColumn("class", polarization_class(c("phase")))


def _hilbert(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    t = sg.tukey(len(a))
    rows = [(k, *s, *sg.geometry(*s)) for k, s in (("plain", sg.stokes(sg.analytic(a), sg.analytic(b))), ("tapered", sg.stokes(sg.analytic(a * t), sg.analytic(b * t))))]
    return pd.DataFrame(rows, columns=["kind", "si", "sq", "su", "sv", "ellipticity", "inclination", "fraction"])


_wave("sig_hilbert_stokes", ["a", "b"], _hilbert, "kind string, si double, sq double, su double, sv double, ellipticity double, inclination double, fraction double")


def _percycle(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    za, zb = sg.analytic(sg.bandpass(a, 1 / 7200, 1 / 1800, DT)), sg.analytic(sg.bandpass(b, 1 / 7200, 1 / 1800, DT))
    ell = [sg.geometry(*sg.stokes(za[k : k + 60], zb[k : k + 60]))[0] for k in range(0, len(a) - 59, 60)]
    q1, q2, q3 = np.percentile(ell, (25, 50, 75))
    return pd.DataFrame({"median": [q2], "iqr": [q3 - q1], "cycles": [len(ell)]})


_wave("sig_percycle_ell", ["a", "b"], _percycle, "median double, iqr double, cycles bigint")
_each("sig_bandpass", lambda v: pd.DataFrame({"i": np.arange(len(v)), "s": sg.bandpass(v, 1 / 7200, 1 / 1800, DT)}), "i bigint, s double")
_each("sig_envelope", lambda v: pd.DataFrame({"i": np.arange(len(v)), "s": np.abs(sg.analytic(sg.bandpass(v, 1 / 7200, 1 / 1800, DT)))}), "i bigint, s double")


def _band_frequency(v: np.ndarray) -> np.ndarray:
    phase = np.unwrap(np.angle(sg.analytic(sg.bandpass(v, 1 / 7200, 1 / 1800, DT))))
    return np.gradient(phase, DT) / (2 * np.pi)


def _frequency(v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"median_hz": [float(np.median(_band_frequency(v)))]}) if len(v) >= 8 else pd.DataFrame({"median_hz": []})


def _drift(v: np.ndarray) -> pd.DataFrame:
    """Linear trend of the instantaneous frequency, held to half the band's lower and twice its upper edge; none below 8 samples."""
    if len(v) < 8:
        return pd.DataFrame({"hz_per_s": [0.0], "start_hz": [None]})
    f = np.clip(_band_frequency(v), 0.5 / 7200, 2 / 1800)
    slope, level = np.polyfit(np.arange(len(f)) * DT, f, 1)
    return pd.DataFrame({"hz_per_s": [float(slope)], "start_hz": [float(level)]})


_each("sig_inst_freq", _frequency, "median_hz double")
_each("sig_drift", _drift, "hz_per_s double, start_hz double")


@query("sig_phase_shift", f"""WITH z AS (SELECT seg, i, a - avg(a) OVER (PARTITION BY seg) AS a, b - avg(b) OVER (PARTITION BY seg) AS b FROM {WAVES}), r AS (SELECT x.seg, x.i - y.i AS lag, sum(x.a * y.b) AS r FROM z x JOIN z y ON x.seg = y.seg GROUP BY 1, 2)
SELECT seg, arg_max(lag, r) * 60.0::DOUBLE AS delay_sec, CAST(((arg_max(lag, r) * 6.0) % 360 + 360) % 360 AS DOUBLE) AS phase_deg FROM r GROUP BY 1""")
def sig_phase_shift(spark: SparkSession, d: str) -> DataFrame:
    """Delay and phase between the transverse components, at an hour's period."""
    one = lambda a, b: pd.DataFrame([sg.phase_shift(a, b, DT, 3600.0)], columns=["delay_sec", "phase_deg"])
    return sg.per_segment(waves(spark, d), "seg", "i", ["a", "b"], one, "delay_sec double, phase_deg double")


_ENV = f"(SELECT seg, i, abs(v) AS x, max(abs(v)) OVER (PARTITION BY seg) AS hi, min(abs(v)) OVER (PARTITION BY seg) AS lo, arg_max(i, abs(v)) OVER (PARTITION BY seg) AS pk FROM {SIG})"


@query("sig_rise_fall", f"""WITH e AS (SELECT *, lo + 0.1 * (hi - lo) AS l10, lo + 0.9 * (hi - lo) AS l90 FROM {_ENV}),
g AS (SELECT seg, any_value(pk) AS pk, min(i) FILTER (WHERE i <= pk AND x >= l10) AS u10, min(i) FILTER (WHERE i <= pk AND x >= l90) AS u90, min(i) FILTER (WHERE i >= pk AND x <= l90) AS d90, min(i) FILTER (WHERE i >= pk AND x <= l10) AS d10, max(i) AS top FROM e GROUP BY 1 HAVING any_value(pk) > 0 AND any_value(pk) < max(i) AND any_value(hi) > any_value(lo))
SELECT seg, CAST(greatest(u90 - u10, 1) * 60 AS BIGINT) AS rise, CAST(CASE WHEN d90 IS NULL THEN top - pk WHEN d10 IS NULL THEN top + 1 - d90 ELSE greatest(d10 - d90, 1) END * 60 AS BIGINT) AS fall FROM g""")
def sig_rise_fall(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from 10 to 90 % of an envelope's span before its peak, and back after it; none for a peak at an end or a flat envelope."""
    w = Window.partitionBy("seg")
    s = signal(spark, d).select("seg", c("i").cast("long").alias("i"), F.abs("v").alias("x"))
    s = s.select("*", F.max("x").over(w).alias("hi"), F.min("x").over(w).alias("lo"), F.max_by("i", "x").over(w).alias("pk"))
    level = lambda k: c("lo") + F.lit(k) * (c("hi") - c("lo"))
    first = lambda cond: F.min(F.when(cond, c("i")))
    up, down = c("i") <= c("pk"), c("i") >= c("pk")
    g = s.groupBy("seg").agg(
        F.max("pk").alias("pk"), F.max("i").alias("top"), (F.max("hi") > F.max("lo")).alias("ok"), first(up & (c("x") >= level(0.1))).alias("u10"), first(up & (c("x") >= level(0.9))).alias("u90"),
        first(down & (c("x") <= level(0.9))).alias("d90"), first(down & (c("x") <= level(0.1))).alias("d10"),
    )
    fall = F.when(c("d90").isNull(), c("top") - c("pk")).when(c("d10").isNull(), c("top") + 1 - c("d90")).otherwise(F.greatest(c("d10") - c("d90"), F.lit(1)))
    return g.filter((c("pk") > 0) & (c("pk") < c("top")) & c("ok")).select("seg", (F.greatest(c("u90") - c("u10"), F.lit(1)) * 60).cast("long").alias("rise"), (fall * 60).cast("long").alias("fall"))


@query("sig_harmonic", f"""WITH p AS (SELECT seg, kf, pow(sum(v * w * cos(2 * pi() * kf * i / 64)), 2) + pow(sum(v * w * sin(2 * pi() * kf * i / 64)), 2) AS p FROM (SELECT seg, i, v, 0.5 - 0.5 * cos(2 * pi() * i / 64) AS w FROM {SIG}), range(6, 19) k(kf) GROUP BY 1, 2)
SELECT seg, round(sum(p) FILTER (WHERE kf BETWEEN 14 AND 18) / sum(p) FILTER (WHERE kf BETWEEN 6 AND 10), 4) AS ratio FROM p GROUP BY 1""")
def sig_harmonic(spark: SparkSession, d: str) -> DataFrame:
    """Power about twice a frequency over that about it, from a transform at those bins only."""
    turn = 2 * 3.141592653589793 / 64
    s = signal(spark, d).withColumn("w", c("v") * (0.5 - 0.5 * F.cos(c("i") * turn))).withColumn("k", F.explode(F.sequence(F.lit(6), F.lit(18))))
    p = s.groupBy("seg", "k").agg(F.sum(c("w") * F.cos(c("k") * c("i") * turn)).alias("x"), F.sum(c("w") * F.sin(c("k") * c("i") * turn)).alias("y"))
    power = c("x") * c("x") + c("y") * c("y")
    near = lambda a, b: F.sum(F.when(c("k").between(a, b), power))
    return p.groupBy("seg").agg(F.round(near(14, 18) / near(6, 10), 4).alias("ratio"))


@query("sig_growth", f"WITH r AS (SELECT seg, i // 8 AS cyc, sqrt(avg(v * v)) AS rms FROM {SIG} GROUP BY 1, 2) SELECT seg, round(regr_slope(20 * log10(rms), cyc), 5) AS growth FROM r GROUP BY 1")
def sig_growth(spark: SparkSession, d: str) -> DataFrame:
    """Decibels per cycle."""
    r = signal(spark, d).groupBy("seg", F.floor(c("i") / 8).alias("cyc")).agg(F.sqrt(F.avg(c("v") * c("v"))).alias("rms"))
    return r.groupBy("seg").agg(F.round(F.regr_slope(20 * F.log10("rms"), "cyc"), 5).alias("growth"))


@query("sig_cycle_coh", f"WITH r AS (SELECT a.seg, a.i // 8 AS cyc, corr(a.v, b.v) AS r FROM {SIG} a JOIN {SIG} b ON a.seg = b.seg AND b.i = a.i + 8 GROUP BY 1, 2) SELECT seg, round(avg(r), 5) AS coherence FROM r GROUP BY 1")
def sig_cycle_coh(spark: SparkSession, d: str) -> DataFrame:
    """Mean correlation of each cycle with the next."""
    s = signal(spark, d).withColumn("u", F.lead("v", 8).over(Window.partitionBy("seg").orderBy("i"))).filter("u IS NOT NULL")
    r = s.groupBy("seg", F.floor(c("i") / 8).alias("cyc")).agg(F.corr("v", "u").alias("r"))
    return r.groupBy("seg").agg(F.round(F.avg("r"), 5).alias("coherence"))


def _coherence(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    (f, wa), (_, wb) = sg.morlet(a, DT), sg.morlet(b, DT)
    coh, phase = sg.wavelet_coherence(wa, wb, f, DT)
    mean = np.angle(np.mean(np.exp(1j * phase) * coh, axis=1))
    return pd.DataFrame({"f": f, "coherence": coh.mean(axis=1), "phase": mean})


_wave("sig_coherence", ["a", "b"], _coherence, "f double, coherence double, phase double")


def _matched(v: np.ndarray) -> pd.DataFrame:
    snr = sg.matched(v, 3600.0, 4.0, DT)
    return pd.DataFrame({"peak": [float(snr.max())], "at": [int(snr.argmax())], "median": [float(np.median(snr))]})


_each("sig_matched", _matched, "peak double, at bigint, median double")


def _masked(kind: str):
    def one(v: np.ndarray) -> pd.DataFrame:
        f, w = sg.morlet(v, DT)
        amp = np.abs(w)
        m = sg.mask_mad(amp, f, sg.sigma_for(f, len(v), DT)) if kind == "mad" else (sg.mask_chi2 if kind == "chi2" else sg.mask_fdr)(amp, f, v, DT)
        return pd.DataFrame({"f": f, "cells": m.sum(axis=1)})

    return one


for _kind in ("mad", "chi2", "fdr"):
    _each(f"sig_mask_{_kind}", _masked(_kind), "f double, cells bigint")


def _noise(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Median and MAD of the noise rows' transverse amplitude, the geometric mean of both components."""
    (f, wa), (_, wb) = sg.morlet(a, DT), sg.morlet(b, DT)
    rows = sg.noise_rows(f)
    amp = np.sqrt(np.abs(wa[rows]) * np.abs(wb[rows]) + 1e-30)
    med = np.median(amp, axis=1)
    return pd.DataFrame({"f": f[rows], "med": med, "mad": np.median(np.abs(amp - med[:, None]), axis=1)})


def noise_archive(spark: SparkSession, d: str) -> DataFrame:
    """The stored archive (region, f, med, mad): medians over all segments of a region."""
    path = scratch(spark, "archive")
    x = sg.per_segment(waves(spark, d), "seg", "i", ["a", "b"], _noise, "f double, med double, mad double").join(regions(spark, d), "seg")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), c(n).alias("x")) for n in ("med", "mad")])).alias("e")
    mid = stats.quantiles(x.select("region", "f", each).select("region", "f", "e.*"), c("x"), ["region", "f", "what"], {"mid": 0.5})
    mid.groupBy("region", "f").agg(*[F.max(F.when(c("what") == n, c("mid"))).alias(n) for n in ("med", "mad")]).write.parquet(path)
    return spark.read.parquet(path)


@query("sig_mask_pooled")
def sig_mask_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the transverse amplitude above the stored noise of the segment's region."""
    rows = sorted(noise_archive(spark, d).collect(), key=lambda r: r.f)  # noise rows by region: neither grows with the segments
    archive = {k: tuple(np.array([r[n] for r in rows if r.region == k]) for n in ("f", "med", "mad")) for k in {r.region for r in rows}}
    archive = {k: (1 / f, med, mad) for k, (f, med, mad) in archive.items()}

    def one(a: np.ndarray, b: np.ndarray, region: np.ndarray) -> pd.DataFrame:
        (f, wa), (_, wb) = sg.morlet(a, DT), sg.morlet(b, DT)
        m = sg.mask_pooled(np.sqrt(np.abs(wa) * np.abs(wb) + 1e-30), f, archive, region[0], sg.sigma_for(f, len(a), DT))
        return pd.DataFrame({"f": f, "cells": m.sum(axis=1)})

    return sg.per_segment(waves(spark, d).join(regions(spark, d), "seg"), "seg", "i", ["a", "b", "region"], one, "f double, cells bigint")


@query("sig_bonferroni")
def sig_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """Independent cells and the matching number of deviations for each segment's length."""
    from statistics import NormalDist

    n = waves(spark, d).groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    f0, f1 = 1 / 14400, 0.5 / DT
    cells = F.greatest(F.lit(1.0), c("n") * (DT * sg.OMEGA0 / (2 * 3.141592653589793) * (f1 - f0)))
    quantile = F.pandas_udf(lambda v: pd.Series([NormalDist().inv_cdf(1 - sg.FWER / x) for x in v]), "double")
    return n.select("seg", "n", cells.alias("cells"), quantile(cells).alias("n_sigma"))


def _ridges(split: bool):
    def one(v: np.ndarray) -> pd.DataFrame:
        f, w = sg.morlet(v, DT)
        amp = np.abs(w)
        found = sg.ridges(amp, f, sg.mask_chi2(amp, f, v, DT), DT, edge=sg.coi(f, len(v), DT), split=split)
        names = ["i0", "i1", "i", "period", "power", "fwhm", "pixels"]
        return pd.DataFrame([[r[n] for n in names] for r in found], columns=names)

    return one


_RIDGE = "i0 bigint, i1 bigint, i bigint, period double, power double, fwhm double, pixels bigint"
_each("sig_ridges", _ridges(False), _RIDGE)
_each("sig_ridge_split", _ridges(True), _RIDGE)


@query("sig_packets")
def sig_packets(spark: SparkSession, d: str) -> DataFrame:
    from packetloom.functions.bands import band_of

    return each_component(spark, d, _ridges(True), _RIDGE).withColumn("band", band_of(c("period")))


def _detect(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(sg.detect(p, a, b, DT), columns=sg.EVENT_NAMES)


def detections(spark: SparkSession, d: str) -> DataFrame:
    return sg.per_segment(waves(spark, d), "seg", "i", ["p", "a", "b"], _detect, sg.EVENT_SCHEMA)


@query("sig_detect")
def sig_detect(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d)


@query("sig_sweep")
def sig_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All segments: valid ones detected, peaks of the owned window kept under the amplitude cap, enriched at their peak, numbered by time."""
    w = waves(spark, d)
    valid = w.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).filter("n >= 1080").select("seg")
    found = sg.per_segment(w.join(valid, "seg", "left_semi"), "seg", "i", ["p", "a", "b"], _detect, sg.EVENT_SCHEMA)
    own = found.filter((c("i") >= 256) & (c("i") < 1280) & (F.greatest("amp_par", "amp1", "amp2") <= 10))
    own = own.withColumn("t", c("seg") * SAMPLES + c("i")).withColumn("vec_id", c("seg") * 72 + F.floor(c("i") / 64) * 3)
    at = w.select("seg", "i", c("p").alias("b_par"), c("a").alias("b_perp1"), c("b").alias("b_perp2"), F.sqrt(c("p") * c("p") + c("a") * c("a") + c("b") * c("b")).alias("size"))
    own = own.join(at, ["seg", "i"]).join(table(spark, d, "embeddings").select("vec_id", c("label").alias("region")), "vec_id", "left").drop("vec_id")
    return numbered(own, ["t", "period_sec"], "event_id")


@query("sig_peak_sigma")
def sig_peak_sigma(spark: SparkSession, d: str) -> DataFrame:
    """Deviations of each detected event's transverse amplitudes above the noise at its period, within its own window."""

    def one(events: pd.DataFrame, series: pd.DataFrame) -> pd.DataFrame:
        out, series = [], series.sort_values("i")
        if len(events) and len(series):
            amps = {n: sg.morlet(series[n].to_numpy(), DT) for n in "ab"}
            for x in events.itertuples(index=False):
                each = [sg.sigma_at(np.abs(w), f, x.period_sec, int(x.i0), int(x.i1)) for f, w in amps.values()]
                out.append((x.seg, x.i, x.period_sec, *each))
        return pd.DataFrame(out, columns=["seg", "i", "period_sec", "sigma1", "sigma2"])

    by = lambda df: df.groupBy("seg")
    return by(detections(spark, d)).cogroup(by(waves(spark, d))).applyInPandas(one, "seg bigint, i bigint, period_sec double, sigma1 double, sigma2 double")


@query("sig_event_psd")
def sig_event_psd(spark: SparkSession, d: str) -> DataFrame:
    """Spectra of the components within twelve hours of each segment's largest transverse sample, lines removed, by period; at least 64 samples."""

    def one(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        at = int(np.argmax(np.hypot(a, b)))
        lo, hi = max(0, at - 720), min(len(a), at + 721)
        if hi - lo < 64:
            return pd.DataFrame({"at": [], "period_min": [], "par": [], "perp1": [], "perp2": []})
        x = np.arange(hi - lo)
        f, each = None, []
        for v in (p[lo:hi], a[lo:hi], b[lo:hi]):
            f, psd_of = sg.welch(v - np.polyval(np.polyfit(x, v, 1), x), DT, 720)
            each.append(psd_of[:0:-1])
        return pd.DataFrame({"at": at, "period_min": 1 / f[:0:-1] / 60, **dict(zip(("par", "perp1", "perp2"), each, strict=True))})

    return sg.per_segment(waves(spark, d), "seg", "i", ["p", "a", "b"], one, "at bigint, period_min double, par double, perp1 double, perp2 double")


def positions(spark: SparkSession, d: str) -> DataFrame:
    return pos(spark, d).select("id", "n", "t", "x", "y", "z")


@query("enr_trace_dipole")
def enr_trace_dipole(spark: SparkSession, d: str) -> DataFrame:
    """Both footpoints and the apex of every position's line, with the closed form beside them."""
    out = tracing.enrich(positions(spark, d))
    return out.withColumn("analytic", coords.invariant_latitude(c("x"), c("y"), c("z"), 0.0))


@query("enr_invlat")
def enr_invlat(spark: SparkSession, d: str) -> DataFrame:
    """Invariant latitude of every fifth sample of a region, signed by hemisphere."""
    part = stride(positions(spark, d), 5, ["id"], ["t", "n", "x", "y", "z"])
    out = tracing.enrich(part)
    return out.select("id", "n", F.when(c("z") < 0, c("lat_south")).otherwise(c("lat_north")).alias("inv_lat"), "apex", "closed")


@query("enr_footpoint")
def enr_footpoint(spark: SparkSession, d: str) -> DataFrame:
    """Share of closed lines and mean footpoint latitude by shell."""
    out = tracing.enrich(positions(spark, d))
    return out.groupBy(F.floor("apex").alias("shell")).agg(F.count(F.lit(1)).alias("n"), F.avg(c("closed").cast("double")).alias("closed"), F.avg("lat_north").alias("lat_north"), F.avg("lat_south").alias("lat_south"))


@query("enr_peak_trace")
def enr_peak_trace(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the traced line of the sample nearest in time; of samples at one time the first by id and number."""
    from packetloom.operators.joins import nearest

    first = F.min_by(F.struct("x", "y", "z"), F.struct("id", "n")).alias("p")
    samples = pos(spark, d).filter("t IS NOT NULL").groupBy(c("t").alias("ct")).agg(first).select("ct", "p.x", "p.y", "p.z")  # one row a day
    # a sample that is nearest to many events is traced once
    traced = staged(tracing.enrich(samples).select("ct", F.when(c("z") < 0, c("lat_south")).otherwise(c("lat_north")).alias("inv_lat"), "apex", "closed"), "traced")
    return nearest(ev(spark, d).select("event_id", "t"), traced, "t", "ct").select("event_id", "inv_lat", "apex", "closed")

"""Summaries: separations, densities, circular and rank statistics, spectra fits."""

from __future__ import annotations

from math import pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators import joins
from packetloom.operators.joins import intervals
from packetloom.operators.ordered import _same, cumulated
from packetloom.session import staged

#: Accuracy of the sketches that bracket a quantile: a rank is off by one part in so many at most.
SKETCH = 1000
#: Values of all keys together that an aggregate may buffer.
FEW = 1_000_000


def separations(events: DataFrame, t: str, most_hours: float, keys: list[str] | None = None) -> DataFrame:
    """Hours between consecutive events, of 0 < gap <= ``most_hours``."""
    if keys:
        gap = (F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))) / 3600.0
        hours = events.select(*keys, gap.alias("hours"))
    else:
        hours = intervals(events.select(F.col(t).alias("at_time")), "at_time").select(((F.col("hi") - F.col("lo")) / 3600.0).alias("hours"))
    return hours.filter((F.col("hours") > 0) & (F.col("hours") <= most_hours))


def separation_stats(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, median, mean, std, n) of the gaps; of no gaps at all without keys one row of zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    own = keys or ["every"]
    x = hours if keys else hours.withColumn("every", F.lit(1))
    g = x.groupBy(*own).agg(F.avg("hours").alias("mean"), F.stddev_pop("hours").alias("std"), F.count("hours").alias("n"))
    mid = quantiles(x, F.col("hours"), own, {"median": 0.5}).select(*[F.col(c).alias(f"of_{c}") for c in own], "median")
    g = g.join(mid, _same(own, "of_"), "left").select(*own, zero(F.col("median")).alias("median"), zero(F.col("mean")).alias("mean"), zero(F.col("std")).alias("std"), "n")
    if keys:
        return g
    one = hours.sparkSession.range(1).select(F.lit(1).alias("every"))
    return one.join(g, "every", "left").select(zero(F.col("median")).alias("median"), zero(F.col("mean")).alias("mean"), zero(F.col("std")).alias("std"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(values: DataFrame, v: str, lo: float, hi: float, n: int) -> DataFrame:
    """Counts and density on every bin; the last bin holds its right edge."""
    k = F.least(F.floor((F.col(v) - lo) / (hi - lo) * n), F.lit(n - 1)).cast("int")
    got = values.filter((F.col(v) >= lo) & (F.col(v) <= hi)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = values.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    out = spine.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per bin
    return out.withColumn("density", F.coalesce(F.try_divide(F.col("n").cast("double"), total * ((hi - lo) / n)), F.lit(0.0)))


def kde(values: DataFrame, v: str, lo: float, hi: float, points: int, bandwidth: float) -> DataFrame:
    """Gaussian density on a grid; the bandwidth is a factor of the sample's deviation.

    Values are counted first, so each grid point meets each distinct value once.
    """
    s = values.agg(F.stddev_samp(v).alias("s"), F.count(v).alias("n")).first()  # one row
    h = bandwidth * (s.s or 1.0)
    counted = values.filter(F.col(v).isNotNull()).groupBy(v).agg(F.count(F.lit(1)).alias("m"))
    step, reach = (hi - lo) / (points - 1), 9 * h  # beyond nine deviations the kernel is nil to double precision
    first = F.greatest(F.ceil((F.col(v) - reach - lo) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col(v) + reach - lo) / step), F.lit(points - 1)).cast("int")
    at = counted.withColumn("first", first).withColumn("last", last).filter("first <= last").withColumn("i", F.explode(F.sequence("first", "last")))
    u = (lo + F.col("i") * step - F.col(v)) / h
    got = at.groupBy("i").agg((F.sum(F.col("m") * F.exp(-0.5 * u * u)) / ((s.n or 1) * h * sqrt(2 * pi))).alias("density"))
    grid = values.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    return grid.join(got, "i", "left").select("i", F.coalesce("density", F.lit(0.0)).alias("density"))


def rayleigh(df: DataFrame, angle: Column, keys: list[str]) -> DataFrame:
    """Mean resultant length and its p-value by the usual second-order approximation."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.cos(angle)).alias("c"), F.sum(F.sin(angle)).alias("s"))
    g = g.withColumn("r", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n"))
    n, z = F.col("n"), F.col("n") * F.col("r") * F.col("r")
    p = F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - F.pow(n * F.col("r"), F.lit(2.0)))) - (1 + 2 * n))
    return g.select(*keys, "n", "r", z.alias("z"), F.least(F.lit(1.0), p).alias("p"))


def quantiles(df: DataFrame, v: Column, keys: list[str], probs: dict[str, float], few: int = FEW) -> DataFrame:
    """Exact quantiles (linear between ranks) and the count ``n`` of each key's values, for keys of any size.

    The values are staged, so what makes them runs once; up to ``few`` of them fit one buffer. Of
    more, a first scan brackets each quantile by mergeable sketches, whose error is bounded; a second
    counts what lies below each bracket and keeps the few values within. Those are counted by
    value, and the ranks about each quantile picked from the counts cumulated over ranges, so no
    task holds the values of a key. Keys without values are left out.
    """
    if any(not 0 <= p <= 1 for p in probs.values()):
        raise ValueError("probabilities lie in [0, 1]")
    rows = staged(df.select(*keys, v.cast("double").alias("value")).filter("value IS NOT NULL"), "values")
    if rows.count() <= few:
        return rows.groupBy(*keys).agg(*[F.percentile("value", p).alias(name) for name, p in probs.items()], F.count(F.lit(1)).alias("n")).filter("n > 0")
    wide = 4.0 / SKETCH  # four times the sketch's greatest error in rank
    at = [max(0.0, min(1.0, p + side)) for p in probs.values() for side in (-wide, wide)]
    own = [F.col(c).alias(f"of_{c}") for c in keys]
    sketch = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", at, SKETCH).alias("cut"))
    short = F.col("n") < SKETCH  # of fewer values the ranks about a quantile are further apart than the sketch's error, so all are kept
    ends = [(F.when(short | F.lit(at[2 * k] <= wide), F.col("least")).otherwise(F.get("cut", F.lit(2 * k))), F.when(short | F.lit(at[2 * k + 1] >= 1 - wide), F.col("most")).otherwise(F.get("cut", F.lit(2 * k + 1)))) for k in range(len(probs))]
    cuts = staged(sketch.select(*[f"of_{c}" for c in keys], "n", F.array(*[F.struct(a.alias("lo"), b.alias("hi")) for a, b in ends]).alias("cut")), "cuts")  # a row per key
    joined = rows.join(cuts, _same(keys, "of_")) if keys else rows.join(F.broadcast(cuts), F.lit(True))  # without keys one row
    lo, hi = [[F.get("cut", F.lit(k))[side] for k in range(len(probs))] for side in ("lo", "hi")]
    within = F.lit(False)
    for a, b in zip(lo, hi, strict=True):
        within = within | ((F.col("value") >= a) & (F.col("value") <= b))
    counted = joined.groupBy(*keys, F.when(within, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("m"), *[F.count_if(F.col("value") < a).alias(f"below_{k}") for k, a in enumerate(lo)])
    counted = staged(counted, "brackets")
    below = counted.groupBy(*own).agg(*[F.sum(f"below_{k}").alias(f"below_{k}") for k in range(len(probs))])
    kept = counted.filter("value IS NOT NULL").select(*keys, "value", "m")
    x = kept.join(cuts, _same(keys, "of_")) if keys else kept.join(F.broadcast(cuts), F.lit(True))
    # one series for each quantile: its bracket's values, from the rank below the bracket on
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("of_prob"), ((F.col("value") >= lo[k]) & (F.col("value") <= hi[k])).alias("ok")) for k in range(len(probs))])).alias("q")
    x = x.select(*keys, "value", "m", "n", each).filter("q.ok").select(*keys, "q.of_prob", "value", "m", "n")
    x = cumulated(x, "value", [*keys, "of_prob"], ["m"], x)
    x = x.join(below, _same(keys, "of_")) if keys else x.join(F.broadcast(below), F.lit(True))
    done = []
    for k, (name, p) in enumerate(probs.items()):
        rank, upto = (F.col("n") - 1) * F.lit(float(p)), F.col("upto_m") + F.col(f"below_{k}")
        holds = lambda r: F.when((F.col("of_prob") == k) & (r >= upto - F.col("m")) & (r < upto), F.col("value"))  # noqa: E731, B023
        done += [F.max(holds(F.floor(rank))).alias(f"{name}_lo"), F.max(holds(F.ceil(rank))).alias(f"{name}_hi")]
    g = x.groupBy(*keys, "n").agg(*done)
    part = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    return g.select(*keys, *[(F.col(f"{m}_lo") + (F.col(f"{m}_hi") - F.col(f"{m}_lo")) * part(p)).alias(m) for m, p in probs.items()], "n")


def median_and_spread(df: DataFrame, v: Column, keys: list[str]) -> DataFrame:
    """(keys, med, mad) of keys that are short rows each, such as those of one segment."""
    x = df.select(*keys, v.alias("x")).withColumn("med", F.percentile("x", 0.5).over(Window.partitionBy(*keys)))
    return x.groupBy(*keys).agg(F.max("med").alias("med"), F.percentile(F.abs(F.col("x") - F.col("med")), 0.5).alias("mad"))


def folded(df: DataFrame, keys: list[str], b: str, n: int) -> DataFrame:
    """Rows per bin 0..n-1 of each key, empty bins too."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(b) == k).alias(f"b{k}") for k in range(n)])
    each = F.posexplode(F.array(*[f"b{k}" for k in range(n)])).alias(b, "n")
    return counts.select(*keys, each)


def paired(df: DataFrame, x: str, y: str, keys: list[str], least: int = 3) -> DataFrame:
    """Rows with both values; ValueError if a key has fewer than ``least`` of them."""
    out = df.dropna(subset=[x, y])
    short = df.groupBy(*keys).agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n")).filter(F.col("n") < least)
    if rows := short.limit(5).collect():
        raise ValueError(f"fewer than {least} rows with both values: {[tuple(r)[:-1] for r in rows]}")
    return out


def ks_distance(df: DataFrame, v: str, group: str, reference: str) -> DataFrame:
    """Largest gap between each group's distribution and the reference group's, however many groups.

    Between two of its values a group's share stands still, so the gap is greatest at one of them
    or just before. The reference's share there is looked up, not copied to each group.
    """
    rows = df.filter(F.col(v).isNotNull() & F.col(group).isNotNull()).select(group, F.col(v).cast("double").alias("v"))
    counted = staged(rows.groupBy(group, "v").agg(F.count(F.lit(1)).alias("n")), "counted")
    ref, others = counted.filter(F.col(group) == reference), counted.filter(F.col(group) != reference)
    total = ref.agg(F.sum("n")).first()[0]
    own = cumulated(others, "v", [group], ["n"], others)
    known = cumulated(ref, "v", [], ["n"], ref).select(F.col("v").alias("rv"), F.col("upto_n").alias("upto_r"), F.col("n").alias("r"))
    x = joins.neighbours(own, known, "v", "rv")
    upto = F.coalesce("before.upto_r", F.lit(0))
    before = upto - F.coalesce(F.when(F.col("before.rv") == F.col("l.v"), F.col("before.r")), F.lit(0))
    share = lambda n, m: F.try_divide(n.cast("double"), m)
    m = F.lit(total).cast("double")
    gap = F.greatest(F.abs(share(F.col("l.upto_n"), F.col("l.all_n")) - share(upto, m)), F.abs(share(F.col("l.upto_n") - F.col("l.n"), F.col("l.all_n")) - share(before, m)))
    return x.groupBy(F.col(f"l.`{group}`").alias(group)).agg(F.max(F.when(m.isNotNull(), gap)).alias("ks"))


def average_ranks(df: DataFrame, v: str, keys: list[str], out: str) -> DataFrame:
    """Ranks from 1 with ties at their mean, per key."""
    counted = staged(df.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("m")), "counted")
    x = cumulated(counted, v, keys, ["m"], counted)
    ranks = x.select(*[F.col(c).alias(f"of_{c}") for c in (*keys, v)], (F.col("upto_m") - (F.col("m") - 1) / 2.0).alias(out))
    return df.join(ranks, _same([*keys, v], "of_")).select(*df.columns, out)


def power_law(df: DataFrame, f: str, p: str, keys: list[str]) -> DataFrame:
    """Slope and intercept of log power on log frequency."""
    x, y = F.ln(F.col(f)), F.ln(F.col(p))
    g = df.filter((F.col(f) > 0) & (F.col(p) > 0)).groupBy(*keys)
    return g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def spectral_slopes(df: DataFrame, f: str, p: str, keys: list[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(keys, name, slope, n): the power law's slope in each named range of frequency, ends included; ranges may overlap."""
    hit = F.array_compact(F.array(*[F.when(F.col(f).between(lo, hi), F.lit(n)) for n, (lo, hi) in bands.items()]))
    return power_law(df.withColumn("name", F.explode(hit)), f, p, [*keys, "name"]).drop("intercept")


def power_law_degree(df: DataFrame, f: str, p: str, keys: list[str], degree: int) -> DataFrame:
    """(keys, coefficients, n): least-squares polynomial of log power over log frequency, lowest power first.

    The sums that the normal equations need are aggregated first, so the fit itself sees one row per key.
    """
    x, y = F.ln(F.col(f)), F.ln(F.col(p))
    sums = [F.sum(F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(F.pow(x, F.lit(float(k))) * y).alias(f"t{k}") for k in range(degree + 1)]
    g = df.filter((F.col(f) > 0) & (F.col(p) > 0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)

    def solved(s: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(s, t, strict=True):
            m = np.array([[a[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            out.append(np.linalg.lstsq(m, np.asarray(b), rcond=None)[0].tolist())
        return pd.Series(out)

    fit = F.pandas_udf(solved, "array<double>")
    return g.select(*keys, fit(F.array(*[f"s{k}" for k in range(2 * degree + 1)]), F.array(*[f"t{k}" for k in range(degree + 1)])).alias("coefficients"), "n")


def stokes(df: DataFrame, re1: Column, im1: Column, re2: Column, im2: Column, keys: list[str]) -> DataFrame:
    """I, Q, U, V averaged over the rows of each key, and the degree of polarisation."""
    a, b = re1 * re1 + im1 * im1, re2 * re2 + im2 * im2
    g = df.groupBy(*keys).agg(
        F.avg(a + b).alias("i"), F.avg(a - b).alias("q"), F.avg(2 * (re1 * re2 + im1 * im2)).alias("u"), F.avg(2 * (im1 * re2 - re1 * im2)).alias("v"),
    )
    p = F.sqrt(F.col("q") * F.col("q") + F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    return g.withColumn("d", F.when(F.col("i") > 0, F.try_divide(p, F.col("i"))).otherwise(0.0))


def ar1(df: DataFrame, v: str, order: str, keys: list[str], clamp: float = 0.99) -> DataFrame:
    """Lag-1 autocorrelation of each key's series about its mean, clamped."""
    every = Window.partitionBy(*keys)
    x = df.withColumn("d", F.col(v) - F.avg(v).over(every))
    x = x.withColumn("before", F.lag("d").over(Window.partitionBy(*keys).orderBy(order)))
    a = F.try_divide(F.sum(F.col("d") * F.col("before")), F.sum(F.col("d") * F.col("d")))
    return x.groupBy(*keys).agg(F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.coalesce(a, F.lit(0.0)))).alias("a"))


def eigenvalues3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix in closed form, ascending."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0))))
    phi = F.acos(r) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * pi / 3)
    return low, 3 * q - high - low, high

"""Period bands, regions and labels as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, least and bounding period in minutes (half-open), centroid in minutes.
BANDS = (("QP15", 10.0, 20.0, 15.0), ("QP30", 20.0, 40.0, 30.0), ("QP60", 40.0, 80.0, 60.0), ("QP120", 80.0, 160.0, 120.0))
REJECT_BELOW_S = 600.0
REJECT_FROM_S = 43200.0
#: Region codes.
REGIONS = {0: "magnetosphere", 1: "magnetosheath", 2: "solar_wind", 9: "unknown"}


def band_of(period_s: Column) -> Column:
    """Band of a period in seconds; null outside all bands or in a rejected range."""
    out = F.when((period_s < REJECT_BELOW_S) | (period_s >= REJECT_FROM_S), F.lit(None).cast("string"))
    for name, lo, hi, _ in BANDS:
        out = out.when((period_s >= lo * 60) & (period_s < hi * 60), name)
    return out


def band_table(spark: SparkSession) -> DataFrame:
    """Bands with their derived bounds: a fixed table of four rows."""
    rows = [(n, lo * 60, hi * 60, c * 60, 1 / (hi * 60), 1 / (lo * 60), 1 / (c * 60)) for n, lo, hi, c in BANDS]
    return spark.createDataFrame(rows, "band string, period_min_sec double, period_max_sec double, period_centroid_sec double, freq_min_hz double, freq_max_hz double, freq_centroid_hz double")


def get_band(name: str) -> tuple[str, float, float, float]:
    """Band by name in any case; KeyError for another name."""
    found = {b[0]: b for b in BANDS}
    if name.upper() not in found:
        raise KeyError(f"unknown band {name!r}; known: {sorted(found)}")
    return found[name.upper()]


def fine_edges(lo: float = 15.0, hi: float = 180.0, n: int = 5) -> list[tuple[str, float, float]]:
    """Log-spaced bands in minutes."""
    at = [exp(log(lo) + (log(hi) - log(lo)) * k / n) for k in range(n + 1)]
    at[0], at[-1] = lo, hi
    return [(f"B{k + 1}", at[k], at[k + 1]) for k in range(n)]


def band_lookup(edges: list[tuple[str, float, float]]) -> Callable[[Column], Column]:
    """A function from periods in minutes to the name of the half-open band."""

    def lookup(period_min: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, lo, hi in sorted(edges, key=lambda e: e[1]):
            out = out.when((period_min >= lo) & (period_min < hi), name)
        return out

    return lookup


def region_name(code: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in REGIONS.items():
        out = out.when(code == k, v)
    return F.coalesce(out, F.lit("unknown"))


def crossing_region(kind: Column, direction: Column) -> Column:
    """Region after a crossing."""
    key = F.concat(F.coalesce(kind, F.lit("")), F.coalesce(direction, F.lit("")))
    known = F.when(key == "BSI", 1).when(key == "BSO", 2).when(key == "MPI", 0).when(key == "MPO", 1)
    return known.when(direction == "E_SW", 2).when(direction == "E_SH", 1).when(direction.isin("E_SP", "E_MP"), 0).otherwise(9)


def polarization_class(phase_deg: Column, tolerance: float = 30.0) -> Column:
    p = F.pmod(phase_deg, F.lit(360.0))
    near = lambda *at: [F.abs(p - a) < tolerance for a in at]
    circular, linear = near(90.0, 270.0), near(0.0, 180.0, 360.0)
    return F.when(circular[0] | circular[1], "circular").when(linear[0] | linear[1] | linear[2], "linear").otherwise("mixed")


def stokes_geometry(i: Column, q: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """(ellipticity, inclination in degrees, polarised fraction); zeros without power."""
    p = F.sqrt(q * q + u * u + v * v)
    ok = (p > 0) & (i > 0)
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(v, p)))
    zero = lambda c: F.when(ok, c).otherwise(0.0)
    return zero(F.tan(0.5 * F.asin(sine))), zero(F.degrees(0.5 * F.atan2(u, q))), zero(F.try_divide(p, i))


def co_bands(periods_min: Column, band: Column, classify: Callable[[Column], Column] = band_of, exclude_self: bool = True) -> Column:
    """Sorted, comma-joined bands of the peers' periods."""
    names = F.array_distinct(F.filter(F.transform(periods_min, lambda p: classify(p * 60)), lambda b: b.isNotNull()))
    names = F.filter(names, lambda b: ~b.eqNullSafe(band)) if exclude_self else names
    return F.concat_ws(",", F.array_sort(names))


def ar1_shape(f: Column, dt: float, a: Column) -> Column:
    """Spectrum of a first-order autoregression at frequency ``f``."""
    return (1 - a * a) / (1 + a * a - 2 * a * F.cos(2 * 3.141592653589793 * f * dt))


def outside_coi(f: Column, i_t: Column, n: Column, dt: float, omega0: float = 10.0) -> Column:
    """Whether sample ``i_t`` of ``n`` is free of edge effects at frequency ``f``."""
    edge = F.ceil(1.4142135623730951 * omega0 / (2 * 3.141592653589793 * f) / dt)
    edge = F.greatest(F.lit(0), F.least(edge, F.floor((n - 1) / 2)))
    return (i_t >= edge) & (i_t < n - edge)

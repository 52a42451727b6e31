"""Occupancy grids as sparse tables: one scan, one shuffle on the bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.bins import GridSpec, in_lt_range, inside, value_to_bin
from packetloom.operators import joins
from packetloom.session import staged

KNOWN = (0, 1, 2, 9)


def with_bins(samples: DataFrame, spec: GridSpec) -> DataFrame:
    """Samples (x, y, z) with r, lat, lt and their bins, computed once for all schemas."""
    r, lat, lt = spec.coords(F.col("x"), F.col("y"), F.col("z"))
    df = samples.withColumns({"r": r, "lat": lat, "lt": lt})
    return df.withColumns(spec.bins(F.col("r"), F.col("lat"), F.col("lt")))


def dwell(binned: DataFrame, keys: list[str], dt_min: float = 1.0) -> DataFrame:
    """Minutes per bin."""
    return binned.filter("in_range").groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(dt_min)).cast("double").alias("minutes"))


def dwell_stats(binned: DataFrame) -> DataFrame:
    return binned.agg(F.count_if("in_range").alias("n_in"), F.count_if(~F.col("in_range")).alias("n_out"), F.max("r").alias("r_max"))


def dwell_regions(binned: DataFrame, keys: list[str], dt_min: float = 1.0, code: str = "code") -> DataFrame:
    """Total minutes and those of each known region, per bin; other codes count in the total only."""
    of = lambda k: (F.count_if(F.col(code) == k) * F.lit(dt_min)).cast("double").alias(f"region_{k}")
    total = (F.count(F.lit(1)) * F.lit(dt_min)).cast("double").alias("total")
    return binned.filter("in_range").groupBy(*keys).agg(total, *[of(k) for k in KNOWN])


def schemas(binned: DataFrame, named: dict[str, tuple[Column, Column, Column]], dt_min: float = 1.0) -> DataFrame:
    """Minutes of several schemas in one shuffle: each sample becomes one row per schema that has it.

    ``named`` maps a schema to (whether the sample belongs, first bin, second bin).
    """
    each = F.array(*[F.struct(F.lit(s).alias("schema"), ok.alias("ok"), i.cast("int").alias("i"), j.cast("int").alias("j")) for s, (ok, i, j) in named.items()])
    rows = binned.select("code", F.explode(each).alias("s")).filter("s.ok").select("code", "s.*")
    return rows.groupBy("schema", "i", "j").agg((F.count(F.lit(1)) * F.lit(dt_min)).cast("double").alias("minutes"))


def owned(samples: DataFrame, t: str, keys: list[str], lead: float, length: float) -> DataFrame:
    """Samples in the part of their segment that it owns: ``length`` seconds from ``lead`` after its first time."""
    starts = samples.groupBy(*keys).agg(F.min(t).alias("segment_start"))  # a row per segment
    x = samples.join(starts, keys).filter((F.col(t) >= F.col("segment_start") + lead) & (F.col(t) < F.col("segment_start") + lead + length))
    return x.select(*samples.columns)


def event_grids(masked: DataFrame, bands: list[str], named: dict[str, tuple[Column, list[Column]]], dt_min: float = 1.0, code: str = "code") -> DataFrame:
    """(schema, band, i, j, k, total, region_*): minutes of each band and of their union, "total", on several schemas.

    ``masked`` has one row per sample with the bits of its bands in ``mask``, so minutes that
    events of a band share count once. ``named`` maps a schema to (whether the sample belongs,
    its two or three bins). A sample becomes its rows within one scan, and the bins are the only
    shuffle.
    """
    union = F.lit(0)
    for k in range(len(bands)):
        union = union.bitwiseOR(F.lit(1 << k))
    in_band = [F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(b)) for k, b in enumerate(bands)]
    in_band.append(F.when(F.col("mask").bitwiseAND(union) != 0, F.lit("total")))
    bins = lambda at: [x.cast("int").alias(n) for x, n in zip([*at, F.lit(None)][:3], "ijk", strict=True)]
    in_schema = [F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(s).alias("schema"), *bins(at))) for s, (ok, at) in named.items()]
    rows = masked.select(code, F.array_compact(F.array(*in_band)).alias("b"), F.explode(F.array_compact(F.array(*in_schema))).alias("s"))
    rows = rows.select(F.col(code).alias("code"), "s.*", F.explode("b").alias("band")).withColumn("in_range", F.lit(True))
    return dwell_regions(rows, ["schema", "band", "i", "j", "k"], dt_min)


def traced_schemas(spec: GridSpec) -> dict[str, tuple[Column, list[Column]]]:
    """Footpoint latitude and equatorial radius of the lines through samples, of all lines and of closed ones.

    Columns used: z, lt, lat_north, lat_south, l_eq, closed. The footpoint is that of the
    sample's own hemisphere (z >= 0 is north); without one a sample is in neither of the two.
    """
    known = lambda v: F.nanvl(v, F.lit(None).cast("double"))
    foot = known(F.when(F.col("z") >= 0, F.col("lat_north")).otherwise(F.col("lat_south")))
    lt, i_lt, closed = inside(F.col("lt"), *spec.lt), value_to_bin(F.col("lt"), *spec.lt, spec.n_lt), F.coalesce(F.col("closed"), F.lit(False))
    inv, eq = inside(foot, *spec.lat) & lt, inside(known(F.col("l_eq")), *spec.r) & lt
    at_inv, at_eq = [value_to_bin(foot, *spec.lat, spec.n_lat), i_lt], [value_to_bin(F.col("l_eq"), *spec.r, spec.n_r), i_lt]
    return {"inv_lat": (inv, at_inv), "inv_lat_closed": (inv & closed, at_inv), "eq_r": (eq, at_eq), "eq_r_closed": (eq & closed, at_eq)}


def event_grids_traced(samples: DataFrame, spans: DataFrame, t: str, lo: str, hi: str, own: list[str], bit: Column, bands: list[str], trace: Callable[[DataFrame], DataFrame], spec: GridSpec, keys: list[str] | None = None, dt_min: float = 1.0) -> DataFrame:
    """Event grids of the lines through the samples; see :func:`traced_schemas`.

    Only samples within some event are traced, each once, whatever number of bands it is in:
    ``trace`` adds lat_north, lat_south, l_eq and closed to them, and what it returns is staged
    as a table keyed by sample, from which all bands and schemas are counted.
    """
    met = joins.interval_masks(samples, spans, t, lo, hi, own, bit, keys)
    traced = staged(trace(met.filter("mask <> 0")), "traced")
    return event_grids(traced, bands, traced_schemas(spec), dt_min)


def closed_field_r(binned: DataFrame, l_eq: Column, closed: Column, closed_only: bool, spec: GridSpec, dt_min: float = 1.0) -> DataFrame:
    """Minutes per (bin of the equatorial crossing, local time), of closed lines only or of all."""
    ok = inside(l_eq, *spec.r) & inside(F.col("lt"), *spec.lt)
    ok = ok & closed if closed_only else ok
    df = binned.filter(ok).withColumn("i_l", value_to_bin(l_eq, *spec.r, spec.n_r))
    return df.groupBy("i_l", "i_lt").agg((F.count(F.lit(1)) * F.lit(dt_min)).cast("double").alias("minutes"))


def dwell_traced(traced: DataFrame, spec: GridSpec, closed_only: bool = False, dt_min: float = 60.0) -> DataFrame:
    """Minutes per (footpoint latitude, local time) of traced positions, in total and by region.

    The footpoint is that of the position's own hemisphere (z >= 0 is north). Columns used:
    lat_north, lat_south, closed, lt, z, code. Open lines without a footpoint drop out.
    """
    foot = F.when(F.col("z") >= 0, F.col("lat_north")).otherwise(F.col("lat_south"))
    ok = inside(F.nanvl(foot, F.lit(None).cast("double")), *spec.lat) & inside(F.col("lt"), *spec.lt)
    ok = ok & F.col("closed") if closed_only else ok
    df = traced.withColumns({"in_range": F.coalesce(ok, F.lit(False)), "i_inv": value_to_bin(foot, *spec.lat, spec.n_lat), "i_lt": value_to_bin(F.col("lt"), *spec.lt, spec.n_lt)})
    return dwell_regions(df, ["i_inv", "i_lt"], dt_min)


def ratio(events: Column, dwell_minutes: Column, floor: float = 600.0, clip: bool = True) -> Column:
    """Events over dwell; null below the floor, zero without events, at most one if ``clip``."""
    q = F.try_divide(F.coalesce(events, F.lit(0.0)), dwell_minutes)
    return F.when(dwell_minutes >= floor, F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)) if clip else q)


def rate(event_grid: DataFrame, dwell_grid: DataFrame, keys: list[str], floor: float = 600.0, clip: bool = True) -> DataFrame:
    """Occurrence rate on every dwell bin; ``minutes`` on both sides."""
    e = event_grid.select(*keys, F.col("minutes").alias("event_minutes"))
    return dwell_grid.join(e, keys, "left").select(*keys, ratio(F.col("event_minutes"), F.col("minutes"), floor, clip).alias("rate"))


def lt_sector(grid: DataFrame, centre: float, half: float, spec: GridSpec, keys: list[str]) -> DataFrame:
    """Sum over the local times whose bin centre lies in a wrapped sector."""
    mid = spec.lt[0] + (F.col("i_lt") + 0.5) * ((spec.lt[1] - spec.lt[0]) / spec.n_lt)
    return grid.filter(in_lt_range(mid, centre, half)).groupBy(*keys).agg(F.sum("minutes").alias("minutes"))


def lat_profile(grid: DataFrame, spec: GridSpec, degrees: float = 5.0) -> DataFrame:
    """Sum over all else, rebinned to coarser latitudes with the sums kept."""
    width = (spec.lat[1] - spec.lat[0]) / spec.n_lat
    k = F.floor((F.col("i_lat") + 0.5) * width / degrees).cast("int")
    return grid.groupBy(k.alias("i_lat5")).agg(F.sum("minutes").alias("minutes"))


def coarsen(grid: DataFrame, axis: str, n: int, target: int, keys: list[str]) -> DataFrame:
    """An axis of ``n`` bins at ``target`` bins; the remainder is dropped."""
    f = n // target
    df = grid.filter(F.col(axis) < f * target).withColumn(axis, F.floor(F.col(axis) / f).cast("int"))
    return df.groupBy(axis, *keys).agg(F.sum("minutes").alias("minutes"))


def coverage(spans: DataFrame, lo: str, hi: str, keys: list[str], rows_per_part: int = joins.ROWS_PER_PART) -> DataFrame:
    """Disjoint stretches [lo, hi] that closed intervals cover, per key.

    A sweep over the ends: a stretch begins where no interval is open before and ends where none
    is after. The open ones are counted over ranges of (keys, time), so a key of any size is many
    tasks. Where no key has more intervals than a range, a window over each finds them likewise.
    """
    from packetloom.operators.ordered import cumulated

    spans = spans.filter(F.col(lo) <= F.col(hi)).select(*keys, lo, hi)
    if keys and (spans.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= rows_per_part:
        w = Window.partitionBy(*keys).orderBy(lo, hi)
        before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = spans.withColumn("before", before).withColumn("island", F.sum((F.col("before").isNull() | (F.col(lo) > F.col("before"))).cast("int")).over(w))
        return marked.groupBy(*keys, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).select(*keys, lo, hi)

    end = lambda c, n: F.struct(F.col(c).alias("at"), F.lit(n).cast("long").alias("d"), F.lit(int(n > 0)).cast("long").alias("b"))
    ends = spans.select(*keys, F.explode(F.array(end(lo, 1), end(hi, -1))).alias("e")).select(*keys, "e.*")
    counted = staged(ends.groupBy(*keys, "at").agg(F.sum("d").alias("d")), "ends")  # a row per key and time
    swept = cumulated(counted, "at", keys, ["d"], counted, rows_per_part)
    first = (F.col("upto_d") - F.col("d") == 0) & (F.col("d") >= 0)
    marks = swept.filter(first | (F.col("upto_d") == 0)).select(*keys, "at", first.cast("long").alias("begins"))
    marks = staged(marks, "marks")
    numbered = cumulated(marks, "at", keys, ["begins"], marks, rows_per_part)
    return numbered.groupBy(*keys, "upto_begins").agg(F.min("at").alias(lo), F.max("at").alias(hi)).select(*keys, lo, hi)


def smooth(grid: DataFrame, i: str, j: str, value: str, sigma: float, n_i: int, n_j: int, wrap_j: bool = True) -> DataFrame:
    """Null-aware Gaussian smoothing of a full 2-d grid: two passes of weighted sums, reflected or wrapped at the edges.

    Null cells add neither value nor weight.
    """
    from math import exp

    reach = int(4 * sigma + 0.5)
    kernel = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(exp(-0.5 * (o / sigma) ** 2)).alias("w")) for o in range(-reach, reach + 1)])

    def folded(k: Column, n: int, wrap: bool) -> Column:
        if wrap:
            return F.pmod(k, F.lit(n))
        p = F.pmod(k, F.lit(2 * n))
        return F.when(p < n, p).otherwise(2 * n - 1 - p)

    cells = grid.select(F.col(i).alias("i"), F.col(j).alias("j"), F.coalesce(value, F.lit(0.0)).alias("v"), F.when(F.col(value).isNull(), 0.0).otherwise(1.0).alias("u"))

    def along(df: DataFrame, axis: str, other: str, n: int, wrap: bool) -> DataFrame:
        # a cell gathers from its neighbours: every target offset o reads the folded source
        targets = df.select(F.col(other), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("to")).distinct()
        reads = targets.withColumn("k", F.explode(kernel)).withColumn(axis, folded(F.col("to") + F.col("k.o"), n, wrap))
        got = reads.join(df, [axis, other])
        return got.groupBy(other, "to").agg(F.sum(F.col("v") * F.col("k.w")).alias("v"), F.sum(F.col("u") * F.col("k.w")).alias("u")).withColumnRenamed("to", axis)

    out = along(along(cells, "i", "j", n_i, False), "j", "i", n_j, wrap_j)
    return out.select(F.col("i").cast("int").alias(i), F.col("j").cast("int").alias(j), F.when(F.col("u") > 1e-12, F.col("v") / F.col("u")).alias(value))

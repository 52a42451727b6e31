"""Ordered logic: strides, running means, gaps, resampling, dense numbers, cumulated sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators import joins
from packetloom.session import staged


#: Rows of a block that a window runs over.
BLOCK = 50_000


def _same(keys: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on


def placed(df: DataFrame, keys: list[str], order: list[str], rows_per_part: int = joins.ROWS_PER_PART) -> tuple[DataFrame, int]:
    """``df`` with ``place``, the row's number from 0 within its key, and among how many ranges the rows were dealt.

    Ranges go by (keys, order), so only the first key of a range can have rows in the ranges
    before it: what it adds to the numbers is one row per range at most. Where no key has more
    rows than a range, each is numbered by itself.
    """
    if keys and (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= rows_per_part:
        return df.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")), 1
    part, n = joins.ranges(df, [*keys, *order], rows_per_part)
    x = df.withColumn("part", part(*[F.col(c) for c in (*keys, *order)]))
    x = x.withColumn("place", (F.row_number().over(Window.partitionBy("part", *keys).orderBy(*order)) - 1).cast("long"))
    if n > 1:
        held = df.withColumn("part", part(*[F.col(c) for c in (*keys, *order)])).groupBy(*keys, "part").count()
        before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and range
        shift = held.withColumn("before", F.sum("count").over(before)).filter("before > 0")
        shift = shift.select(F.col("part").alias("of_part"), *[F.col(c).alias(f"of_{c}") for c in keys], "before")
        x = x.join(F.broadcast(shift), (F.col("part") == F.col("of_part")) & _same(keys, "of_"), "left")  # one row per range
        x = x.withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    return x.select(*df.columns, "place"), n


def haloed(x: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """Placed rows with ``block`` and ``own``: each in its block of places, and within ``reach`` of an edge also in the neighbour's.

    A window over (keys, block) then sees ``reach`` rows to each side of every row that is its own.
    """
    size = max(block, 4 * reach)
    at, own = F.col("place") % size, F.floor(F.col("place") / size)
    where = F.array_compact(F.array(own, F.when((at < reach) & (own > 0), own - 1), F.when(at >= size - reach, own + 1)))
    return x.withColumn("own", own).withColumn("block", F.explode(where)).withColumn("own", F.col("own") == F.col("block"))


def stride(df: DataFrame, k: int, keys: list[str], order: list[str], rows_per_part: int = joins.ROWS_PER_PART) -> DataFrame:
    """Every ``k``-th row of each key in order, from the first."""
    return placed(df, keys, order, rows_per_part)[0].filter(F.col("place") % k == 0).drop("place")


def running_mean(df: DataFrame, v: str, width: int, keys: list[str], order: list[str], out: str, rows_per_part: int = joins.ROWS_PER_PART, block: int = BLOCK) -> DataFrame:
    """Centred mean over an odd width; past the ends the end value is repeated."""
    h = (width + 1 - width % 2) // 2 if width % 2 == 0 else width // 2
    n = 2 * h + 1
    x, parts = placed(df, keys, order, rows_per_part)
    if parts == 1:
        w = Window.partitionBy(*keys).orderBy(*order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        x = x.withColumns({"n_key": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "first_v": F.first(v).over(whole), "last_v": F.last(v).over(whole), "inner_v": F.sum(v).over(w.rowsBetween(-h, h))})
    else:
        ends = x.groupBy(*[F.col(c).alias(f"of_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("n_key"), F.min_by(v, "place").alias("first_v"), F.max_by(v, "place").alias("last_v"))
        w = Window.partitionBy(*keys, "block").orderBy("place").rowsBetween(-h, h)
        x = haloed(x, h, block).withColumn("inner_v", F.sum(v).over(w)).filter("own").join(ends, _same(keys, "of_"))
    left = F.greatest(F.lit(0), h - F.col("place"))
    right = F.greatest(F.lit(0), h - (F.col("n_key") - 1 - F.col("place")))
    mean = (F.col("inner_v") + left * F.col("first_v") + right * F.col("last_v")) / n
    return x.select(*[c for c in df.columns if c != out], mean.alias(out))


def numbered(df: DataFrame, order: list[str], out: str, rows_per_part: int = joins.ROWS_PER_PART) -> DataFrame:
    """``df`` with dense numbers from 0 in an order, nulls first: each range is numbered and shifted by what comes before it.

    ``df`` is staged, so what it takes to make it is done once.
    """
    df = staged(df, "unnumbered")
    part, n = joins.ranges(df, order, rows_per_part)
    x = df.withColumn("part", part(*[F.col(c) for c in order]))
    x = x.withColumn(out, F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    if n > 1:
        w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = df.withColumn("part", part(*[F.col(c) for c in order])).groupBy("part").count()  # one row per range
        before = before.select("part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
        x = x.join(F.broadcast(before), "part").withColumn(out, F.col(out) + F.col("before"))
    return x.select(*df.columns, F.col(out).cast("long").alias(out))


def cumulated(df: DataFrame, v: str, keys: list[str], sums: list[str], rows: DataFrame, rows_per_part: int = joins.ROWS_PER_PART) -> DataFrame:
    """``df`` (one row per key and value) with ``upto_x`` and ``all_x`` of each x in ``sums``: running and whole totals of its key in order of ``v``.

    The order is dealt by ranges of (keys, v), so a few large keys are many tasks. ``rows`` are
    those that ``df`` was counted from: their scan tells the ranges, which spares counting twice.
    """
    part, _ = joins.ranges(rows, [*keys, v], rows_per_part)
    x = df.withColumn("part", part(*[F.col(c) for c in (*keys, v)]))
    held = x.groupBy(*keys, "part").agg(*[F.sum(c).alias(c) for c in sums])
    every = Window.partitionBy(*(keys or [F.lit(0)]))  # a row per key and range
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        F.col("part").alias("of_part"), *[F.col(c).alias(f"of_{c}") for c in keys], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in sums], *[F.sum(c).over(every).alias(f"all_{c}") for c in sums]
    )
    on = F.col("part") == F.col("of_part")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    w = Window.partitionBy("part", *keys).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.sum(c).over(w).alias(f"upto_{c}") for c in sums]).join(offsets, on)
    return x.select(*df.columns, *[(F.col(f"upto_{c}") + F.col(f"before_{c}")).alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums])


def resample(df: DataFrame, t: str, v: str, step: float, keys: list[str], rows_per_part: int = joins.ROWS_PER_PART) -> DataFrame:
    """(keys, i, t, v): linear interpolation of each key's samples onto a grid from its first time, its end excluded.

    Each gap between neighbours fills the grid points it holds, so no grid is joined with samples.
    """
    g = df.groupBy(*keys, t).agg(F.avg(v).alias(v))
    gaps = joins.intervals(g.select(*keys, F.col(t).alias("ta"), F.struct(F.col(t).alias("t"), F.col(v).alias("v")).alias("a")), "ta", keys, rows_per_part=rows_per_part, carry="a")
    ends = g.groupBy(*[F.col(c).alias(f"of_{c}") for c in keys]).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    g = gaps.filter("hi IS NOT NULL").join(ends, _same(keys, "of_")).select(*keys, "t0", F.floor((F.col("t1") - F.col("t0")) / step).alias("n"), F.col("a.t").alias(t), F.col("a.v").alias(v), F.col("hi.t").alias("nt"), F.col("hi.v").alias("nv"))
    lo, hi = F.ceil((F.col(t) - F.col("t0")) / step), F.ceil((F.col("nt") - F.col("t0")) / step) - 1
    g = g.withColumn("lo", lo).withColumn("hi", F.least(hi, F.col("n") - 1)).filter("lo <= hi").withColumn("i", F.explode(F.sequence("lo", "hi")))
    at = F.col("t0") + F.col("i") * step
    value = F.col(v) + (F.col("nv") - F.col(v)) * ((at - F.col(t)) / (F.col("nt") - F.col(t)))
    return g.select(*keys, "i", at.alias("at"), value.alias("value")).withColumnRenamed("at", "t_grid")


def fill(df: DataFrame, v: str, keys: list[str], order: list[str], how: str, rows_per_part: int = joins.ROWS_PER_PART) -> DataFrame:
    """Nulls of a series as zero, its mean, or by linear interpolation over places with end values held.

    The known values about a hole are looked up by place, however far they are.
    """
    if how == "zero":
        return df.withColumn(v, F.coalesce(v, F.lit(0.0)))
    if how == "mean":
        means = df.groupBy(*[F.col(c).alias(f"of_{c}") for c in keys]).agg(F.avg(v).alias("mean_v"))
        return df.join(means, _same(keys, "of_")).select(*[F.coalesce(c, "mean_v").alias(c) if c == v else c for c in df.columns])
    if how != "linear":
        raise ValueError(f"unknown way to fill: {how!r}")
    x, _ = placed(df, keys, order, rows_per_part)
    known = x.filter(F.col(v).isNotNull()).select(*keys, F.col("place").alias("p"), F.col(v).alias("known_v"))
    d = joins.neighbours(x, known, "place", "p", keys, after=True, rows_per_part=rows_per_part)
    own, a, b = F.col(f"l.`{v}`"), F.col("before.known_v"), F.col("after.known_v")
    share = F.try_divide((F.col("l.place") - F.col("before.p")).cast("double"), (F.col("after.p") - F.col("before.p")).cast("double"))
    value = F.coalesce(own, a + (b - a) * share, a, b)
    return d.select(*[value.alias(c) if c == v else F.col(f"l.`{c}`").alias(c) for c in df.columns])

"""As-of, nearest and interval joins: no nested loops and no one-task windows at any size.

Times are numbers (POSIX seconds). As-of joins deal the union of both sides into ranges of
(keys, time) that hold about equally many rows, carry the last or next right row within each
range by a window, and hand each range the right row nearest to it from the others. So the work
grows with the rows, however dense they are. Interval joins put each interval at the level of a
grid of fourfold widths at which it touches a few nodes only; both sides meet on the node, and
the range test is the residual.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, how many ranges there may be, and sampled rows per range.
ROWS_PER_PART = 100_000
MOST_PARTS = 1 << 16
SAMPLED = 8
#: Nodes of an interval at its level, parts of a node above the first level, and how many levels there may be.
NODES = 8
SALTS = 8
MOST_LEVELS = 32


def bucket(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def ranges(rows: DataFrame, order: list[str], rows_per_part: int = ROWS_PER_PART) -> tuple[Callable[..., Column], int]:
    """A function from columns in ``order`` to the number of their range, and how many ranges there are.

    The bounds come from a sample that is a fixed multiple of the number of ranges; results
    don't depend on where they lie.
    """
    n = rows.count()
    parts = max(1, min(MOST_PARTS, n // rows_per_part))
    sample = rows.select(*order).dropna().sample(min(1.0, SAMPLED * parts / max(n, 1)), 1).distinct() if parts > 1 else rows.limit(0)
    found = sorted(tuple(r) for r in sample.collect())[SAMPLED::SAMPLED] if parts > 1 else []
    if not found:
        return lambda *_: F.lit(0), 1
    kinds = ",".join(f"c{k}:{rows.schema[c].dataType.simpleString()}" for k, c in enumerate(order))
    bounds = F.from_json(F.lit(json.dumps([{f"c{k}": v for k, v in enumerate(x)} for x in found])), f"array<struct<{kinds}>>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(found).bit_length()))])

    def part(*columns: Column) -> Column:
        """Binary search for the number of bounds at or below the key."""
        key = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)])
        # the key goes along in the state: the optimiser overlooks columns that a lambda captures
        start = F.struct(F.lit(0).alias("low"), key.alias("key"))
        step = lambda a, s: F.struct(F.when(F.get(bounds, a["low"] + s - 1) <= a["key"], a["low"] + s).otherwise(a["low"]).alias("low"), a["key"].alias("key"))
        return F.aggregate(steps, start, step, lambda a: a["low"])

    return part, len(found) + 1


def from_others(edges: DataFrame, value: str, n: int, after: bool = False) -> DataFrame:
    """(part, value) for every range: ``value`` of the nearest range before (or ``after``) it that has one.

    The window runs over one row per range.
    """
    w = Window.orderBy(F.desc("part") if after else "part").rowsBetween(Window.unboundedPreceding, -1)
    every = edges.sparkSession.range(n).select(F.col("id").cast("int").alias("part"))
    return every.join(edges, "part", "left").select("part", F.last(value, ignorenulls=True).over(w).alias(value))


def neighbours(
    left: DataFrame, right: DataFrame, t: str, rt: str, keys: list[str] | None = None, strict: bool = False, before: bool = True, after: bool = False, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Left rows as struct ``l`` with structs ``before`` and ``after``: the right rows next to their time.

    A right row at the very time counts as before, with ``strict`` as after. Of right rows at
    one time the last in order counts before and the first after. Rows without a time or a key
    have no neighbours.
    """
    keys = keys or []
    names, k = [c for c in right.columns if c not in keys], [f"k{i}" for i in range(len(keys))]
    own = lambda df, time: [*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(time).cast("double").alias("at")]
    r = right.filter(F.col(rt).isNotNull()).select(*own(right, rt), F.struct(*names).alias("r"))
    part, n = ranges(left.select(*own(left, t)).unionByName(r.select(*k, "at")), [*k, "at"], rows_per_part)
    keyed = part(*[F.col(c) for c in (*k, "at")]).alias("part")
    ls = left.select(F.struct(*left.columns).alias("l"), *own(left, t), F.lit(0 if strict else 2).alias("side"))
    rs = r.select("*", keyed)
    both = ls.unionByName(r.withColumn("side", F.lit(1)), allowMissingColumns=True).select("*", keyed)
    where, out = Window.partitionBy("part", *k), []
    for wanted, name, order in ((before, "before", ["at", "side", "r"]), (after, "after", [F.desc("at"), F.desc("side"), F.desc("r")])):
        if not wanted:
            continue
        rows = where.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn(name, F.last("r", ignorenulls=True).over(rows))
        if n == 1:  # no other range to look into
            out.append((name, None))
            continue
        pick = F.min if name == "after" else F.max
        edge = rs.groupBy("part").agg(pick(F.struct(*k, "at", "r")).alias("edge"))
        out.append((name, from_others(edge, "edge", n, name == "after").withColumnRenamed("edge", f"{name}_edge")))
    both = both.filter("side <> 1")
    known = F.col("at").isNotNull()
    for c in k:
        known = known & F.col(c).isNotNull()
    for name, edge in out:
        value = F.col(name)
        if edge is not None:
            both = both.join(F.broadcast(edge), "part", "left")  # one row per range
            same = F.lit(True)
            for c in k:
                same = same & (F.col(c) == F.col(f"{name}_edge.{c}"))
            value = F.coalesce(name, F.when(same, F.col(f"{name}_edge.r")))
        both = both.withColumn(name, F.when(known, value))
    return both.select("l", *[name for name, _ in out])


def intervals(points: DataFrame, t: str, keys: list[str] | None = None, end: Column | None = None, rows_per_part: int = ROWS_PER_PART, carry: str | None = None) -> DataFrame:
    """``points`` with ``lo`` and ``hi``: from each point to the next one of its keys, the last to ``end``.

    With ``carry`` ``hi`` is that column of the next point in place of its time.
    """
    keys = keys or []
    part, n = ranges(points.withColumn("at", F.col(t).cast("double")), [*keys, "at"], rows_per_part)
    rows = points.withColumn("part", part(*[F.col(c) for c in keys], F.col(t).cast("double")))
    w = Window.partitionBy("part", *keys).orderBy(t)
    hi = F.lead(carry or t).over(w)
    if n > 1:
        first = rows.groupBy("part").agg(F.min(F.struct(*keys, F.col(t).alias("at"), F.col(carry or t).alias("of_next"))).alias("edge"))
        rows = rows.withColumn("hi", hi).join(F.broadcast(from_others(first, "edge", n, after=True)), "part", "left")  # one row per range
        same = F.lit(True)
        for c in keys:
            same = same & (F.col(c) == F.col(f"edge.{c}"))
        hi = F.coalesce("hi", F.when(same, F.col("edge.of_next")))
    return rows.select(*points.columns, F.col(t).alias("lo"), F.coalesce(hi, end if end is not None else F.lit(None)).alias("hi"))


def _flat(rows: DataFrame, left: DataFrame, names: list[str], value: Column) -> DataFrame:
    return rows.select(*[F.col(f"l.`{c}`").alias(c) for c in left.columns], *[value[c].alias(c) for c in names])


def asof_backward(left: DataFrame, right: DataFrame, t: str, rt: str, keys: list[str] | None = None, strict: bool = True, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Left rows with the columns of the last right row before (``strict``) or at their time; null if none.

    ``right`` must have no column names of ``left`` but the keys. With equal right times the
    last one in order counts.
    """
    out = neighbours(left, right, t, rt, keys, strict, rows_per_part=rows_per_part)
    return _flat(out, left, [c for c in right.columns if c not in (keys or [])], F.col("before"))


def asof_forward(left: DataFrame, right: DataFrame, t: str, rt: str, clamp: bool = True, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Left rows with the columns of the first right row at or after their time; after the last, the last if ``clamp``."""
    out = neighbours(left, right, t, rt, strict=True, before=clamp, after=True, rows_per_part=rows_per_part)
    value = F.coalesce("after", F.when(F.col(f"l.`{t}`").isNotNull(), F.col("before"))) if clamp else F.col("after")
    return _flat(out, left, right.columns, value)


def nearest(left: DataFrame, right: DataFrame, t: str, rt: str, keys: list[str] | None = None, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Left rows with the columns of the right row nearest in time; the earlier one of two as near."""
    out = neighbours(left, right, t, rt, keys, after=True, rows_per_part=rows_per_part)
    at = F.col(f"l.`{t}`")
    take = F.col("after").isNull() | (at - F.col(f"before.`{rt}`") <= F.col(f"after.`{rt}`") - at)
    return _flat(out, left, [c for c in right.columns if c not in (keys or [])], F.when(take, F.col("before")).otherwise(F.col("after")))


def _leveled(spans: DataFrame, lo: str, hi: str, width: float) -> tuple[DataFrame, list[int]]:
    """``spans`` as rows of the nodes they touch at the one level that suits their length, and the levels there are.

    A node of level k is 4^k cells of ``width`` long. Above the first level a node is dealt into
    ``SALTS`` parts by cell, since one long interval may take in most points. So an interval is
    at most ``NODES`` rows, or ``NODES`` x ``SALTS`` if it is long, however long it is.
    """
    s = spans.filter(F.col(lo) <= F.col(hi)).withColumns({"lo_cell": bucket(F.col(lo), width), "hi_cell": bucket(F.col(hi), width)})
    cells = F.col("hi_cell").cast("double") - F.col("lo_cell").cast("double")
    level = F.when(cells < NODES, 0).otherwise(F.greatest(F.lit(0), F.ceil(F.log(4.0, cells / (NODES - 2))))).cast("int")
    s = s.withColumn("level", F.least(level, F.lit(MOST_LEVELS - 1)))
    levels = sorted(r[0] for r in s.select("level").distinct().collect())  # at most MOST_LEVELS numbers
    node = lambda cell: F.call_function("shiftright", F.col(cell), F.col("level") * 2)
    s = s.withColumn("node", F.explode(F.sequence(node("lo_cell"), node("hi_cell"))))
    if levels and levels[-1]:
        s = s.withColumn("salt", F.explode(F.when(F.col("level") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    else:
        s = s.withColumn("salt", F.lit(0))
    return s.drop("lo_cell", "hi_cell"), levels


def _met(points: DataFrame, s: DataFrame, levels: list[int], t: str, lo: str, hi: str, keys: list[str], how: str, width: float) -> DataFrame:
    cell = bucket(F.col(t), width)
    at = [F.struct(F.lit(k).alias("p_level"), F.call_function("shiftright", cell, F.lit(2 * k)).alias("p_node"), F.pmod(cell, F.lit(SALTS if k else 1)).cast("int").alias("p_salt")) for k in levels]
    p = points.withColumn("p", F.explode(F.array(*at)) if len(at) > 1 else at[0]).select(*points.columns, "p.*")
    for k in keys:
        s = s.withColumnRenamed(k, f"r_{k}")
    on = (F.col("p_node") == F.col("node")) & (F.col("p_level") == F.col("level")) & (F.col("p_salt") == F.col("salt")) & (F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return p.join(s, on, how)


def in_intervals(points: DataFrame, spans: DataFrame, t: str, lo: str, hi: str, keys: list[str] | None = None, how: str = "inner", width: float = 3600.0) -> DataFrame:
    """Points with every closed interval [lo, hi] that holds them, or those that none holds (``left_anti``).

    Keys have one name on both sides. Both sides meet on nodes of one level each
    (:func:`_leveled`); a point looks into one node of every level that an interval is at.
    """
    if how not in ("inner", "left_anti"):
        raise ValueError(f"unknown way to join: {how!r}")
    keys = keys or []
    s, levels = _leveled(spans, lo, hi, width)
    if how == "inner":
        out = _met(points, s, levels or [0], t, lo, hi, keys, how, width)
        return out.drop("p_level", "p_node", "p_salt", "level", "node", "salt", *[f"r_{k}" for k in keys])
    out = points
    for k in levels:  # a point stays if no level has an interval for it
        out = _met(out, s.filter(F.col("level") == k), [k], t, lo, hi, keys, how, width).select(*points.columns)
    return out


def interval_masks(points: DataFrame, spans: DataFrame, t: str, lo: str, hi: str, own: list[str], bit: Column, keys: list[str] | None = None, width: float = 3600.0) -> DataFrame:
    """Points in some interval, once each, with ``mask``: the bits of all intervals that hold them.

    ``own`` tells points apart. The bits are gathered where points and intervals have met, so a
    point in many intervals doesn't leave its task as many rows; where intervals are at several
    levels, a second step brings the levels' masks together.
    """
    keys = keys or []
    s, levels = _leveled(spans.withColumn("bit", bit.cast("long")).select(*keys, lo, hi, "bit"), lo, hi, width)
    met = _met(points, s, levels or [0], t, lo, hi, keys, "inner", width)
    rest = [c for c in points.columns if c not in own and c not in keys]
    one = lambda df, group, mask: df.groupBy(*group).agg(F.bit_or(mask).alias("mask"), F.first(F.struct(*rest)).alias("rest"))
    out = one(met, list(dict.fromkeys([*keys, "p_node", "p_level", "p_salt", *own])), "bit")
    flat = [*dict.fromkeys([*keys, *own]), *[f"rest.{c}" for c in rest], "mask"]
    out = out.select(*flat)
    if len(levels) > 1:
        out = one(out, list(dict.fromkeys([*keys, *own])), "mask").select(*flat)
    return out.select(*points.columns, "mask")


def at_index(points: DataFrame, series: DataFrame, t: str, keys: list[str], order: list[str], values: list[str], cadence: float, block: int = 4096, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Points with ``values`` of their key's series at place (time since its first row) / ``cadence``, rounded half to even and clamped.

    A series is kept as arrays of ``block`` rows keyed by (keys, place div block), so no row grows
    with its key. Points of a key without a series drop out.
    """
    from packetloom.operators.ordered import placed

    rows, _ = placed(series, keys, order, rows_per_part)
    size = rows.groupBy(*keys).agg(F.min(t).alias("t0"), F.count(F.lit(1)).alias("n_rows"))  # a row per key
    blocks = rows.groupBy(*keys, F.floor(F.col("place") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", *values))).alias("held"))
    k = F.least(F.greatest(F.bround((F.col(t) - F.col("t0")) / cadence, 0), F.lit(0.0)), (F.col("n_rows") - 1).cast("double")).cast("long")
    at = points.join(size, keys).withColumn("at_place", k).withColumn("block", F.floor(F.col("at_place") / block))
    out = at.join(blocks, [*keys, "block"]).withColumn("held", F.get("held", (F.col("at_place") % block).cast("int")))
    return out.select(*points.columns, *[F.col(f"held.{v}").alias(v) for v in values])


def crossing_fill(crossings: DataFrame, t0: float, t1: float, step: float, t: str = "t", code: str = "code", label: str = "label", unknown: int = 9) -> DataFrame:
    """State on a regular grid from t0 + step to just past t1, carried forward from the crossings.

    A crossing takes effect at the first grid time at or after it; of several in one slot the
    last counts, and labels stand at that slot only. The grid's slots run in one window, which
    is hours of a mission, not samples.
    """
    n = int((t1 - t0) // step) + 1
    grid = crossings.sparkSession.range(1, n + 1).select(F.col("id").alias("slot"))
    slot = F.greatest(F.ceil((F.col(t) - t0) / step), F.lit(1)).cast("long")
    hits = crossings.withColumn("slot", slot).filter(F.col("slot") <= n).groupBy("slot").agg(F.max_by(code, t).alias("c"), F.max_by(label, F.when(F.col(label).isNotNull(), F.col(t))).alias("label"))
    w = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last("c", ignorenulls=True).over(w), F.lit(unknown))
    return grid.join(hits, "slot", "left").select((t0 + F.col("slot") * step).alias("t"), state.cast("int").alias("code"), "label")


def peers(catalogue: DataFrame, share: float = 0.5) -> DataFrame:
    """Catalogue with arrays of overlapping events of the same segment, sorted by id, empty if none.

    Columns used: event_id, segment_idx, t0, t1, period_min, is_duplicate (optional). Two events
    are peers if their overlap is positive and at least ``share`` of the shorter one.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must lie in [0, 1]")
    live = catalogue.filter(~F.coalesce("is_duplicate", F.lit(False))) if "is_duplicate" in catalogue.columns else catalogue
    a = live.select("segment_idx", F.col("event_id").alias("own"), F.col("t0").alias("a0"), F.col("t1").alias("a1"))
    # long events fall into every bucket they touch, so pairs meet in the bucket of the later start only
    width = 21600.0
    a = a.withColumn("b", F.explode(F.sequence(bucket(F.col("a0"), width), bucket(F.col("a1"), width))))
    b = live.select(F.col("segment_idx").alias("seg_b"), "event_id", F.col("t0").alias("b0"), F.col("t1").alias("b1"), "period_min")
    b = b.withColumn("bb", F.explode(F.sequence(bucket(F.col("b0"), width), bucket(F.col("b1"), width))))
    meet = bucket(F.greatest("a0", "b0"), width)
    pairs = a.join(b, (F.col("segment_idx") == F.col("seg_b")) & (F.col("b") == F.col("bb")) & (F.col("own") != F.col("event_id")) & (F.col("b") == meet))
    overlap = F.least("a1", "b1") - F.greatest("a0", "b0")
    shorter = F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"))
    pairs = pairs.withColumn("frac", F.try_divide(overlap, shorter)).filter((overlap > 0) & (shorter > 0) & (F.col("frac") >= share))
    lists = pairs.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("event_id", "period_min", "frac"))).alias("p"))
    out = catalogue.join(lists, catalogue["event_id"] == lists["own"], "left").drop("own")
    each = lambda f, kind: F.coalesce(F.transform("p", lambda x: x[f]), F.array().cast(f"array<{kind}>"))
    return out.select(*catalogue.columns, each("event_id", "bigint").alias("peer_event_ids"), each("period_min", "double").alias("peer_periods_min"), each("frac", "double").alias("peer_overlap_frac"))

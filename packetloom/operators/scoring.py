"""Detection scores: overlap of intervals, one-to-one assignment, summary measures."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the composite score, limits of overlap for matches and for decoys, grades of difficulty.
WEIGHTS = (0.35, 0.20, 0.15, 0.15, 0.15)
MATCH_IOU = 0.2
IOU_LIMITS = (0.1, 0.2, 0.3, 0.5)
DECOY_IOU = 0.1
DIFFICULTIES = ("easy", "moderate", "hard", "extreme")


#: Schemas of truth and detections, as ``scores`` takes them.
TRUTH = "tid bigint, ds bigint, a0 double, a1 double, period double, band string, difficulty string, decoy boolean"
FOUND = "did bigint, ds bigint, b0 double, b1 double, period double, band string, peak double"


def iou_pairs(truth: DataFrame, found: DataFrame, width: float = 21600.0) -> DataFrame:
    """(ds, tid, did, iou) of all overlapping pairs of truth (tid, ds, a0, a1) and detection (did, ds, b0, b1).

    Pairs meet in the time bucket where their overlap begins, so a long data set isn't crossed with itself.
    """
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    a = truth.withColumn("k", F.explode(F.sequence(at("a0"), at("a1"))))
    b = found.withColumn("k", F.explode(F.sequence(at("b0"), at("b1"))))
    j = a.join(b, ["ds", "k"]).filter(F.least("a1", "b1") > F.greatest("a0", "b0"))
    j = j.filter(F.floor(F.greatest("a0", "b0") / width).cast("long") == F.col("k"))
    iou = (F.least("a1", "b1") - F.greatest("a0", "b0")) / (F.greatest("a1", "b1") - F.least("a0", "b0"))
    return j.select("ds", "tid", "did", iou.alias("iou"))


def matched(rows: np.ndarray, cols: np.ndarray, weight: np.ndarray) -> list[int]:
    """Places of the pairs of a one-to-one assignment of greatest total weight; a row or column may stay alone.

    Shortest augmenting paths over the pairs there are, with potentials: memory grows with the
    pairs, and a path looks no further than it must.
    """
    rows, cols = np.unique(rows, return_inverse=True)[1], np.unique(cols, return_inverse=True)[1]
    order = np.argsort(rows, kind="stable")
    start = np.searchsorted(rows[order], np.arange(int(rows.max(initial=-1)) + 2)).tolist()
    pair, to, cost = order.tolist(), cols[order].tolist(), (-weight[order].astype(float)).tolist()
    u, v = [0.0] * (len(start) - 1), [0.0] * (int(cols.max(initial=-1)) + 1)
    row_of, pair_of = [-1] * len(v), [-1] * len(v)  # of each column, and the pair that holds it
    for s in range(len(u)):
        u[s] = min(0.0, min(cost[e] - v[to[e]] for e in range(start[s], start[s + 1])))
        far, seen, heap, came = {s: 0.0}, {}, [], {}  # distances of rows, of settled columns; how a column was reached
        best, alone = -u[s], s  # to leave a row alone costs nothing
        now, i, goal = 0.0, s, -1
        while True:
            for e in range(start[i], start[i + 1]):
                j = to[e]
                d = now + cost[e] - u[i] - v[j]
                if j not in seen and (j not in came or d < came[j][0]) and d < best:
                    came[j] = (d, i, e)
                    heappush(heap, (d, j))
            while heap and heap[0][1] in seen:
                heappop(heap)
            if not heap or heap[0][0] >= best:
                now = best
                break
            now, j = heappop(heap)
            if row_of[j] < 0:
                goal = j
                break
            seen[j], i = now, row_of[j]
            far[i] = now
            if now - u[i] < best:
                best, alone = now - u[i], i
        for r, d in far.items():
            u[r] += now - d
        for c, d in seen.items():
            v[c] -= now - d
        if goal < 0:  # a row on the way gives up its column
            if alone == s:
                continue
            goal = next(c for c in seen if row_of[c] == alone)
        while True:
            _, i, e = came[goal]
            before = next((c for c in seen if row_of[c] == i), -1) if i != s else -1
            row_of[goal], pair_of[goal] = i, pair[e]
            if i == s:
                break
            goal = before
    return sorted(p for p in pair_of if p >= 0)


def assign(truth: DataFrame, found: DataFrame, least_iou: float = 0.2) -> DataFrame:
    """(ds, tid, did, iou): the one-to-one assignment of greatest total overlap, pairs below the limit dropped.

    Only overlapping pairs are gathered, per data set and per run of intervals that touch one
    another; a task holds one run's pairs, never a matrix.
    """
    from packetloom.operators import joins
    from packetloom.operators.grids import coverage

    pairs = iou_pairs(truth, found)
    both = truth.select("ds", F.col("a0").alias("lo"), F.col("a1").alias("hi")).union(found.select("ds", F.col("b0").alias("lo"), F.col("b1").alias("hi")))
    runs = coverage(both, "lo", "hi", ["ds"]).select("ds", F.col("lo").alias("run_lo"))
    t = joins.asof_backward(truth.select("ds", "tid", "a0"), runs, "a0", "run_lo", ["ds"], strict=False).select("tid", "run_lo")
    pairs = pairs.join(t, "tid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One run of intervals after another; the last of a batch waits until it is whole."""
        names, rest = ["ds", "tid", "did", "iou"], None

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            ds, at, tid, did, iou = (pdf[c].to_numpy() for c in ("ds", "run_lo", "tid", "did", "iou"))
            cuts = np.flatnonzero((ds[1:] != ds[:-1]) | (at[1:] != at[:-1])) + 1
            spans = zip([0, *cuts], [*cuts, len(pdf)], strict=True)
            kept = [a + p for a, b in spans for p in matched(tid[a:b], did[a:b], iou[a:b])]
            return pdf.iloc[[p for p in kept if iou[p] >= least_iou]][names]

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = (b["ds"] == b["ds"].iloc[-1]) & (b["run_lo"] == b["run_lo"].iloc[-1])
            if not last.all():
                yield done(b[~last])
            rest = b[last]
        if rest is not None and len(rest):
            yield done(rest)

    dealt = pairs.repartition("ds", "run_lo").sortWithinPartitions("ds", "run_lo", "tid", "did")
    return dealt.select("ds", "run_lo", "tid", "did", "iou").mapInPandas(run, "ds bigint, tid bigint, did bigint, iou double")


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def _f1(hits: Column, n_found: Column, n_truth: Column) -> Column:
    p, r = _ratio(hits, n_found, 1.0), _ratio(hits, n_truth, 1.0)
    return _ratio(2 * p * r, p + r, 0.0)


def scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row of measures for each data set of truth or detections.

    ``truth``: tid, ds, a0, a1, period, band, difficulty, decoy; ``found``: did, ds, b0, b1,
    period, band, peak. Detections are assigned to the truth that isn't a decoy; pairs that
    overlap by ``MATCH_IOU`` or more match. Empty denominators of precision, recall, band
    accuracy and decoy rejection give 1; means over no match are 0; the recall of a grade that a
    data set lacks is null. A decoy is found if any detection overlaps it by more than ``DECOY_IOU``.
    """
    real = truth.filter(~F.col("decoy"))
    pairs = assign(real.select("tid", "ds", "a0", "a1"), found.select("did", "ds", "b0", "b1"), 0.0)
    t = real.select("tid", F.col("period").alias("t_period"), F.col("band").alias("t_band"), "difficulty", ((F.col("a0") + F.col("a1")) / 2).alias("centre"))
    d = found.select("did", F.col("period").alias("d_period"), F.col("band").alias("d_band"), "peak")
    m = pairs.join(t, "tid").join(d, "did")
    hit, c = F.col("iou") >= MATCH_IOU, F.col
    error = F.when(c("t_period") > 0, F.abs(F.coalesce("d_period", F.lit(0.0)) - c("t_period")) / c("t_period") * 100).otherwise(0.0)
    same = F.when(c("t_band").isNull(), True).otherwise(F.coalesce(c("d_band") == c("t_band"), F.lit(False)))
    mean = lambda v: F.avg(F.when(hit, v))
    matched = m.groupBy("ds").agg(
        F.count_if(hit).alias("tp"), F.count_if(hit & same).alias("n_band"), mean(error).alias("period_error_mean"), F.percentile(F.when(hit, error), 0.5).alias("period_error_median"), F.sum(F.when(hit, error)).alias("period_error_sum"),
        mean(c("iou")).alias("mean_iou"), mean(c("peak") - c("centre")).alias("mean_latency"),
        *[F.count_if(c("iou") >= x).alias(f"tp_{round(100 * x)}") for x in IOU_LIMITS], *[F.count_if(hit & (c("difficulty") == g)).alias(f"tp_{g}") for g in DIFFICULTIES],
    )
    decoys = truth.filter("decoy")
    seen = iou_pairs(decoys.select("tid", "ds", "a0", "a1"), found.select("did", "ds", "b0", "b1")).filter(F.col("iou") > DECOY_IOU).select("tid").distinct()
    false = decoys.join(seen.withColumn("seen", F.lit(True)), "tid", "left").groupBy("ds").agg(F.count(F.lit(1)).alias("n_decoy"), F.count_if("seen").alias("n_decoy_found"))
    n_real = real.groupBy("ds").agg(F.count(F.lit(1)).alias("n_truth"), *[F.count_if(c("difficulty") == g).alias(f"n_{g}") for g in DIFFICULTIES])
    n_found = found.groupBy("ds").agg(F.count(F.lit(1)).alias("n_found"))
    x = n_real.join(n_found, "ds", "full").join(matched, "ds", "full").join(false, "ds", "full")
    x = x.select("ds", *[F.coalesce(n, F.lit(0)).alias(n) for n in x.columns if n != "ds"])
    out = {
        "precision": _ratio(c("tp"), c("n_found"), 1.0), "recall": _ratio(c("tp"), c("n_truth"), 1.0), "f1": _f1(c("tp"), c("n_found"), c("n_truth")), "band_accuracy": _ratio(c("n_band"), c("tp"), 1.0),
        "decoy_rejection": 1 - _ratio(c("n_decoy_found"), c("n_decoy"), 0.0),
    }
    some = (c("n_truth") > 0) & (c("n_found") > 0)
    out |= {f"f1_{round(100 * v)}": F.when(some, _f1(c(f"tp_{round(100 * v)}"), c("n_found"), c("n_truth"))).otherwise(0.0) for v in IOU_LIMITS}
    out |= {f"recall_{g}": F.try_divide(c(f"tp_{g}").cast("double"), c(f"n_{g}").cast("double")) for g in DIFFICULTIES}
    kept = ["n_truth", "n_found", "tp", "n_band", "n_decoy", "n_decoy_found", "mean_iou", "mean_latency", "period_error_mean", "period_error_median", "period_error_sum"]
    return x.select("ds", *kept, *[v.alias(n) for n, v in out.items()])


def suite(rows: DataFrame, tier: Column) -> DataFrame:
    """Totals over the data sets of ``scores``: micro measures, recall by tier, summary and composite.

    The summary is the harmonic mean of those of F1, band accuracy and decoy rejection that are
    positive; the composite weighs F1, band accuracy, period accuracy, decoy rejection and the
    mean of the positive overlaps.
    """
    c, f1_at = F.col, [f"f1_{round(100 * v)}" for v in IOU_LIMITS]
    sums = ["tp", "n_found", "n_truth", "n_band", "n_decoy", "n_decoy_found", "period_error_sum", *f1_at]
    live = F.when(c("mean_iou") > 0, c("mean_iou"))
    tiers = rows.groupBy(tier.cast("string").alias("tier")).agg(*[F.sum(n).alias(n) for n in sums], F.sum(live).alias("iou"), F.count(live).alias("n_iou"), F.count(F.lit(1)).alias("n_sets"))
    each = F.array_sort(F.collect_list(F.struct("tier", _ratio(c("tp"), c("n_truth"), 0.0).alias("recall")))).alias("tiers")  # a row per tier
    g = tiers.agg(*[F.sum(n).alias(n) for n in (*sums, "iou", "n_iou", "n_sets")], each)
    g = g.withColumns({n: c(n) / c("n_sets") for n in f1_at} | {"iou": F.try_divide(c("iou"), c("n_iou"))})
    p, r = _ratio(c("tp"), c("n_found"), 1.0), _ratio(c("tp"), c("n_truth"), 1.0)
    g = g.select("*", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r, 0.0).alias("f1"), _ratio(c("n_band"), c("tp"), 1.0).alias("band_accuracy"), (1 - _ratio(c("n_decoy_found"), c("n_decoy"), 0.0)).alias("decoy_rejection"))
    parts = F.filter(F.array("f1", "band_accuracy", "decoy_rejection"), lambda v: v > 0)
    inverse = F.aggregate(parts, F.lit(0.0), lambda a, v: a + 1 / v)
    period = F.greatest(F.lit(0.0), 1 - F.when(c("tp") > 0, c("period_error_sum") / c("tp")).otherwise(100.0) / 100)
    five = [c("f1"), c("band_accuracy"), period, c("decoy_rejection"), F.coalesce("iou", F.lit(0.0))]
    composite = sum(WEIGHTS) / sum((w / F.greatest(v, F.lit(1e-10)) for v, w in zip(five[1:], WEIGHTS[1:], strict=True)), WEIGHTS[0] / F.greatest(five[0], F.lit(1e-10)))
    names = ["tp", "n_found", "n_truth", "precision", "recall", "f1", "band_accuracy", "decoy_rejection", *f1_at, "tiers"]
    return g.select(*names, F.when(F.size(parts) > 0, F.size(parts) / inverse).otherwise(0.0).alias("summary"), composite.alias("composite"))


def harmonic(values: list, weights: tuple[float, ...] = WEIGHTS):
    """Weighted harmonic mean of columns; zero if any is zero."""
    total = sum(weights)
    inverse = sum((w * F.try_divide(F.lit(1.0), v) for v, w in zip(values[1:], weights[1:], strict=True)), weights[0] * F.try_divide(F.lit(1.0), values[0]))
    return F.coalesce(F.try_divide(F.lit(total), inverse), F.lit(0.0))

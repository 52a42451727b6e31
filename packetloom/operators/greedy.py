"""Greedy passes over a whole ordered table, in many tasks, with the result of one long pass.

A greedy pass decides about each row from what it still holds of the rows before, so its rows seem
to need one task. Here the order is dealt into ranges, and all ranges are walked at once, each
from nothing. Then every range compares what it began with and what the range before it handed
on; where they differ it is walked again from the latter. That ends at the latest after as many
rounds as there are ranges, and in two or three as soon as what a pass holds no longer shows
where it began, which a gap brings about; dense rows alone may never do so. What is handed
on is the window's content only. For that, ranges last many windows, however dense the rows are:
a task reads its rows one after another and holds one window of them.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from packetloom.operators import joins
from packetloom.session import staged

#: Tasks of a round, at most.
MOST_TASKS = 4096
#: Windows that a range lasts at least.
WINDOWS = 32


class Duplicates:
    """Walking back over the kept rows until one is out of ``dt``, the first within ``tol`` of its period makes a row a duplicate.

    The larger quality takes the place in the list, the earlier of equals. Rows are (time, id,
    period, quality).
    """

    values = ("t", "event_id", "period_min", "q_factor")

    def __init__(self, dt: float, tol: float):
        self.dt, self.tol = dt, tol

    def begin(self, rows: list) -> "Window":
        return Window(self.dt, self.tol, rows)

    def state(self, held: "Window") -> list:
        return held.rows()

    def prune(self, held: "Window", t: float) -> list[int]:
        """Let go of rows that no row from time ``t`` on can get back to."""
        return held.prune(t)

    def take(self, held: "Window", t: float, i: int, p: float, q: float) -> list[int]:
        """Ids that are kept for good now."""
        done, at = held.prune(t), held.last_near(p)
        if at is None:
            held.add([t, i, p, q])
        elif q > held.of[at][3]:
            held.put(at, [t, i, p, q])
        return done

    def rest(self, held: "Window") -> list[int]:
        return [x[1] for x in held.rows()]


class Window:
    """The kept rows that a walk still reaches, in the order of their places, found by period.

    A row that is out of ``dt`` ends the walk for good, so it and all before it go. Periods stand in
    steps of the tolerance, of which a row looks into the few next to its own; those without a
    usual logarithm are looked through one by one.
    """

    def __init__(self, dt: float, tol: float, rows: list):
        self.dt, self.tol, self.of, self.next = dt, tol, {}, 0
        self.width = max(math.log1p(tol), 1e-3)
        self.up, self.down = (-math.log1p(-tol), math.log1p(tol)) if 0 <= tol < 1 else (None, None)
        self.steps: dict[int | None, list[int]] = {}
        self.times: deque[tuple[float, int]] = deque()
        for row in rows:
            self.add(row)
        self.times = deque(sorted(self.times))

    def rows(self) -> list:
        return list(self.of.values())

    def step(self, p: float) -> int | None:
        return math.floor(math.log(p) / self.width) if 1e-6 < p < 1e12 else None

    def put(self, at: int, row: list) -> None:
        if at in self.of:
            self.steps[self.step(self.of[at][2])].remove(at)
        self.of[at] = row
        self.steps.setdefault(self.step(row[2]), []).append(at)
        self.times.append((row[0], at))

    def add(self, row: list) -> None:
        self.put(self.next, row)
        self.next += 1

    def prune(self, t: float) -> list[int]:
        gone = -1
        while self.times and t - self.times[0][0] > self.dt:
            then, at = self.times.popleft()
            if at in self.of and self.of[at][0] == then:  # not one that another has taken the place of
                gone = max(gone, at)
        done = []
        if gone >= 0:
            for at in list(self.of):
                if at > gone:
                    break
                row = self.of.pop(at)
                self.steps[self.step(row[2])].remove(at)
                done.append(row[1])
        return done

    def last_near(self, p: float) -> int | None:
        """Place of the last row whose period is within the tolerance."""
        if self.step(p) is None or self.up is None:
            places = self.of
        else:
            at = math.log(p)
            lo, hi = math.floor((at - self.down - 1e-9) / self.width), math.floor((at + self.up + 1e-9) / self.width)
            places = [k for s in (None, *range(lo, hi + 1)) for k in self.steps.get(s, ())]
        near = [k for k in places if abs(p - self.of[k][2]) / max(self.of[k][2], 1e-9) <= self.tol]
        return max(near) if near else None


class Peaks:
    """A row goes if a kept one is less than ``dt`` before it and less than ``octave`` away in period. Rows are (time, id, period)."""

    values = ("t", "event_id", "period_min")

    def __init__(self, dt: float, octave: float):
        self.dt, self.octave = dt, octave

    def begin(self, rows: list) -> list:
        return rows

    def state(self, held: list) -> list:
        return held

    def prune(self, held: list, t: float) -> list[int]:
        held[:] = [x for x in held if t - x[0] < self.dt]
        return []

    def take(self, held: list, t: float, i: int, p: float) -> list[int]:
        self.prune(held, t)
        if any(abs(np.log2(p / x[1])) < self.octave for x in held):
            return []
        held.append([t, p])
        return [i]

    def rest(self, held: list) -> list[int]:
        return []


def kept_ids(rows: DataFrame, keys: list[str], rule, rows_per_part: int | None = None) -> DataFrame:
    """(kept_id) of the rows that ``rule`` keeps, each key walked on its own in order of the rule's values.

    ``rows`` has no nulls among these values. A key of any size, or a table without keys, is
    dealt among tasks. Without ``rows_per_part`` a range of a table without keys lasts ``WINDOWS``
    windows at least.
    """
    values = list(rule.values)
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    x = staged(rows.select(*keys, *values, key.alias("key")), "walk")
    kinds = dict(x.dtypes)
    if rows_per_part is None:
        rows_per_part = joins.ROWS_PER_PART
        if not keys:
            count, since, until = x.agg(F.count(F.lit(1)), F.min(values[0]), F.max(values[0])).first()
            rows_per_part = max(rows_per_part, math.ceil(count * min(1.0, WINDOWS * rule.dt / max(until - since, 1e-9)))) if count else rows_per_part
    part, n = joins.ranges(x, [*keys, values[0]], rows_per_part)
    x = x.withColumn("part", part(*[F.col(c) for c in (*keys, values[0])]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, given, of, held, kept, last = None, None, "", rule.begin([]), [], None

        def handed() -> pd.DataFrame:
            done = kept + (rule.prune(held, last) if last is not None else [])
            state = rule.state(held)
            return pd.DataFrame({"part": [own], "given": [given], "handed": [json.dumps([of, state]) if state else ""], "kept": [done]})

        for b in batches:
            for part, state, key, *row in zip(b["part"], b["given"], b["key"], *[b[v] for v in values], strict=True):
                if part != own:  # a range begins with the row that tells its state
                    if own is not None:
                        yield handed()
                    own, given, kept, last = part, state, [], None
                    of, held = json.loads(state) if state else ("", [])
                    held = rule.begin(held)
                    continue
                if key != of:
                    kept += rule.rest(held)
                    of, held = key, rule.begin([])
                kept += rule.take(held, *row)
                last = row[0]
        if own is not None:
            yield handed()

    def walked(starts: DataFrame) -> DataFrame:
        heads = starts.select("part", F.lit(0).alias("head"), "given", *[F.lit(0).cast(kinds[v]).alias(v) for v in values])  # a null would turn ids into doubles
        own = x.join(F.broadcast(starts.select("part")), "part", "left_semi").withColumn("head", F.lit(1))  # one row per range
        dealt = heads.unionByName(own, allowMissingColumns=True).repartition(min(n, MOST_TASKS), "part").sortWithinPartitions("part", "head", *keys, *values)
        dealt = dealt.select("part", "given", "key", *values)
        return dealt.mapInPandas(run, "part int, given string, handed string, kept array<bigint>")

    done = staged(walked(x.select("part").distinct().withColumn("given", F.lit(""))), "walked")
    before = Over.orderBy("part")  # one row per range
    while n > 1:
        now = done.withColumn("due", F.coalesce(F.lag("handed").over(before), F.lit("")))
        if not now.filter("due <> given").limit(1).count():
            break
        again = walked(now.filter("due <> given").select("part", F.col("due").alias("given")))
        done = staged(now.filter("due = given").drop("due").unionByName(again), "walked")
    end = done.orderBy(F.desc("part")).select("handed").first()
    rest = rule.rest(rule.begin(json.loads(end[0])[1])) if end and end[0] else []  # the last window's content
    last = x.sparkSession.createDataFrame([(i,) for i in rest], "kept_id bigint")
    return done.select(F.explode("kept").alias("kept_id")).unionByName(last)


def tag_duplicates(catalogue: DataFrame, dt: float = 7200.0, tol: float = 0.10, rows_per_part: int | None = None) -> DataFrame:
    """Catalogue (event_id, t, period_min, q_factor) with ``is_duplicate``, over the whole table at once.

    Rows without a time or a period are no duplicates and make none; one without a quality gives
    way to nothing and takes no place. Rows at one time count in order of their ids.
    """
    whole = F.col("t").isNotNull() & F.col("period_min").isNotNull()
    of = catalogue.filter(whole).select(F.col("t").cast("double"), "event_id", F.col("period_min").cast("double"), F.coalesce(F.col("q_factor").cast("double"), F.lit(float("nan"))).alias("q_factor"))
    kept = kept_ids(of, [], Duplicates(dt, tol), rows_per_part)
    out = catalogue.join(kept, catalogue["event_id"] == F.col("kept_id"), "left")
    return out.select(*catalogue.columns, (F.col("kept_id").isNull() & whole).alias("is_duplicate"))


def collapse_duplicates(catalogue: DataFrame, dt: float = 7200.0, tol: float = 0.10, rows_per_part: int | None = None) -> DataFrame:
    """The catalogue without its duplicates."""
    return tag_duplicates(catalogue, dt, tol, rows_per_part).filter(~F.col("is_duplicate")).drop("is_duplicate")


def dedup_peaks(peaks: DataFrame, keys: list[str], dt: float = 7200.0, octave: float = 0.5, rows_per_part: int | None = None) -> DataFrame:
    """Peaks of each key without those close to an earlier kept one: strictly within ``dt`` and ``octave``; null periods stay."""
    of = peaks.filter("period_min IS NOT NULL").select(*keys, F.col("t").cast("double"), "event_id", F.col("period_min").cast("double"))
    kept = kept_ids(of, keys, Peaks(dt, octave), rows_per_part).withColumnRenamed("kept_id", "event_id")
    return peaks.join(kept, "event_id", "left_semi").unionByName(peaks.filter("period_min IS NULL"))

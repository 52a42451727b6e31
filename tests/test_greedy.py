"""Parallel greedy passes against one pass in plain Python."""

import math
import random

import pytest

from packetloom.operators import greedy
from packetloom.plans import catalogue

COLS = "t double, event_id bigint, period_min double, q_factor double"


def one_pass(rows, dt, tol):
    kept, dup = [], set()
    for t, i, p, q in sorted(rows):
        for k in range(len(kept) - 1, -1, -1):
            if t - kept[k][0] > dt:
                kept.append((t, i, p, q))
                break
            if abs(p - kept[k][2]) / max(kept[k][2], 1e-9) <= tol:
                if q > kept[k][3]:
                    dup.add(kept[k][1])
                    kept[k] = (t, i, p, q)
                else:
                    dup.add(i)
                break
        else:
            kept.append((t, i, p, q))
    return dup


def found(df, *a, **k):
    return {r.event_id for r in greedy.tag_duplicates(df, *a, **k).filter("is_duplicate").collect()}


@pytest.mark.parametrize("rows_per_part", [10, 40, 20_000])
@pytest.mark.parametrize("span", [2e4, 2e5, 2e6])
def test_whole_catalogue_equals_one_pass(spark, rows_per_part, span):
    """From one dense island to many; ranges shorter than the window, and about as long."""
    rng = random.Random(int(span) + rows_per_part)
    rows = [(float(round(rng.uniform(0, span), -1)), i, rng.uniform(10, 100), round(rng.uniform(3, 8), 1)) for i in range(400)]
    assert found(spark.createDataFrame(rows, COLS), 3000.0, 0.3, rows_per_part=rows_per_part) == one_pass(rows, 3000.0, 0.3)


def test_a_chain_that_hands_its_state_through_every_range(spark):
    """Each row takes the place of the one before it, so what the first range knows decides all the others."""
    rows = [(10.0 * i, i, 60.0, 1.0 + i) for i in range(120)] + [(5.0, 1000, 200.0, 1.0)]
    assert found(spark.createDataFrame(rows, COLS), rows_per_part=8) == one_pass(rows, 7200.0, 0.10) == set(range(119))


def test_copies_in_neighbouring_segments_and_across_band_edges(spark):
    df = spark.createDataFrame([(0.0, 1, 60.0, 5.46), (30.0, 2, 60.0, 5.47), (9000.0, 3, 60.0, 1.0), (100.0, 4, 39.0, 2.0), (200.0, 5, 41.0, 1.0)], COLS)
    assert found(df) == {1, 5}
    assert found(df, 20.0) == set()
    assert greedy.tag_duplicates(df.limit(0)).columns == [*df.columns, "is_duplicate"] and greedy.tag_duplicates(df.limit(0)).count() == 0
    tie = spark.createDataFrame([(0.0, 1, 60.0, 5.0), (30.0, 2, 60.0, 5.0)], COLS)
    assert found(tie) == {2} and [r.event_id for r in greedy.collapse_duplicates(tie).collect()] == [1]


def test_rows_without_time_period_or_quality(spark):
    df = spark.createDataFrame([(0.0, 1, 60.0, None), (10.0, 2, 60.0, 9.0), (None, 3, 60.0, 1.0), (20.0, 4, None, 1.0), (30.0, 5, 60.0, None)], COLS)
    assert {r.event_id: r.is_duplicate for r in greedy.tag_duplicates(df).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}


@pytest.mark.parametrize("rows_per_part", [9, 20_000])
def test_peaks_of_each_key(spark, rows_per_part):
    df = spark.createDataFrame([(1, 1, 0.0, 60.0), (1, 2, 7199.0, 60.0), (1, 3, 7200.0, 60.0), (1, 4, 10.0, None), (1, 5, 20.0, 60.0 * 2**0.5)], "seg int, event_id bigint, t double, period_min double")
    assert {r.event_id for r in greedy.dedup_peaks(df, ["seg"]).collect()} == {1, 3, 4, 5}
    rng = random.Random(8)
    rows = [(rng.randrange(3), i, rng.uniform(0, 90_000), rng.uniform(20, 200)) for i in range(300)]
    want, held = set(), {}
    for s, i, t, p in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if not any(t - u < 7200 and abs(math.log2(p / v)) < 0.5 for u, v in held.get(s, [])):
            want.add(i)
            held.setdefault(s, []).append((t, p))
    got = greedy.dedup_peaks(spark.createDataFrame(rows, df.schema), ["seg"], rows_per_part=rows_per_part)
    assert {r.event_id for r in got.collect()} == want


def test_registered_query_is_one_pass_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    from packetloom.plans.q_windows import sparse_catalogue

    rows = [tuple(r) for r in sparse_catalogue(spark, d).select("t", "event_id", "period_min", "q_factor").collect()]
    got = {r.event_id for r in catalogue.queries()["win_dedup_catalogue"](spark, d).filter("is_duplicate").collect()}
    assert got == one_pass(rows, 7200.0, 0.10) and got


@pytest.mark.parametrize("tol", [0.0, 0.02, 0.10, 0.6, 1.5])
def test_window_by_period_walks_as_the_loop_does(tol):
    """Dense, repeated, tiny, huge and missing periods, against the row by row walk back."""
    rng = random.Random(int(tol * 100))
    odd = [1e-9, 1e-7, 1e-6, 1e13, math.nan]
    rows = sorted((float(rng.randrange(0, 40_000, 20)), i, rng.choice(odd) if i % 29 == 0 else math.exp(rng.uniform(-3, 7)) if i % 3 else round(rng.uniform(10, 40)) * 1.0, round(rng.uniform(3, 8), 1)) for i in range(4000))
    rule = greedy.Duplicates(3000.0, tol)
    held, kept = rule.begin([]), []
    for n, row in enumerate(rows):
        kept += rule.take(held, *row)
        if n % 500 == 0:
            held = rule.begin([list(x) for x in rule.state(held)])  # as it is handed on
    assert set(kept) | set(rule.rest(held)) == {r[1] for r in rows} - one_pass(rows, 3000.0, tol)


def test_ranges_last_many_windows_however_dense_the_rows_are(spark, monkeypatch):
    """The rounds of the walk don't grow with the rows: a range isn't shorter than what a walk takes to forget its beginning."""
    from packetloom.operators import joins

    asked = []
    ranges = joins.ranges
    monkeypatch.setattr(joins, "ROWS_PER_PART", 10)
    monkeypatch.setattr(joins, "ranges", lambda x, order, n: asked.append(n) or ranges(x, order, n))
    rows = [(t * 10.0, t, 60.0 + t % 7 * 20, 1.0 + t % 5) for t in range(2000)]
    assert found(spark.createDataFrame(rows, COLS), 50.0, 0.10) == one_pass(rows, 50.0, 0.10)
    assert asked == [math.ceil(2000 * greedy.WINDOWS * 50 / 19_990)]

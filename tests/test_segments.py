"""Merges of ordered sets and elementary segments against brute force, in slices of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from lumaprof.operators import frames, lookup


def first_plainly(points, intervals):
    """Per (key, point) the id of the narrowest interval, then the least id."""
    out = set()
    for k, p in points:
        inside = [(hi - lo, i) for kk, i, lo, hi in intervals if kk == k and lo <= p < hi]
        if inside:
            out.add((k, p, min(inside)[1]))
    return out


def first_found(spark, points, intervals, slice_rows):
    table = spark.createDataFrame(intervals, "k string, i bigint, lo bigint, hi bigint").withColumn("w", F.col("hi") - F.col("lo"))
    found = lookup.first_containing(spark.createDataFrame(points, "k string, p bigint"), table, "p", "lo", "hi", ["w", "i"], ["i"],
                                    by=["k"], slice_rows=slice_rows)
    return {tuple(r) for r in found.select("k", "p", "i").collect()}


@pytest.mark.parametrize("slice_rows", [None, 7])
def test_first_containing_equals_brute_force(spark, slice_rows):
    random.seed(11)
    intervals = [(random.choice("aab"), i, lo, lo + random.choice([-3, 0, 1, 2, 9, 80, 700, 3000])) for i, lo in enumerate(random.choices(range(3000), k=150))]
    points = [(random.choice("abc"), random.randrange(-20, 4000)) for _ in range(500)]
    assert first_found(spark, points, intervals, slice_rows) == first_plainly(points, intervals)


def test_forty_nested_sizes_take_one_step_a_point(spark):
    nested = [("a", i, 2 ** 40 - 2 ** i, 2 ** 40 + 2 ** i) for i in range(40)] + [("a", 100 + n, 5 * n, 5 * n + 3) for n in range(60)]
    points = [("a", 2 ** 40 + s * (2 ** i + d)) for i in range(40) for s in (-1, 1) for d in (-1, 0, 1)] + [("a", n) for n in range(310)]
    assert first_found(spark, points, nested, 5) == first_plainly(points, nested)
    table = spark.createDataFrame(nested, "k string, i bigint, lo bigint, hi bigint").withColumn("w", F.col("hi") - F.col("lo"))
    cut = lookup.segments(table, "lo", "hi", ["w", "i"], ["i"], by=["k"], slice_rows=5)
    # One segment per change of the narrowest interval: two per nested interval, less one in the middle, and two per small one.
    assert cut.count() == cut.select("k", "_at").distinct().count() <= 2 * len(nested)


def test_an_interval_over_many_slices_is_filed_under_few_nodes(spark):
    wide = [("a", 0, -1, 10 ** 6), ("a", 1, 100, 90_000)] + [("a", 2 + n, 50 * n, 50 * n + 9) for n in range(2000)]
    points = [("a", n) for n in range(0, 101_000, 37)]
    assert first_found(spark, points, wide, 40) == first_plainly(points, wide)


def test_no_intervals_and_no_points(spark):
    assert first_found(spark, [("a", 1)], [], None) == set()
    assert first_found(spark, [], [("a", 1, 0, 5)], None) == set()


def test_merged_before_equals_brute_force(spark):
    random.seed(6)
    marks = {(k, random.randrange(10000)) for k in "ab" for _ in range(60)}
    points = {(k, random.randrange(12000)) for k in "abc" for _ in range(200)}
    expected = {(k, p, max((m for kk, m in marks if kk == k and m <= p), default=None)) for k, p in points}
    for slice_rows in (None, 9):
        found = lookup.merged_before(spark.createDataFrame(list(points), "k string, p bigint"), spark.createDataFrame(list(marks), "k string, m bigint"),
                                     ["k"], "p", "m", [], slice_rows)
        assert {tuple(r) for r in found.collect()} == expected


def test_samples_keep_their_rows_and_frames_their_ends(spark):
    samples = spark.createDataFrame([("e", t, [t, 1]) for t in (0, 4, 5, 5, 9, 10, 99)] + [("f", 5, [7])], "event string, time bigint, funcs array<bigint>")
    cut = spark.createDataFrame([("e", 0, 4, 9), ("e", 1, 9, 20)], "event string, frame_idx bigint, start bigint, end bigint")
    assert sorted((r.time, r.frame_idx) for r in frames.in_frames(samples, cut).collect()) == [(4, 0), (5, 0), (5, 0), (9, 1), (10, 1)]


def test_medians_of_large_groups_and_ties(spark):
    random.seed(3)
    rows = [("ties", 7)] * 3000 + [("ties", n) for n in range(50)] + [("wide", random.randrange(-10 ** 12, 10 ** 12)) for _ in range(5001)] + [("two", 1), ("two", 4)]
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    import statistics

    found = frames._medians(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", error=0.01)
    assert {r.k: r["median"] for r in found.collect()} == {k: statistics.median(v) for k, v in groups.items()}

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumaprof.operators import callstacks, counters, frames, latency, layout, lines, lookup, resolve, reuse, sampling, views
from lumaprof.operators.sampling import Baseline


def values(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows.select(*columns).collect())


def test_two_samples_of_one_address(spark):
    samples = spark.createDataFrame([(0, 1, 64, 0, 101, 10, [128]), (0, 1, 64, 7, 102, 20, [128, 128])],
                                    "event_key_ref bigint, mapping_id bigint, ip bigint, cpu bigint, tid bigint, period bigint, callchain array<bigint>")
    catalog = spark.createDataFrame([(0, "cpu_cycles")], "ordinal bigint, event_key string")
    known = counters.with_event_key(samples, catalog)
    assert values(counters.by_address(known), "ip", "self_weight", "self_samples", "acc_weight", "acc_samples") == [
        (64, 30, 2, 0, 0), (128, 0, 0, 50, 3)]
    assert len(values(counters.ids_by_address(known), "ip", "cpu", "tid")) == 4


def test_interval_lookup_against_brute_force(spark):
    random.seed(5)
    intervals = [(i, lo, lo + random.choice([1, 2, 3, 7, 64, 1000, 5000])) for i, lo in enumerate(random.choices(range(4000), k=120))]
    points = random.sample(range(5000), 400)
    expected = sorted((p, i) for p in points for i, lo, hi in intervals if lo <= p < hi)
    p = spark.createDataFrame([(x,) for x in points], "p bigint")
    t = spark.createDataFrame(intervals, "i bigint, lo bigint, hi bigint")
    assert values(lookup.containing(p, t, "p", "lo", "hi"), "p", "i") == expected


def test_latest_before_against_brute_force(spark):
    random.seed(6)
    marks = {(k, random.randrange(10000)) for k in "ab" for _ in range(60)}
    points = {(k, random.randrange(12000)) for k in "abc" for _ in range(200)}
    expected = sorted((k, p, max((m for kk, m in marks if kk == k and m <= p), default=-1)) for k, p in points)
    found = lookup.latest_before(spark.createDataFrame(list(points), "k string, p bigint"), spark.createDataFrame(list(marks), "k string, m bigint"),
                                 ["k"], "p", "m", [], page_bits=6)
    assert values(found.withColumn("m", F.coalesce("m", F.lit(-1))), "k", "p", "m") == expected


def test_dense_ids_follow_the_order(spark):
    random.seed(7)
    rows = [(random.randrange(50), f"n{i}") for i in range(300)]
    numbered = lookup.dense_ids(spark.createDataFrame(rows, "t bigint, n string"), ["t", "n"], "id", slice_rows=40)
    assert values(numbered, "id", "n") == [(i, n) for i, (_, n) in enumerate(sorted(rows))]


def test_smallest_symbol_wins_at_one_address(spark):
    symbols = spark.createDataFrame([
        ("m", 100, 8, "a"), ("m", 100, 6, "b"), ("m", 100, 4, "a"), ("m", 200, 8, "c"), ("m", 200, 4, "c"), ("m", 0, 9, "z"), ("m", 300, 0, "open")],
        "module_id string, address bigint, size bigint, name string")
    assert values(resolve.address_symbols(symbols), "address", "size", "name") == [(100, 4, "a"), (200, 8, "c"), (300, 0, "open")]
    at = spark.createDataFrame([("m", r) for r in (50, 103, 104, 207, 208, 9999)], "module_id string, rel bigint")
    assert {r.rel: r["name"] for r in resolve.symbol_names(at, symbols).collect()} == {
        50: None, 103: "a", 104: None, 207: "c", 208: None, 9999: "open"}


def test_tagged_and_nested_mappings(spark):
    maps = spark.createDataFrame([
        (1, 0x7000000000, 0x7700000000, 0, 0, "wide", 0), (2, 0x76A8F00000, 0x76A8F60000, 0, 0, "narrow", 1), (3, 0x5000, 0x6000, 0, 0, "other", 2)],
        "mapping_id bigint, start bigint, end bigint, offset bigint, load_bias bigint, module_id string, pos bigint")
    tagged = 0x80000076A8F50DA0 - (1 << 64)
    addresses = spark.createDataFrame([(0, tagged), (3, 0x76A8F50DA0), (9, 0x5000)], "mapping_id bigint, ip bigint")
    found = {(r.mapping_id, r.ip): (r.module_id, r.rel) for r in resolve.to_module(addresses, maps).collect()}
    assert found[(0, tagged)] == ("narrow", 0x50DA0)
    # A nonzero id never falls back to a range lookup.
    assert found[(3, 0x76A8F50DA0)] == (None, None) and found[(9, 0x5000)] == (None, None)


def test_latency_tails(spark):
    samples = spark.createDataFrame([("x", v) for v in [10] * 18 + [100, 1000]], "name string, latency bigint")
    freq = latency.frequency(samples.withColumns({"file": F.lit("f"), "line": F.lit(1)}), ["file", "line", "name"])
    metrics = {r.metric: r.value.value for r in sampling.line_metrics(freq, Baseline(1e6, 100.0)).collect()}
    assert (metrics["p95_latency_cycles"], metrics["p99_latency_cycles"]) == (100, 1000)
    assert metrics["over_p95_est_time_pct"] == pytest.approx(78.125) and metrics["over_avg_est_time_pct"] == pytest.approx(85.9375)
    assert metrics["over_p95_all_est_time_pct"] == pytest.approx(10) and metrics["over_avg_all_est_time_pct"] == pytest.approx(11)


def test_breakdown_shares(spark):
    rows = [(0, "load_l1", "scalar_load", 60)] + [(0, "load_l1", "vector_load", v) for v in (10, 10, 20)] + [(0, "store_l1", "scalar_store", 100)]
    base = latency.frequency(spark.createDataFrame(rows, "cpu bigint, category string, child string, latency bigint"), ["cpu", "category", "child"])
    wide = {(r.category, r.child): r for r in sampling.breakdown(sampling.hierarchy_frequency(base, ["cpu"])).collect()}
    child = wide[("load_l1", "scalar_load")]
    assert child.sample_pct.value == 25 and child.est_time_pct.value == 60 and child.all_est_time_pct.value == 30
    assert wide[("load_l1", None)].est_time_pct.value == 50


def test_histogram_keeps_empty_bins_and_single_values(spark):
    freq = spark.createDataFrame([("a", 5, 3), ("b", 0, 1), ("b", 100, 29), ("c", None, 4)], "k string, latency bigint, cnt bigint")
    bins = latency.histogram(freq, ["k"]).collect()
    assert [(b.start_latency_cycles, b.end_latency_cycles, b.bin_count) for b in bins if b.k == "a"] == [(5, 5, 3)]
    b = sorted((x.bin, x.start_latency_cycles, x.end_latency_cycles, x.bin_count) for x in bins if x.k == "b")
    assert len(b) == 20 and b[0] == (0, 0, 5, 1) and b[16] == (16, 96, 100, 29) and b[19] == (19, 114, 100, 0)
    assert not [x for x in bins if x.k == "c"]


def test_percentages(spark):
    rows = spark.createDataFrame([("f", 5.0, 20.0), ("f", 5.0, 20.0), ("g", 90.0, 160.0)], "file string, self_weight double, accumulated_weight double")
    first = lines.percentages(rows).filter("file = 'f'").first()
    assert (first.p_pct, first.acc_p_pct, first.file_p_pct, first.file_acc_p_pct) == (5, 10, 50, 50)


def _stacks(spark, stacks):
    rows = [("e", 1, 1, w, n, [(f, 0, name) for f, name in calls]) for calls, w, n in stacks]
    return spark.createDataFrame(rows, "event string, pid bigint, tid bigint, weight bigint, samples bigint, "
                                 "calls array<struct<func:bigint,lib:bigint,name:string>>")


def test_recursion_counts_once_in_functions_and_stays_in_trees(spark):
    stacks = _stacks(spark, [([(1, "f"), (1, "f"), (0, "main")], 10, 2), ([(0, "main")], 5, 1)])
    assert values(callstacks.function_rows(stacks), "func", "sample_count", "self", "subtree") == [(0, 1, 5, 15), (1, 2, 10, 10)]
    assert values(callstacks.call_tree(stacks), "depth", "func", "self", "subtree") == [(1, 0, 5, 15), (2, 1, 0, 10), (3, 1, 10, 10)]


def _flame_reference(stacks):
    """Recursive layout over nested dictionaries, for the comparison only."""
    def insert(node, path, w):
        node["s"] += w
        if path:
            child = node["c"].setdefault(path[0][0], {"f": path[0][0], "n": path[0][1], "s": 0, "c": {}})
            insert(child, path[1:], w)

    root = {"s": 0, "c": {}}
    for calls, w, _ in stacks:
        insert(root, list(reversed(calls)), w)
    out = []

    def split(nodes):
        by_name = defaultdict(list)
        for node in nodes:
            for child in node["c"].values():
                by_name[child["n"]].append(child)
        return [by_name[n] for n in sorted(by_name)]

    def render(group, depth, x):
        total = sum(n["s"] for n in group)
        width = total * 100.0 / root["s"]
        if width < 0.1:
            return x
        out.append((depth, group[0]["n"], total, round(x, 6)))
        children = split(group) if len(group) > 1 else [[c] for c in sorted(group[0]["c"].values(), key=lambda c: (c["n"], c["f"]))]
        at = x
        for child in children:
            at = render(child, depth + 1, at)
        return x + width

    x = 0.0
    for group in split([root]):
        x = render(group, 0, x)
    return sorted(out)


def test_flame_layout_against_recursive_layout(spark):
    random.seed(11)
    stacks = []
    for _ in range(300):
        path = [(random.randrange(3), "r")] if random.random() < .5 else [(7, "s")]
        for depth in range(random.randrange(5)):
            f = random.randrange(8)
            path.append((10 * depth + f, f"n{f // 2}"))
        stacks.append((list(reversed(path)), random.choice([1, 5, 400]), 1))
    found = layout.flame(_stacks(spark, stacks), 0.1)
    assert sorted((r.depth, r["name"], r.subtree, round(r.x, 6)) for r in found.collect()) == _flame_reference(stacks)


def test_frame_gap_is_to_the_previous_marker(spark):
    gap = 1000
    times = [0, 900, 1800, 5000, 9000, 9500]  # the first three are one start
    rows = [("cpu-cycles", 1, 2, "RHIThread", t, 10, [5, 1]) for t in times] + [("cpu-cycles", 1, 3, "GameThread", t, 7, [9, 9]) for t in (100, 5100, 8999)]
    samples = spark.createDataFrame(rows, "event string, pid bigint, tid bigint, comm string, time bigint, period bigint, funcs array<bigint>")
    names = frames.first_names(samples)
    found = frames.boundaries(samples, names, F.lit(1), gap)
    assert values(found, "frame_idx", "start", "end") == [(0, 0, 5000), (1, 5000, 9000)]
    placed = frames.in_frames(samples, found)
    totals = frames.frame_totals(placed, found, frames.matching_threads(names))
    assert values(totals, "tid", "frame_idx", "total") == [(2, 0, 30), (2, 1, 10), (3, 0, 7), (3, 1, 14)]


def test_exact_medians(spark):
    random.seed(13)
    rows = [(k, random.randrange(10 ** 6)) for k in range(5) for _ in range(random.randrange(1, 40))]
    by = defaultdict(list)
    for k, x in rows:
        by[k].append(x)
    import statistics

    found = frames._medians(spark.createDataFrame(rows, "k bigint, v bigint"), ["k"], "v")
    assert dict(values(found, "k", "median")) == {k: statistics.median(v) for k, v in by.items()}


def test_sort_keys_and_page_limits():
    assert [views.page_limit(x) for x in (None, 0, 5, 99999)] == [1000, 1, 5, 99999]
    assert views.metric_column("load_l1.sample_pct") == "spe_json"
    assert views.metric_column("instruction_class.branch.sample_count") == "instruction_json"
    assert views.metric_column("load_instruction.load_acquire.p95_latency_cycles") == "load_instruction_json"
    assert views.metric_column("stall_backend") == "pmu_json"
    assert views.metric_column("bad'; key") is None and views.metric_column("load_l1.nothing") is None


def test_substring_thread_filter(spark):
    rows = spark.createDataFrame([("1",), ("10,2",), ("2",)], "thread string")
    assert values(views.filter_lines(rows, views.LineFilter(thread="1")), "thread") == [("1",), ("10,2",)]


def test_deep_stacks_and_long_function_lists_stay_whole(spark):
    frames_ = [("lib", f"f{i}", i, 1) for i in range(1000)]
    samples = spark.createDataFrame([("e", 1, 2, frames_, 3)],
                                    "event string, pid bigint, tid bigint, frames array<struct<lib:string,symbol:string,addr:bigint,len:bigint>>, period bigint")
    stacks = callstacks.encode(callstacks.stack_table(samples))
    tree = callstacks.call_tree(stacks)
    assert tree.agg(F.count("*"), F.max("depth"), F.sum("self")).first()[:] == (1000, 1000, 3)
    assert values(callstacks.cut_stacks(samples, 750), "cut_samples", "lost_frames") == [(1, 250)]
    assert callstacks.encode(callstacks.stack_table(samples, 750)).select(F.size("calls")).first()[0] == 750
    listed = spark.range(10_005).selectExpr("concat('f', id) as function", "'x' as file", "id as self_weight", "id as accumulated_weight")
    assert views.query_functions(listed).count() == 10_005
    assert views.query_functions(listed, 7).count() == 7


def test_flame_without_a_minimum_keeps_all_boxes(spark):
    wide = [([(1, "r")], 100_000, 1), ([(2, "tiny"), (1, "r")], 1, 1)]
    assert layout.flame(_stacks(spark, wide), 0.0).count() == 2
    assert layout.flame(_stacks(spark, wide), 0.1).count() == 1


def test_an_interval_over_everything_is_many_keys(spark):
    points = spark.range(0, 1 << 20, 64).withColumnRenamed("id", "p")
    intervals = spark.createDataFrame([(0, 1 << 20, "all")] + [(i * 4096, i * 4096 + 100, f"n{i}") for i in range(256)], "lo bigint, hi bigint, n string")
    _, probed = lookup.filed_and_probed(points, intervals, "p", "lo", "hi")
    cells = probed.groupBy("_level", "_cell", "_salt").count().agg(F.max("count")).first()[0]
    assert cells <= points.count() / 50
    found = lookup.containing(points, intervals, "p", "lo", "hi")
    assert found.filter("n = 'all'").count() == points.count()
    assert found.filter("n <> 'all'").count() == 256 * 2


def test_a_pause_of_an_hour_is_one_frame(spark):
    gap, hour = 1_000_000, 3_600_000_000_000
    times = [0, 2 * gap, 4 * gap, 4 * gap + hour, 6 * gap + hour]
    samples = spark.createDataFrame(
        [("cpu-cycles", 1, 2, "RHIThread", t, 10, [1]) for t in times] + [("cpu-cycles", 1, 3, "GameThread", 4 * gap + hour // 2, 7, [9])],
        "event string, pid bigint, tid bigint, comm string, time bigint, period bigint, funcs array<bigint>")
    names = frames.first_names(samples)
    found = frames.boundaries(samples, names, F.lit(1), gap, slice_rows=2)
    assert values(found, "frame_idx", "start", "end") == [(i, a, b) for i, (a, b) in enumerate(zip(times, times[1:]))]
    filed, _ = lookup.filed_and_probed(samples, found, "time", "start", "end")
    assert filed.select("frame_idx", "_cell").distinct().groupBy("frame_idx").count().agg(F.max("count")).first()[0] <= 2
    placed = frames.in_frames(samples, found)
    assert values(placed.filter("tid = 3"), "frame_idx") == [(2,)]
    assert frames.frame_totals(placed, found, frames.matching_threads(names)).count() == 8


def test_release_gives_up_what_was_kept(spark):
    reuse.release()
    rows = reuse.kept(spark.range(5))
    assert rows.storageLevel.useMemory and reuse.release() == 1
    assert not rows.storageLevel.useMemory and reuse.release() == 0 and rows.count() == 5

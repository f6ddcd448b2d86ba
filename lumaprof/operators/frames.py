"""Game frames: boundaries from a marker function, and statistics per frame.

Samples are ``event, pid, tid, comm, time, period, funcs`` (leaf first). All
ordered work runs in slices of the time axis that are cut by row count, so neither
one busy thread nor one event is handled by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.functions.names import BOUNDARY_THREAD, FRAME_MARKERS, MARKER_GAP_NS
from lumaprof.operators.lookup import merged_before, numbered, sliced
from lumaprof.operators.reuse import cut

THREAD = ["event", "pid", "tid"]
ON_CPU, OFF_CPU = "cpu-cycles", "sched:sched_switch"
COMBINED = f"{ON_CPU} + {OFF_CPU} (combined)"


def marker_function(functions: DataFrame, substring: str) -> DataFrame:
    """Smallest function id whose name holds the marker text (no row value if none)."""
    return functions.filter(F.col("name").contains(substring)).agg(F.min("func_id").alias("func_id"))


def first_names(samples: DataFrame) -> DataFrame:
    """First seen name of each thread."""
    return samples.groupBy(*THREAD).agg(F.min_by("comm", F.struct("time", "comm")).alias("thread_name"))


def matching_threads(names: DataFrame, markers: Sequence[tuple[str, str]] = FRAME_MARKERS) -> DataFrame:
    """Threads whose name holds any marker's thread pattern."""
    found = F.lit(False)
    for pattern, _ in markers:
        found = found | F.col("thread_name").contains(pattern)
    return names.filter(found)


def boundary_threads(names: DataFrame) -> DataFrame:
    """Per event, the thread that defines the frames: the smallest matching (pid, tid)."""
    matching = names.filter(F.col("thread_name").contains(BOUNDARY_THREAD))
    return matching.groupBy("event").agg(F.min(F.struct("pid", "tid")).alias("t")).select("event", "t.pid", "t.tid")


def boundaries(samples: DataFrame, names: DataFrame, marker: Column, gap: int = MARKER_GAP_NS,
               slice_rows: int | None = None) -> DataFrame:
    """Frames ``(event, frame_idx, start, end)`` of each event.

    A marker sample opens a frame when more than ``gap`` passed since the
    *previous marker sample*; fewer than two starts make no frame.
    """
    marked = sliced(
        samples.filter(F.array_contains("funcs", marker))
        .join(boundary_threads(names), THREAD, "left_semi").select("event", "time").distinct(), ["event", "time"], slice_rows)
    # One row per slice (and event that begins in it): the last marker before it.
    over_slices = Window.partitionBy("event").orderBy("_slice")
    carried = marked.groupBy("event", "_slice").agg(F.max("time").alias("_max")).select(
        "event", "_slice", F.lag("_max").over(over_slices).alias("_before"))
    inside = Window.partitionBy("event", "_slice").orderBy("time")
    starts = (
        marked.withColumn("_lag", F.lag("time").over(inside)).join(carried, ["event", "_slice"])
        .withColumn("_previous", F.coalesce("_lag", "_before"))
        .filter(F.col("_previous").isNull() | (F.col("time") - F.col("_previous") > gap)).select("event", "_slice", "time"))
    ordered = numbered(starts, ["event"], ["time"], "frame_idx")
    ends = ordered.select("event", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("time").alias("end"))
    return ordered.join(ends, ["event", "frame_idx"]).select("event", "frame_idx", F.col("time").alias("start"), "end")


def aligned(samples: DataFrame) -> DataFrame:
    """On-CPU and off-CPU samples of the threads seen on CPU, as one combined event."""
    on = samples.filter(F.col("event") == ON_CPU)
    off = samples.filter(F.col("event") == OFF_CPU)
    threads = on.select("pid", "tid").distinct()
    kept = off.join(threads, ["pid", "tid"], "left_semi")
    return on.withColumn("kind", F.lit(0)).unionByName(kept.withColumn("kind", F.lit(1)))


def off_cpu_durations(merged: DataFrame, page_bits: int = 30) -> DataFrame:
    """Off-CPU periods become the time to the thread's next sample; the last one gets 0.

    On-CPU samples come first at equal times, so an off-CPU sample's next is
    the next *row*: an equal time gives 0, else the next distinct time.
    """
    paged = merged.withColumn("_page", F.shiftright("time", page_bits))
    thread = ["pid", "tid"]
    inside = Window.partitionBy(*thread, "_page").orderBy("time", "kind")
    pages = paged.groupBy(*thread, "_page").agg(F.min("time").alias("_min"))
    following = pages.select(*thread, "_page", F.lead("_min").over(
        Window.partitionBy(*thread).orderBy("_page")).alias("_after"))
    next_time = F.coalesce(F.lead("time").over(inside), F.col("_after"))
    period = F.when(F.col("kind") == 1, F.coalesce(F.col("_next") - F.col("time"), F.lit(0))).otherwise(F.col("period"))
    return (
        paged.join(following, [*thread, "_page"]).withColumn("_next", next_time)
        .withColumn("period", period).drop("_page", "_after", "_next"))


def combined(samples: DataFrame) -> DataFrame:
    """The combined event's samples: aligned, with off-CPU durations; empty unless both events exist."""
    has_both = samples.filter(F.col("event").isin(ON_CPU, OFF_CPU)).agg(
        F.count_distinct("event") == 2).scalar()
    return off_cpu_durations(aligned(samples)).filter(has_both).withColumn("event", F.lit(COMBINED))


def in_frames(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Samples with the frame ``[start, end)`` that holds their time.

    Frames of an event are disjoint, so the last start is the only candidate: the
    distinct times are merged with the starts, and each sample moves once, to its time.
    """
    columns = [c for c in frames.columns if c != "event"]
    hits = merged_before(samples, frames, ["event"], "time", "start", columns).filter(F.col("time") < F.col("end"))
    return samples.join(hits, ["event", "time"])


#: Consecutive frames of one event that a grid joins with the threads at a time.
GRID_FRAMES = 4096


def _grid(frames: DataFrame, threads: DataFrame) -> DataFrame:
    """Every (frame, thread) of an event, joined by range of frames; the thread list is repeated once per range."""
    ranged = frames.withColumn("_range", F.expr(f"frame_idx div {GRID_FRAMES}"))
    ranges = ranged.select("event", "_range").distinct()
    listed = ranges.join(threads.select(*THREAD, "thread_name"), "event")
    return ranged.join(listed, ["event", "_range"]).drop("_range")


def frame_totals(placed: DataFrame, frames: DataFrame, threads: DataFrame, wall_clock: bool = False) -> DataFrame:
    """One row per (event, thread, frame), empty frames included.

    The total is the sum of periods, or the frame's duration on the wall clock.
    """
    grid = _grid(frames, threads)
    if wall_clock:
        return grid.select(*THREAD, "thread_name", "frame_idx", (F.col("end") - F.col("start")).alias("total"))
    sums = placed.groupBy(*THREAD, "frame_idx").agg(F.sum("period").alias("_sum"))
    return grid.join(sums, [*THREAD, "frame_idx"], "left").select(
        *THREAD, "thread_name", "frame_idx", F.coalesce("_sum", F.lit(0)).alias("total"))


def frame_functions(placed: DataFrame, threads: DataFrame) -> DataFrame:
    """Self (leaf) and subtree (distinct in the stack) period per frame and function."""
    rows = placed.join(threads.select(*THREAD), THREAD, "left_semi").select(
        *THREAD, "frame_idx", "period", F.get("funcs", F.lit(0)).alias("_leaf"),
        F.explode_outer(F.array_distinct("funcs")).alias("func"))
    return rows.groupBy(*THREAD, "frame_idx", "func").agg(
        F.sum(F.when(F.col("func") == F.col("_leaf"), F.col("period")).otherwise(0)).alias("self"),
        F.sum("period").alias("subtree"))


def good_and_bad(totals: DataFrame, fps: float, second: float = 1e9) -> DataFrame:
    """Frames within and over the budget of one frame at ``fps``."""
    good = F.col("total") <= F.lit(second / fps)
    return totals.groupBy(*THREAD).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))


#: Rank error of the first look for a median, as a share of the group.
MEDIAN_ERROR = 1e-4


def _bracket(value: str, error: float) -> Column:
    """Two values between which the median lies, from a mergeable sketch whose ranks are off by ``error`` at most."""
    return F.percentile_approx(value, F.array(F.lit(0.5 - 2 * error), F.lit(0.5 + 2 * error)), F.lit(int(1 / error)))


def _settled(rows: DataFrame, brackets: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact median per group: counts below and at the bracket's ends, and the few values between them.

    Between the ends lie a few ``MEDIAN_ERROR`` of a group's rows; ties that are many are an end themselves.
    """
    v, lo, hi = F.col(value), F.col("_bracket")[0], F.col("_bracket")[1]
    found = rows.join(brackets.select(*by, "_bracket"), [*by]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(v < lo).alias("_below"), F.count_if(v == lo).alias("_at"),
        F.sort_array(F.collect_list(F.when((v > lo) & (v < hi), v))).alias("_between"),
        F.any_value(lo).alias("_lo"), F.any_value(hi).alias("_hi"))
    upto = F.col("_below") + F.col("_at")

    def at(rank: Column) -> Column:
        return F.when(rank <= upto, F.col("_lo")).when(
            rank <= upto + F.size("_between"), F.get("_between", (rank - upto - 1).cast("int"))).otherwise(F.col("_hi"))

    return found.select(*by, ((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2).alias("median"))


def _medians(rows: DataFrame, by: Sequence[str], value: str, error: float = MEDIAN_ERROR) -> DataFrame:
    """Exact median per group of a whole-numbered column."""
    return _settled(rows, rows.groupBy(*by).agg(_bracket(value, error).alias("_bracket")), by, value)


def function_stats(functions: DataFrame, totals: DataFrame, fps: float, second: float = 1e9) -> DataFrame:
    """Per thread and function over the frames it appears in: sums, spread, bad-minus-good mean, share stability."""
    rows = cut(functions.join(totals.select(*THREAD, "frame_idx", "total"), [*THREAD, "frame_idx"]).select(
        *THREAD, "func", "subtree", F.when(F.col("total") > 0, F.col("subtree") / F.col("total")).otherwise(0.0).alias("ratio"),
        (F.col("total") > F.lit(second / fps)).alias("bad")))
    by = [*THREAD, "func"]
    good_mean = F.avg(F.when(~F.col("bad"), F.col("subtree")))
    bad_mean = F.avg(F.when(F.col("bad"), F.col("subtree")))
    ratio_mean = F.avg("ratio")
    stats = cut(rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("subtree").alias("total_subtree"),
        F.min("subtree").alias("min_frame"), F.max("subtree").alias("max_frame"),
        F.avg("subtree").alias("avg"), F.stddev_pop("subtree").alias("stddev"),
        (F.coalesce(bad_mean, F.lit(0.0)) - F.coalesce(good_mean, F.lit(0.0))).alias("delta"),
        F.when(ratio_mean > 0, F.stddev_pop("ratio") / ratio_mean).otherwise(0.0).alias("cv"),
        _bracket("subtree", MEDIAN_ERROR).alias("_bracket")))
    threads = stats.groupBy(*THREAD).agg(F.greatest(F.max("cv"), F.lit(0.0)).alias("max_cv"))
    return stats.drop("_bracket").join(_settled(rows, stats, by, "subtree"), by).join(threads, THREAD)


def function_series(functions: DataFrame) -> DataFrame:
    """Subtree time of a function per frame in milliseconds; order by ``frame_idx``."""
    return functions.select(*THREAD, "func", "frame_idx", (F.col("subtree") / 1e6).alias("ms"))


def thread_tree_source(threads: DataFrame, rolled: DataFrame) -> DataFrame:
    """For each frame thread, the first (event, process) in export order that has its tid."""
    order = F.struct("event", "process_rank", "thread_rank")
    first = rolled.groupBy("tid").agg(F.min_by(F.struct("event", "pid"), order).alias("t")).select(
        "tid", F.col("t.event").alias("tree_event"), F.col("t.pid").alias("tree_pid"))
    return threads.join(first, "tid", "left")

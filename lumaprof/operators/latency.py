"""Latency distributions from a frequency table.

``frequency`` is the one shuffle over the samples; it is mergeable, and every
statistic below reads it instead of the raw latencies. A group is at most as
large as the latency counter's range, whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.functions.names import HISTOGRAM_BUCKETS


def frequency(samples: DataFrame, keys: Sequence[str], latency: str = "latency") -> DataFrame:
    """``(keys, latency, cnt)``; samples without a latency keep a null one."""
    return samples.groupBy(*keys, F.col(latency).alias("latency")).agg(F.count(F.lit(1)).alias("cnt"))


def merge(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coarser frequency table over fewer keys."""
    return freq.groupBy(*keys, "latency").agg(F.sum("cnt").alias("cnt"))


def _rank(share: float, count: Column) -> Column:
    return F.greatest(F.ceil(F.lit(share) * count), F.lit(1))


def statistics(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, moments, nearest-rank p95/p99 and the latency above p95 and above the average."""
    group = Window.partitionBy(*keys)
    seen = F.col("latency").isNotNull()
    cnt = F.when(seen, F.col("cnt")).otherwise(0)
    weight = F.col("latency") * F.col("cnt")
    running = group.orderBy(F.col("latency").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = freq.withColumn("_upto", F.sum(cnt).over(running)).withColumn(
        "_n", F.sum(cnt).over(group)).withColumn("_sum", F.sum(weight).over(group))
    for name, share in (("_p95", 95.0 / 100.0), ("_p99", 99.0 / 100.0)):
        reached = seen & (F.col("_upto") >= _rank(share, F.col("_n")))
        ranked = ranked.withColumn(name, F.min(F.when(reached, F.col("latency"))).over(group))
    average = F.col("_sum") / F.col("_n")
    stats = ranked.groupBy(*keys).agg(
        F.sum("cnt").alias("sample_count"),
        F.sum(cnt).alias("latency_count"),
        F.coalesce(F.sum(weight), F.lit(0)).alias("latency_sum"),
        F.sum(F.col("latency").cast("double") * F.col("latency") * F.col("cnt")).alias("_squares"),
        F.min("latency").alias("min_latency_cycles"),
        F.max("latency").alias("max_latency_cycles"),
        F.first("_p95", ignorenulls=True).alias("p95_latency_cycles"),
        F.first("_p99", ignorenulls=True).alias("p99_latency_cycles"),
        F.coalesce(F.sum(F.when(F.col("latency") > F.col("_p95"), weight)), F.lit(0)).alias("over_p95_sum"),
        F.coalesce(F.sum(F.when((F.col("_n") > 0) & (F.col("latency") > F.try_divide("_sum", "_n")), weight)),
                   F.lit(0)).alias("over_avg_sum"),
    )
    average = F.when(F.col("latency_count") > 0, F.col("latency_sum") / F.col("latency_count"))
    spread = F.try_divide("_squares", "latency_count") - average * average
    return stats.withColumn("avg_latency_cycles", average).withColumn(
        "std_latency_cycles", F.when(average.isNotNull(), F.sqrt(F.greatest(spread, F.lit(0.0))))
    ).drop("_squares")


def histogram(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal-width bins per group, empty bins kept; one bin when all latencies are equal."""
    real = freq.filter("latency is not null")
    groups = real.groupBy(*keys).agg(
        F.sum("cnt").alias("count"), F.min("latency").alias("min_latency_cycles"),
        F.max("latency").alias("max_latency_cycles"))
    lo, hi = F.col("min_latency_cycles"), F.col("max_latency_cycles")
    buckets = F.when(lo == hi, F.lit(1)).otherwise(F.least(F.col("count"), F.lit(HISTOGRAM_BUCKETS)))
    groups = groups.withColumn("buckets", buckets.cast("int")).withColumn(
        "width", F.ceil((hi - lo + 1) / F.col("buckets")).cast("bigint"))
    filled = (
        real.join(groups, [*keys])
        .withColumn("bin", F.least(F.floor((F.col("latency") - lo) / F.col("width")), F.col("buckets") - 1).cast("int"))
        .groupBy(*keys, "bin").agg(F.sum("cnt").alias("bin_count"))
    )
    start = lo + F.col("bin") * F.col("width")
    return (
        groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        .join(filled, [*keys, "bin"], "left")
        .select(*keys, "count", "min_latency_cycles", "max_latency_cycles", "bin",
                start.alias("start_latency_cycles"),
                F.least(start + F.col("width") - 1, hi).alias("end_latency_cycles"),
                F.coalesce("bin_count", F.lit(0)).alias("bin_count"))
    )


def histogram_lists(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group with its bins (at most 20) as a list, for the JSON sink."""
    one_bin = F.struct("bin", "start_latency_cycles", "end_latency_cycles", F.col("bin_count").alias("count"))
    return bins.groupBy(*keys, "count", "min_latency_cycles", "max_latency_cycles").agg(
        F.transform(F.array_sort(F.collect_list(one_bin)), lambda b: b.dropFields("bin")).alias("bins"))

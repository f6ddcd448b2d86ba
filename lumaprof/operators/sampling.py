"""Instruction sampling (SPE) aggregates and their latency metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaprof.functions import classify as C
from lumaprof.functions import metric_value as M
from lumaprof.functions.names import BREAKDOWN_METRICS, DIMENSION_NAMES, NO_LATENCY
from lumaprof.functions.text import is_zero_text, summary_text
from lumaprof.operators import latency as L
from lumaprof.operators import resolve

ADDRESS = ["mapping_id", "ip"]


def with_category(samples: DataFrame) -> DataFrame:
    return samples.withColumn("category", C.spe_category(
        F.col("operation_flags"), F.col("data_source"), F.col("branch_result"), F.col("decode_status")))


def address_classes(samples: DataFrame, maps: DataFrame, matches: DataFrame, instructions: DataFrame) -> DataFrame:
    """``(mapping_id, ip, class, kind)`` of the distinct sampled addresses that have an instruction.

    The chain is map, module, symbol file, then the instruction at the relative
    address; ``instructions`` is ``(module_id, address, class, kind)`` from section
    words or disassembly.
    """
    placed = resolve.with_symbol_file(resolve.to_module(samples.select(*ADDRESS).distinct(), maps), matches)
    usable = placed.filter("candidate_path is not null and rel is not null").withColumnRenamed("rel", "address")
    found = resolve.exact_instruction(usable.select(*ADDRESS, "module_id", "address"), instructions)
    return found.filter("class is not null").select(*ADDRESS, "class", "kind")


def classified(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with a category by address, with class, load kind and hierarchy child.

    ``classes`` is ``(mapping_id, ip, class, kind)`` per distinct address; an
    address that could not be classified is an unknown instruction without kind.
    """
    joined = rows.join(classes, ADDRESS, "left")
    joined = joined.withColumn("class", F.coalesce("class", F.lit("unknown_instruction")))
    return joined.withColumn("child", C.child_class(F.col("category"), F.col("class")))


def by_address(samples: DataFrame) -> DataFrame:
    """Outcome counters, flag unions and decode errors per address."""
    def count(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0))

    return samples.groupBy(*ADDRESS).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.coalesce(F.sum("latency"), F.lit(0)).alias("latency_sum"),
        F.count("latency").alias("latency_count"),
        count(F.col("cache_result") == 1).alias("cache_hits"),
        count(F.col("cache_result") == 2).alias("cache_misses"),
        count(F.col("branch_result") == 1).alias("branch_correct"),
        count(F.col("branch_result") == 2).alias("branch_mispredict"),
        F.bit_or("operation_flags").alias("operation_flags_or"),
        F.bit_or("event_flags").alias("event_flags_or"),
        count(F.col("decode_status") != 0).alias("decode_error_count"),
    )


def ids_by_address(samples: DataFrame, distinct: bool = True) -> DataFrame:
    """As ``counters.ids_by_address``."""
    ids = samples.select(*ADDRESS, "cpu", "tid")
    return ids.distinct() if distinct else ids


def data_sources_by_address(samples: DataFrame) -> DataFrame:
    return samples.filter("data_source <> 0").groupBy(*ADDRESS, "data_source").agg(
        F.count(F.lit(1)).alias("cnt"))


def base_frequency(samples: DataFrame, classes: DataFrame, keys: Sequence[str] = (*ADDRESS, "cpu"),
                   held: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The fused pass: one frequency table that all category, class and kind outputs merge from.

    Samples are reduced first; only the frequencies meet the classes of their addresses.
    ``keys`` are the address and, for outputs per cpu, the cpu. ``held`` may write the
    frequencies, so that their shuffle is over before that of the join.
    """
    return classified(held(L.frequency(with_category(samples), [*keys, "category"])), classes)


def address_and_cpu_frequency(base: DataFrame, dimension: str) -> DataFrame:
    """Frequency by address (cpu null) and by (address, cpu), in one grouping-sets pass.

    A kind is optional; samples without one do not take part.
    """
    rows = base.filter(F.col(dimension).isNotNull()).withColumnRenamed(dimension, "name").select(
        *ADDRESS, "cpu", "name", "latency", "cnt")
    columns = [F.col(c) for c in (*ADDRESS, "cpu", "name", "latency")]
    coarse = [F.col(c) for c in (*ADDRESS, "name", "latency")]
    return rows.groupingSets([columns, coarse], *columns).agg(
        F.grouping("cpu").alias("all_cpus"), F.sum("cnt").alias("cnt"))


def hierarchy_frequency(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frequency of category parents (child null) and their child classes."""
    rows = base.select(*keys, "category", "child", "latency", "cnt")
    children = [F.col(c) for c in (*keys, "category", "child", "latency")]
    parents = [F.col(c) for c in (*keys, "category", "latency")]
    return rows.groupingSets([children, parents], *children).agg(F.sum("cnt").alias("cnt"))


@dataclass(frozen=True)
class Baseline:
    """What line-level time shares divide by: counter cycles and the sampling period."""

    cpu_cycles: float | None
    period: float


#: A statistic by name: a column of the row, or a field of a struct of statistics.
Statistic = Callable[[str], Column]


def _or_missing(value: Column, of: Statistic = F.col) -> Column:
    """A group with samples but no latency has no latency metric; an empty group has zeros."""
    no_latency = (of("sample_count") > 0) & (of("latency_count") == 0)
    return F.when(no_latency, M.missing(NO_LATENCY)).otherwise(M.number(F.coalesce(value, F.lit(0.0))))


def _time_share(cycles: Column, denominator: Column, period: float, of: Statistic = F.col) -> Column:
    no_latency = (of("sample_count") > 0) & (of("latency_count") == 0)
    return (
        F.when(no_latency, M.missing(NO_LATENCY))
        .when(of("sample_count") == 0, M.number(F.lit(0.0)))
        .when(denominator.isNull(), M.missing("PMU cpu_cycles baseline missing"))
        .when((denominator <= 0) | F.isnan(denominator) | (denominator == float("inf")),
              M.undefined("PMU cpu_cycles baseline is zero"))
        .otherwise(M.number(M.percent(cycles.cast("double") * F.lit(period), denominator)))
    )


def latency_metrics(denominator: Column, period: float, of: Statistic = F.col) -> dict[str, Column]:
    """The ten latency metrics of a statistics row."""
    own = of("latency_sum").cast("double")
    plain = {f"{p}_latency_cycles": _or_missing(of(f"{p}_latency_cycles"), of)
             for p in ("min", "max", "avg", "std", "p95", "p99")}
    tails = {}
    for suffix, total, scale in (("est_time_pct", own, 1.0), ("all_est_time_pct", denominator, period)):
        for tail in ("p95", "avg"):
            tails[f"over_{tail}_{suffix}"] = _time_share(of(f"over_{tail}_sum"), total, scale, of)
    return plain | tails


def _long(stats: DataFrame, keys: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """One row per (keys, metric)."""
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value"))
                      for name, value in metrics.items()])
    return stats.select(*keys, F.inline_outer(pairs))


def line_metric_values(total: Column, baseline: Baseline, of: Statistic = F.col) -> dict[str, Column]:
    """The 14 metrics of the statistics of one (line, name); ``total`` has the report's samples ``n`` and ``cycles``."""
    denominator = F.lit(baseline.cpu_cycles).cast("double")
    return {
        "sample_count": M.number(of("sample_count")),
        "sample_pct": M.number(M.percent(of("sample_count"), total["n"])),
        "spe_latency_pct": _or_missing(M.percent(of("latency_sum"), total["cycles"]), of),
        "est_time_pct": _time_share(of("latency_sum"), denominator, baseline.period, of),
        **latency_metrics(denominator, baseline.period, of),
    }


def line_metrics(freq: DataFrame, baseline: Baseline, keys: Sequence[str] = ("file", "line")) -> DataFrame:
    """Category, class or kind metrics of each line: 14 rows per (line, name).

    ``freq`` is ``(keys, name, latency, cnt)`` over attributed lines only, so its
    sums are the report totals.
    """
    whole = F.struct(F.sum("cnt").alias("n"), F.coalesce(F.sum(F.col("latency") * F.col("cnt")), F.lit(0)).alias("cycles"))
    stats = L.statistics(freq, [*keys, "name"]).withColumn("_total", freq.agg(whole).scalar())
    return _long(stats, [*keys, "name"], line_metric_values(F.col("_total"), baseline))


def cpu_metrics(freq: DataFrame, with_count: bool) -> DataFrame:
    """Distribution per cpu over *all* samples; time shares are shares of the cpu's own latency."""
    stats = L.statistics(freq, ["cpu", "name"])
    sums = freq.groupBy("cpu").agg(
        F.sum("cnt").alias("_cpu_samples"),
        F.coalesce(F.sum(F.col("latency") * F.col("cnt")), F.lit(0)).alias("_cpu_cycles"))
    stats = stats.join(sums, "cpu")
    share = _or_missing(M.percent(F.col("latency_sum"), F.col("_cpu_cycles")))
    metrics = {"sample_count": M.number(F.col("sample_count"))} if with_count else {}
    metrics |= {
        "sample_pct": M.number(M.percent(F.col("sample_count"), F.col("_cpu_samples"))),
        "spe_latency_pct": share, "est_time_pct": share,
        **latency_metrics(F.col("_cpu_cycles").cast("double"), 1.0),
    }
    return _long(stats, ["cpu", "name"], metrics)


def breakdown(freq: DataFrame) -> DataFrame:
    """Wide hierarchy rows ``(cpu, category, child)``: parents are shares of the cpu, children of the parent."""
    stats = L.statistics(freq, ["cpu", "category", "child"])
    parents = stats.filter("child is null")
    parent = parents.select("cpu", "category", F.col("sample_count").alias("_p_samples"), F.col("latency_sum").alias("_p_cycles"))
    cpus = parents.groupBy("cpu").agg(
        F.sum("sample_count").alias("_cpu_samples"), F.sum("latency_sum").alias("_cpu_cycles"))
    rows = stats.join(parent, ["cpu", "category"]).join(cpus, "cpu")
    is_child = F.col("child").isNotNull()
    samples = F.when(is_child, F.col("_p_samples")).otherwise(F.col("_cpu_samples"))
    cycles = F.when(is_child, F.col("_p_cycles")).otherwise(F.col("_cpu_cycles"))
    share = _or_missing(M.percent(F.col("latency_sum"), cycles))
    metrics = {
        "sample_pct": M.number(M.percent(F.col("sample_count"), samples)),
        "spe_latency_pct": share,
        "est_time_pct": share,
        "all_est_time_pct": _or_missing(M.percent(F.col("latency_sum"), F.col("_cpu_cycles"))),
        **latency_metrics(F.col("_cpu_cycles").cast("double"), 1.0),
    }
    return rows.select("cpu", "category", "child", *[value.alias(name) for name, value in metrics.items()])


def dimension(spark, name: str) -> DataFrame:
    """Name dimension with its report order: 44 categories, 15 classes or 10 load kinds."""
    rows = list(enumerate(DIMENSION_NAMES[name]))
    return spark.createDataFrame(rows, "ordinal int, name string")


def breakdown_rows(rows: DataFrame, display: bool = False) -> DataFrame:
    """Printed breakdown with report ordinals; rows whose metrics are all zero are hidden.

    The display variant hides by the *printed* value, and a hidden parent hides its children.
    """
    spark = rows.sparkSession
    categories = dimension(spark, "category").select(F.col("ordinal").alias("category_ordinal"), F.col("name").alias("category"))
    classes = dimension(spark, "class").select(F.col("ordinal").alias("child_ordinal"), F.col("name").alias("child"))
    if display:
        text = {m: F.when(F.col(m)["state"] == "number", summary_text(F.lit(m), F.col(m)["value"]))
                .when(F.col(m)["state"] == "undefined", F.lit("N/A"))
                .otherwise(F.initcap(F.col(m)["state"])) for m in BREAKDOWN_METRICS}
        shown = F.lit(False)
        for column in text.values():
            shown = shown | ~is_zero_text(column)
    else:
        text = {m: M.metric_text(F.col(m)) for m in BREAKDOWN_METRICS}
        shown = F.lit(False)
        for m in BREAKDOWN_METRICS:
            shown = shown | F.coalesce(M.metric_number(F.col(m)) != 0.0, F.lit(False))
    kept = rows.withColumn("_shown", shown)
    if display:
        visible = kept.filter("child is null and _shown").select("cpu", "category")
        kept = kept.join(visible, ["cpu", "category"], "left_semi")
    return (
        kept.filter("_shown")
        .join(F.broadcast(categories), "category").join(F.broadcast(classes), "child", "left")
        .select("cpu", "category", F.coalesce("child", F.lit("")).alias("child"),
                F.when(F.col("child").isNull(), F.lit("parent")).otherwise(F.lit("child")).alias("level"),
                "category_ordinal", F.coalesce("child_ordinal", F.lit(-1)).alias("child_ordinal"),
                *[column.alias(m) for m, column in text.items()])
    )

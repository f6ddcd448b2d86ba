"""Source line, file and function reports from resolved addresses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaprof.functions import metric_value as M
from lumaprof.functions.names import DIMENSION_PREFIX, SPE_COLUMNS, UNKNOWN_FUNCTION, spe_column_keys
from lumaprof.functions.text import id_list_text, is_zero_text, summary_text
from lumaprof.operators import latency as L
from lumaprof.operators import sampling as S

LINE = ["file", "line"]
ADDRESS = ["mapping_id", "ip"]
#: Entries of a metric map.
ENTRIES = f"array<struct<key:string,value:{M.TYPE}>>"
METRIC_MAPS = ["pmu_values", "spe_values", "instruction_values", "load_instruction_values"]


@dataclass(frozen=True)
class CounterPlan:
    """The small, driver-side part of a report: which counters exist and what they divide by."""

    raw_keys: Sequence[str]
    supported: Mapping[str, bool]
    seconds: float | None
    spe_available: bool = True
    spe_missing_reason: str | None = None
    baseline: S.Baseline = field(default_factory=lambda: S.Baseline(None, 1.0))


def at_lines(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Address rows with the line their address resolved to; unresolved ones are left out."""
    known = placed.filter("file is not null").select(*ADDRESS, *LINE)
    return rows.join(known, ADDRESS)


def counters_by_line(by_address: DataFrame, placed: DataFrame) -> DataFrame:
    """``(file, line, event_key)`` sums of the address counters."""
    return at_lines(by_address, placed).groupBy(*LINE, "event_key").agg(
        *[F.sum(c).alias(c) for c in ("self_weight", "self_samples", "acc_weight", "acc_samples")])


def _weight(samples: str, weight: str) -> Column:
    """``cpu_cycles`` weight where that event was seen, else the weight of all events."""
    is_cycles = (F.col("event_key") == "cpu_cycles") & (F.col(samples) > 0)
    return F.coalesce(F.sum(F.when(is_cycles, F.col(weight))), F.sum(weight), F.lit(0)).cast("double")


def _counter_columns() -> list[Column]:
    """Sample count, weights and samples per event of a line; rows without an event add nothing."""
    samples = F.col("self_samples") + F.col("acc_samples")
    return [
        F.sum(samples).alias("sample_count"),
        _weight("self_samples", "self_weight").alias("self_weight"),
        _weight("acc_samples", "acc_weight").alias("accumulated_weight"),
        # One entry per event of the catalog.
        F.map_from_entries(F.collect_list(F.when(F.col("event_key").isNotNull(), F.struct("event_key", samples)))).alias("event_samples"),
    ]


def counter_rows(by_line: DataFrame) -> DataFrame:
    """One row per line: sample count, self/accumulated weight and samples per event."""
    return by_line.groupBy(*LINE).agg(*_counter_columns())


def event_support(support: DataFrame, keys: DataFrame) -> DataFrame:
    """Is each wanted event supported: on any cpu, or listed without per-cpu states.

    ``support`` is ``(event_key, supported)`` with a null state for an event that lists no cpu.
    """
    states = support.groupBy("event_key").agg(
        F.bool_or(F.coalesce("supported", F.lit(True))).alias("supported"))
    return keys.join(states, "event_key", "left").withColumn(
        "supported", F.coalesce("supported", F.lit(False)))


def dense_counts(by_line: DataFrame, support: DataFrame) -> DataFrame:
    """Samples of every supported event on every sampled line, 0 where it was not seen.

    The supported keys come from the event catalog, so the exploded list is small.
    """
    wanted = support.filter("supported").agg(F.collect_set("event_key")).scalar()
    lines = by_line.groupBy(*LINE).agg(F.map_from_entries(F.collect_list(F.struct(
        "event_key", F.col("self_samples") + F.col("acc_samples")))).alias("_seen"))
    return lines.select(*LINE, "_seen", F.explode(wanted).alias("event_key")).select(
        *LINE, "event_key",
        F.coalesce(F.try_element_at("_seen", F.col("event_key")), F.lit(0)).alias("samples"))


def raw_metrics(counts: Column, sample_count: Column, plan: CounterPlan) -> dict[str, Column]:
    """Share of a line's samples per shown counter."""
    metrics = {}
    for key in plan.raw_keys:
        if plan.supported.get(key, False):
            seen = F.coalesce(F.try_element_at(counts, F.lit(key)), F.lit(0))
            metrics[key] = M.number(F.when(sample_count > 0, seen / sample_count).otherwise(0.0))
        else:
            metrics[key] = M.missing(f"{key} is not available")
    return metrics


def derived_metrics(counts: Mapping[str, Column], seconds: float | None) -> dict[str, Column]:
    """The eight derived metrics of a set of event counts; a key that is absent is missing."""

    def ratio(top: str, bottom: str, value) -> Column:
        for key in (top, bottom):
            if key not in counts:
                return M.missing(f"{key} is missing")
        whole = counts[bottom]
        return F.when(whole == 0, M.undefined(f"{bottom} is zero")).otherwise(
            M.number(F.try_divide(value(counts[top], whole).cast("double"), whole.cast("double"))))

    def hits(level: str) -> Column:
        # Access is both the base and the denominator, and is reported missing first.
        access, refill = f"{level}_cache_access", f"{level}_cache_refill"
        if access not in counts:
            return M.missing(f"{access} is missing")
        if refill not in counts:
            return M.missing(f"{refill} is missing")
        return ratio(refill, access, lambda part, whole: F.greatest(whole - part, F.lit(0)))

    def rate(key: str) -> Column:
        if key not in counts:
            return M.missing("required event is missing")
        if seconds is None:
            return M.missing("effective time is missing")
        if seconds <= 0:
            return M.undefined("effective time is zero")
        return M.number(counts[key].cast("double") / F.lit(float(seconds)) / 1e6)

    def scaled(top: str, bottom: str, scale: float) -> Column:
        plain = ratio(top, bottom, lambda part, _: part)
        return F.when(plain["state"] == "number", M.number(plain["value"] * scale)).otherwise(plain)

    return {
        "cpi": ratio("cpu_cycles", "inst_retired", lambda part, _: part),
        "l1d_cache_hit_rate": hits("l1d"),
        "l2d_cache_hit_rate": hits("l2d"),
        "l3d_cache_hit_rate": hits("l3d"),
        "branch_miss_rate": ratio("branch_mispredict", "branch_retired", lambda part, _: part),
        "mpki": scaled("l1d_cache_refill", "inst_retired", 1000.0),
        "mips": rate("inst_retired"),
        "mcps": rate("cpu_cycles"),
    }


def pmu_values(counts: Column, sample_count: Column, plan: CounterPlan) -> Column:
    """Metric map of a line: shown counters, then the derived metrics (from sample counts)."""
    dense = {key: F.coalesce(F.try_element_at(counts, F.lit(key)), F.lit(0))
             for key in plan.raw_keys if plan.supported.get(key, False)}
    metrics = raw_metrics(counts, sample_count, plan) | derived_metrics(dense, plan.seconds)
    return F.create_map(*[part for key, value in metrics.items() for part in (F.lit(key), value)])


def spe_line_values(counters: DataFrame) -> DataFrame:
    """The five outcome metrics of a line with sampling counters."""
    def rate(part: str, other: str, reason: str) -> Column:
        total = F.col(part) + F.col(other)
        return F.when(total == 0, M.missing(reason)).otherwise(M.number(F.try_divide(F.col(part), total)))

    average = F.when(F.col("latency_count") == 0, M.missing("SPE latency field unavailable")).otherwise(
        M.number(F.try_divide("latency_sum", "latency_count")))
    values = (
        M.number(F.col("sample_count")), average,
        rate("cache_hits", "cache_misses", "SPE cache outcome unavailable"),
        rate("branch_mispredict", "branch_correct", "SPE branch outcome unavailable"),
        M.number(F.col("decode_error_count")),
    )
    return counters.select(*LINE, *[v.alias(k) for k, v in zip(SPE_COLUMNS, values)])


def spe_counters_by_line(by_address: DataFrame, placed: DataFrame) -> DataFrame:
    sums = ("sample_count", "latency_sum", "latency_count", "cache_hits", "cache_misses",
            "branch_correct", "branch_mispredict", "decode_error_count")
    return at_lines(by_address, placed).groupBy(*LINE).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.bit_or("operation_flags_or").alias("operation_flags_or"),
        F.bit_or("event_flags_or").alias("event_flags_or"))


def frequency_by_line(base: DataFrame, placed: DataFrame, dimension: str) -> DataFrame:
    """Latency frequency of one dimension over attributed addresses."""
    rows = base.filter(F.col(dimension).isNotNull()).withColumnRenamed(dimension, "name")
    merged = L.merge(rows, [*ADDRESS, "name"])
    return L.merge(at_lines(merged, placed), [*LINE, "name"])


def frequency_by_dimension(base: DataFrame, placed: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Latency frequency of several dimensions at once: ``(line, dimension, name, latency, cnt)``; a latency may come in several rows.

    Rows move once, by their line and before they are taken apart by dimension, so all
    that follows per line finds them in place. ``base`` holds frequencies by address,
    so a line has at most as many rows as its addresses have latencies.
    """
    rows = at_lines(base.select(*ADDRESS, *dimensions, "latency", "cnt"), placed).drop(*ADDRESS).repartition(*LINE)
    merged = L.merge(rows, [*LINE, *dimensions])
    named = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("name")) for d in dimensions])
    return merged.select(*LINE, "latency", "cnt", F.inline(named)).filter("name is not null")


def statistics_by_line(freq: DataFrame) -> DataFrame:
    """One row per line: the latency statistics of its names of all dimensions, a few numbers instead of 14 metrics a name."""
    stats = L.statistics(freq, [*LINE, "dimension", "name"])
    # At most the fixed vocabularies of the dimensions.
    return stats.groupBy(*LINE).agg(F.collect_list(F.struct(*[c for c in stats.columns if c not in LINE])).alias("statistics"))


def dimension_totals(by_line: DataFrame) -> Column:
    """Samples ``n`` and ``cycles`` of all lines by dimension, from their statistics."""
    whole = F.struct(F.sum("sample_count").alias("n"), F.coalesce(F.sum("latency_sum"), F.lit(0)).alias("cycles"))
    per = by_line.select(F.inline("statistics")).groupBy("dimension").agg(whole.alias("_t"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("dimension", "_t")))).scalar()


def _sparse(entries: Column) -> Column:
    return F.filter(entries, lambda e: ~((e["value"]["state"] == "number") & (e["value"]["value"] == 0.0)))


def metric_entries(statistics: Column, dimension: str, total: Column, baseline: S.Baseline) -> Column:
    """(key, value) of the nonzero metrics of a line in one dimension; see ``statistics_by_line`` and ``sampling.line_metrics``."""
    def of_name(s: Column) -> Column:
        values = S.line_metric_values(total, baseline, lambda name: s[name])
        name = F.concat(F.lit(DIMENSION_PREFIX[dimension]), s["name"], F.lit("."))
        return F.array(*[F.struct(F.concat(name, F.lit(metric)).alias("key"), value.alias("value")) for metric, value in values.items()])

    return _sparse(F.flatten(F.transform(F.filter(statistics, lambda s: s["dimension"] == dimension), of_name)))


def outcome_facts(spe_values: DataFrame) -> DataFrame:
    """(file, line, outcome): the nonzero outcome metrics of lines as a list of (key, value)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in SPE_COLUMNS])
    return spe_values.select(*LINE, _sparse(pairs).alias("outcome"))


def no_outcome_facts(placed: DataFrame) -> DataFrame:
    """``outcome_facts`` of a report without sampling."""
    return placed.limit(0).select(*LINE, F.lit(None).cast(ENTRIES).alias("outcome"))


def joined_entries(*lists: Column) -> Column:
    """The (key, value) of several lists, which may be null, as one list."""
    return F.concat(*[F.coalesce(e, F.array().cast(ENTRIES)) for e in lists])


def name_facts(placed: DataFrame) -> DataFrame:
    """Functions and modules of the addresses of lines, with the order in which names count."""
    return placed.filter("file is not null").select(
        *LINE, F.struct("lane", "mapping_id", (F.col("ip") < 0).alias("negative"), "ip").alias("name_order"), "function", "module_id")


def collected(facts: DataFrame) -> DataFrame:
    """One row per sampled line from the long table of its facts: counters, outcomes, names and ids in one aggregation.

    Facts are ``file, line`` and, null where they do not apply, the columns of
    ``counters_by_line``, ``outcome_facts``, ``name_facts`` and (cpu, tid). Lines that
    have neither a counter nor an outcome are left out.
    """
    def first(column: str) -> Column:
        order = F.when(F.col(column) != "", F.col("name_order"))
        return F.coalesce(F.min_by(column, order), F.lit(""))

    return facts.groupBy(*LINE).agg(
        *_counter_columns(), F.first("outcome", ignorenulls=True).alias("outcome"), first("function").alias("function"), first("module_id").alias("module"),
        id_list_text(F.collect_set("cpu")).alias("cpu"), id_list_text(F.collect_set("tid")).alias("thread"),
        F.bool_or(F.col("event_key").isNotNull() | F.col("outcome").isNotNull()).alias("_sampled")).filter("_sampled").drop("_sampled")


def line_names(placed: DataFrame) -> DataFrame:
    """First non-empty function and module of a line, lanes in order, addresses in unsigned order."""
    order = F.struct("lane", "mapping_id", F.col("ip") < 0, "ip")
    known = placed.filter("file is not null")
    return known.groupBy(*LINE).agg(
        F.coalesce(F.min_by("function", F.when(F.col("function") != "", order)), F.lit("")).alias("function"),
        F.coalesce(F.min_by("module_id", F.when(F.col("module_id") != "", order)), F.lit("")).alias("module"))


def line_ids(ids: DataFrame, placed: DataFrame) -> DataFrame:
    """Cpus and threads seen on a line, as numeric lists."""
    seen = at_lines(ids, placed).select(*LINE, "cpu", "tid").distinct()
    return seen.groupBy(*LINE).agg(
        id_list_text(F.collect_set("cpu")).alias("cpu"), id_list_text(F.collect_set("tid")).alias("thread"))


def with_source(sampled: DataFrame, source: DataFrame) -> DataFrame:
    """All source lines and all sampled lines; code is '' where the text has no such line."""
    return source.select(*LINE, "code").join(sampled, LINE, "full_outer").withColumn(
        "code", F.coalesce("code", F.lit("")))


def with_copies(sampled: DataFrame, source: DataFrame) -> DataFrame:
    """Sampled lines with ``copies``, the number of rows that ``with_source`` makes of each; no code is moved."""
    return sampled.join(source.groupBy(*LINE).agg(F.count(F.lit(1)).alias("copies")), LINE, "left").withColumn(
        "copies", F.coalesce("copies", F.lit(1)))


def percentages(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Share of a line in the report and in its file, for self and accumulated weight; a row counts ``copies`` times in them."""
    own, acc = F.col("self_weight"), F.col("accumulated_weight")
    times = F.lit(1) if copies is None else copies
    total = rows.agg(F.struct(F.sum(own * times).alias("s"), F.sum(acc * times).alias("a"))).scalar()
    files = rows.groupBy("file").agg(F.sum(own * times).alias("_fs"), F.sum(acc * times).alias("_fa"))
    return (
        rows.join(files, "file").withColumn("_t", total).select(
            *rows.columns, M.percent(own, F.col("_t.s")).alias("p_pct"), M.percent(acc, F.col("_t.a")).alias("acc_p_pct"),
            M.percent(own, F.col("_fs")).alias("file_p_pct"), M.percent(acc, F.col("_fa")).alias("file_acc_p_pct")))


def finish(lines: DataFrame, plan: CounterPlan, entries: Mapping[str, Column]) -> DataFrame:
    """Fill absent values, build the maps, status and detail; metric maps are made of each row's numbers here, and never moved.

    ``lines`` has ``file, line, code`` and, null where nothing was sampled, the columns
    of the line operators above and of ``percentages``: a line without weight has no
    share in anything. ``entries`` are the lists of (key, value) of the metric maps.
    """
    empty = F.create_map().cast(f"map<string,{M.TYPE}>")
    # A row without a file is in no file's report.
    rows = lines.filter("file is not null").withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in ("function", "module", "cpu", "thread")},
        "sample_count": F.coalesce("sample_count", F.lit(0)),
        **{c: F.coalesce(c, F.lit(0.0)) for c in (
            "self_weight", "accumulated_weight", "p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct")}})
    counts = F.coalesce("event_samples", F.create_map().cast("map<string,bigint>"))
    made = {m: F.coalesce(F.map_from_entries(entries[m]), empty) if m in entries else empty for m in METRIC_MAPS[1:]}
    spe = made.pop("spe_values")
    if not plan.spe_available:
        reason = M.missing(plan.spe_missing_reason or "SPE unavailable")
        spe = F.map_from_entries(F.transform(
            F.array(*[F.lit(k) for k in spe_column_keys()]), lambda k: F.struct(k, reason)))
    finished = rows.select(
        *LINE, "code", "function", "module", "cpu", "thread", "sample_count", "self_weight", "accumulated_weight",
        pmu_values(counts, F.col("sample_count"), plan).cast(f"map<string,{M.TYPE}>").alias("pmu_values"),
        spe.alias("spe_values"), *[column.alias(m) for m, column in made.items()],
        "p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct")
    maps = [F.col(m) for m in METRIC_MAPS]
    return finished.withColumns({"status": M.row_status(maps), "detail": M.row_detail(maps)})


def summarize_files(rows: DataFrame) -> DataFrame:
    hot = F.col("status").contains("NonZero")
    return rows.groupBy("file").agg(
        F.sum("self_weight").alias("self_weight"), F.sum("accumulated_weight").alias("accumulated_weight"),
        F.count_if(hot).alias("sample_count"), F.count_if(hot).alias("hot_lines"),
        F.count_if(F.col("status").contains("Missing")).alias("missing"),
        F.count_if(F.col("status").contains("Unresolved")).alias("unresolved"),
        F.coalesce(F.max(F.when(hot, F.col("line"))), F.min("line")).alias("hot_line"))


def summarize_functions(rows: DataFrame) -> DataFrame:
    hot = F.col("status").contains("NonZero")
    name = F.when(F.col("function") == "", F.lit(UNKNOWN_FUNCTION)).otherwise(F.col("function"))
    return rows.withColumn("function", name).groupBy("file", "function").agg(
        F.min("line").alias("line_start"), F.max("line").alias("line_end"),
        F.min_by("module", "line").alias("module"),
        F.sum("self_weight").alias("self_weight"), F.sum("accumulated_weight").alias("accumulated_weight"),
        F.count_if(hot).alias("sample_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(hot, F.col("line")))), ", ").alias("hot_lines"))


def _metric_values() -> Column:
    return F.concat(F.map_values("pmu_values"), F.map_values("spe_values"))


def _sum_numbers(values: Column) -> Column:
    numbers = F.transform(values, lambda m: F.coalesce(M.metric_number(m), F.lit(0.0)))
    return F.aggregate(numbers, F.lit(0.0), lambda total, v: total + v)


def _count_state(values: Column, state: str) -> Column:
    return F.size(F.filter(values, lambda m: m["state"] == state))


def typed_file_summary(rows: DataFrame) -> DataFrame:
    """Sum of nonzero numbers, lines with one, and missing/unresolved *metric* counts per file."""
    values = _metric_values()
    nonzero = F.exists(values, lambda m: M.classify(m) == "nonzero")
    return rows.groupBy("file").agg(
        F.sum(_sum_numbers(values)).alias("total_self_weight"),
        F.count_if(nonzero).alias("nonzero_line_count"), F.count_if(nonzero).alias("sample_count"),
        F.sum(_count_state(values, "unresolved")).alias("unresolved_count"),
        F.sum(_count_state(values, "missing")).alias("missing_metric_count"))


def typed_function_summary(rows: DataFrame) -> DataFrame:
    """Functions with the rows whose metric sum is positive."""
    total = _sum_numbers(_metric_values())
    hot = total > 0
    name = F.coalesce("function", F.lit(UNKNOWN_FUNCTION))
    return rows.withColumn("function", name).groupBy("file", "function").agg(
        F.min("line").alias("line_start"), F.max("line").alias("line_end"),
        F.min_by("module", "line").alias("module"),
        F.coalesce(F.sum(F.when(hot, total)), F.lit(0.0)).alias("self_weight"),
        F.count_if(hot).alias("sample_count"),
        F.array_sort(F.collect_list(F.when(hot, F.col("line")))).alias("hot_lines"))


def metric_summary(long: DataFrame) -> DataFrame:
    """Across rows, per key: the sum of numbers, else the strongest state, else 0."""
    state = F.col("value.state")
    grouped = long.groupBy("key").agg(
        F.sum("value.value").alias("_sum"), F.count_if(state == "number").alias("_numbers"),
        *[F.bool_or(state == s).alias(f"_{s}") for s in ("unresolved", "missing", "undefined")])
    text = (F.when(F.col("_numbers") > 0, summary_text(F.col("key"), F.col("_sum")))
            .when(F.col("_unresolved"), F.lit("Unresolved")).when(F.col("_missing"), F.lit("Missing"))
            .when(F.col("_undefined"), F.lit("N/A")).otherwise(F.lit("0")))
    return grouped.select("key", text.alias("summary"))


def shown_metrics(summary: DataFrame) -> DataFrame:
    """The summarised keys that get a column: those whose text is neither blank, a state nor zero."""
    return summary.filter(~is_zero_text(F.col("summary")))


def long_metrics(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(*LINE, F.explode(column).alias("key", "value"))


def cycles_by_cpu(runs: DataFrame) -> DataFrame:
    """Counter cycles per cpu: the scaled count when it is finite and positive, else the raw one."""
    scaled = F.col("scaled_count")
    usable = (scaled > 0) & ~F.isnan(scaled) & (scaled < float("inf"))
    return runs.filter("event_key = 'cpu_cycles'").groupBy("cpu").agg(
        F.sum(F.when(usable, scaled).otherwise(F.col("raw_count").cast("double"))).alias("cycles"))


def effective_seconds(runs: DataFrame, duration_ms: Column) -> Column:
    """Longest running time of any run, else the recording's duration; null when not positive."""
    longest = runs.agg(F.max("time_running_ns")).scalar()
    nanos = F.coalesce(longest, duration_ms * 1_000_000)
    return F.when(nanos > 0, nanos / 1e9)


def sampling_period(requested: Column, devices: DataFrame) -> Column:
    """Largest of the requested period, any device's minimum interval, and 1."""
    floor = devices.agg(F.max("min_interval")).scalar()
    return F.greatest(requested, F.coalesce(floor, F.lit(0)), F.lit(1)).cast("double")

"""Printed forms of the report tables, shared by the CSV, JSON and sheet sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaprof.functions import metric_value as M
from lumaprof.functions.address import hex_text
from lumaprof.functions.metric_value import fixed_text
from lumaprof.functions.names import BREAKDOWN_METRICS, dimension_metric_keys, spe_column_keys


def _pct(column: str) -> Column:
    return fixed_text(F.col(column), 6).alias(column)


def _whole(column: str, name: str | None = None) -> Column:
    return fixed_text(F.col(column), 0).alias(name or column)


def plain_number(value: Column) -> Column:
    """A double as written: whole numbers without a fraction."""
    return F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(value.cast("string"))


def fixed_line_columns() -> list[Column]:
    texts = [F.col(c) if c != "line" else F.col(c).cast("string").alias(c)
             for c in ("file", "line", "function", "module", "cpu", "thread", "code", "status")]
    return [*texts, *[_pct(c) for c in ("p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct")],
            _whole("self_weight"), _whole("accumulated_weight", "acc_weight")]


def metric_columns(pmu_keys: Sequence[str]) -> list[tuple[str, str]]:
    """``(map column, key)`` of every metric column in report order."""
    return ([("pmu_values", k) for k in pmu_keys] + [("spe_values", k) for k in spe_column_keys()]
            + [("instruction_values", k) for k in dimension_metric_keys("class")]
            + [("load_instruction_values", k) for k in dimension_metric_keys("kind")])


def line_rows(rows: DataFrame, pmu_keys: Sequence[str], columns: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Line rows as text: 14 fixed columns, then the metric columns; an absent metric prints 0."""
    wanted = metric_columns(pmu_keys) if columns is None else columns
    metrics = [M.metric_text(F.try_element_at(source, F.lit(key))).alias(key) for source, key in wanted]
    return rows.select(*fixed_line_columns(), *metrics)


def sampled(rows: DataFrame) -> DataFrame:
    return rows.filter("status <> '0'")


def file_rows(files: DataFrame) -> DataFrame:
    return files.select(
        "file", plain_number(F.col("self_weight")).alias("self_weight"),
        plain_number(F.col("accumulated_weight")).alias("acc_weight"), "sample_count", "hot_lines", "unresolved", "missing")


def function_rows(functions: DataFrame) -> DataFrame:
    return functions.select(
        "function", "file", "line_start", "line_end", "module", plain_number(F.col("self_weight")).alias("self_weight"),
        plain_number(F.col("accumulated_weight")).alias("acc_weight"), F.col("sample_count").alias("samples"))


def frame_rows(frames: DataFrame) -> DataFrame:
    return frames.select(
        "role", "module", "function", hex_text(F.col("ip")).alias("ip"),
        hex_text(F.col("relative_address")).alias("relative_address"), "mapping_id", "cpu", "thread", "sample_count",
        _whole("self_weight"), _whole("accumulated_weight", "acc_weight"), _pct("p_pct"), _pct("acc_p_pct"),
        "event_weights", "status")


def callchain_rows(callchains: DataFrame) -> DataFrame:
    return callchains.select("stack", "leaf", "root", "cpu", "thread", "sample_count", _whole("weight"), _pct("p_pct"),
                             "event_weights")


# --- fixed values: breakdown sheet headers ------------------------------------
BREAKDOWN_HEADERS = dict(zip(BREAKDOWN_METRICS, (
    "sample%", "est_time%", "all est_time%", "min_latency_cycles", "max_latency_cycles", "avg_latency_cycles",
    "std_latency_cycles", "p95_latency_cycles", "p99_latency_cycles", ">p95 est_time%", ">avg est_time%",
    ">p95 all est_time%", ">avg all est_time%")))


def breakdown_sheet(printed: DataFrame) -> DataFrame:
    """Breakdown rows under their sheet headers, in report order."""
    ordered = printed.orderBy("cpu", "category_ordinal", F.when(F.col("level") == "parent", 0).otherwise(1), "child_ordinal")
    return ordered.select(F.col("cpu").alias("CPU"), F.col("category").alias("Parent"), F.col("child").alias("Child"),
                          F.col("level").alias("Level"), *[F.col(m).alias(h) for m, h in BREAKDOWN_HEADERS.items()])


def per_cpu_sheet(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long per-cpu metrics to one row per (cpu, name); rows where no shown metric is a nonzero number are left out.

    The pivot is over the fixed metric list, so it is one aggregation without a pass for values.
    """
    wide = long.groupBy("cpu", "name").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    shown = F.lit(False)
    for m in metrics:
        shown = shown | F.coalesce(M.metric_number(F.col(m)) != 0.0, F.lit(False))
    return wide.filter(shown)


def numeric_line_rows(rows: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Line rows with metrics as doubles; states that are no number are null."""
    fixed = ["file", "line", "function", "module", "cpu", "thread", "code", "status", "p_pct", "acc_p_pct",
             "file_p_pct", "file_acc_p_pct", "self_weight", F.col("accumulated_weight").alias("acc_weight")]
    return rows.select(*fixed, *[M.metric_number(F.try_element_at(source, F.lit(key))).alias(key) for source, key in columns])


def numeric_file_rows(files: DataFrame) -> DataFrame:
    """File rows with numbers in place of text; the further tables likewise."""
    return files.select("file", "self_weight", F.col("accumulated_weight").alias("acc_weight"), "sample_count", "hot_lines", "unresolved", "missing")


def numeric_function_rows(functions: DataFrame) -> DataFrame:
    return functions.select("function", "file", "line_start", "line_end", "module", "self_weight",
                            F.col("accumulated_weight").alias("acc_weight"), F.col("sample_count").alias("samples"))


def numeric_frame_rows(frames: DataFrame) -> DataFrame:
    return frames.select(
        "role", "module", "function", hex_text(F.col("ip")).alias("ip"), hex_text(F.col("relative_address")).alias("relative_address"),
        "mapping_id", "cpu", "thread", "sample_count", "self_weight", F.col("accumulated_weight").alias("acc_weight"), "p_pct", "acc_p_pct",
        "event_weights", "status")


def numeric_callchain_rows(callchains: DataFrame) -> DataFrame:
    return callchains.select("stack", "leaf", "root", "cpu", "thread", "sample_count", "weight", "p_pct", "event_weights")

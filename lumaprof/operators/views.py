"""Filtered, ordered, paged views over the report tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaprof.functions.names import CATEGORY_METRICS, DEFAULT_PAGE_SIZE, DIMENSION_NAMES, SPE_COLUMNS, UNKNOWN_FUNCTION
from lumaprof.operators.lookup import sliced


@dataclass(frozen=True)
class LineFilter:
    """Options of a source line query; unset options do not filter."""

    text: str | None = None
    cpu: str | None = None
    thread: str | None = None
    min_samples: int | None = None
    nonzero_only: bool = False
    function_only: bool = False
    missing_only: bool = False
    unresolved_only: bool = False
    sort: str = "file"
    desc: bool = False
    sampled_first: bool = False
    function_first: bool = False
    limit: int | None = None
    offset: int = 0


def page_limit(limit: int | None) -> int:
    """Rows of a page: what the caller asks for, at least one row."""
    return max(DEFAULT_PAGE_SIZE if limit is None else limit, 1)


def _like(column: str, text: str) -> Column:
    """ASCII case-insensitive substring pattern; ``%`` and ``_`` keep their meaning."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fold = F.translate(F.col(column), upper, upper.lower())
    folded = "".join(c.lower() if c in upper else c for c in text)
    # Spark reads backslash as an escape in patterns; the view's patterns have none.
    return fold.like("%" + folded.replace("\\", "\\\\") + "%")


def has_function() -> Column:
    return ~F.col("function").isin("", UNKNOWN_FUNCTION)


def is_sampled() -> Column:
    return (F.col("self_weight") > 0) | (F.col("accumulated_weight") > 0)


def filter_lines(lines: DataFrame, query: LineFilter) -> DataFrame:
    rows = lines
    text = (query.text or "").strip()
    if text:
        rows = rows.filter(_like("file", text) | _like("function", text) | _like("code", text))
    for column in ("cpu", "thread"):
        wanted = (getattr(query, column) or "").strip()
        if wanted:
            rows = rows.filter(_like(column, wanted))
    if query.min_samples is not None:
        rows = rows.filter(F.col("sample_count") >= query.min_samples)
    if query.nonzero_only:
        rows = rows.filter(is_sampled())
    if query.function_only:
        rows = rows.filter(has_function())
    if query.missing_only:
        rows = rows.filter(F.col("status").contains("Missing"))
    if query.unresolved_only:
        rows = rows.filter(F.col("status").contains("Unresolved"))
    return rows


LINE_SORTS = {
    **{c: c for c in ("file", "line", "function", "module", "cpu", "thread", "status", "code", "sample_count",
                      "self_weight", "accumulated_weight", "p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct")},
    "samples": "sample_count", "self": "self_weight", "acc": "accumulated_weight",
}
TEXT_METRIC_SORTS = ("cpi", "l1d_cache_hit_rate", "mips", "mcps")
FILE_SORTS = {
    **{c: c for c in ("file", "self_weight", "accumulated_weight", "sample_count", "hot_lines", "missing", "unresolved")},
    "self": "self_weight", "acc": "accumulated_weight", "samples": "sample_count",
}


def metric_column(key: str) -> str | None:
    """The JSON column a metric key lives in, or null when the key is not a metric key."""
    def listed(dimension: str, rest: str) -> bool:
        name, dot, metric = rest.partition(".")
        return bool(dot) and name in DIMENSION_NAMES[dimension] and metric in ("sample_count", *CATEGORY_METRICS)

    if key in SPE_COLUMNS or listed("category", key):
        return "spe_json"
    if key.startswith("instruction_class.") and listed("class", key.removeprefix("instruction_class.")):
        return "instruction_json"
    if key.startswith("load_instruction.") and listed("kind", key.removeprefix("load_instruction.")):
        return "load_instruction_json"
    return "pmu_json" if re.fullmatch(r"[a-z0-9_]*", key) else None


def _as_number(text: Column) -> Column:
    """A printed metric as a number; state names count as 0, an absent one stays null."""
    return F.when(text.isNotNull(), F.coalesce(text.try_cast("double"), F.lit(0.0)))


def line_order(query: LineFilter) -> list[Column]:
    """Whitelisted order; an unknown key orders by file. Nulls are smallest."""
    key = query.sort
    if key in LINE_SORTS:
        column = F.col(LINE_SORTS[key])
    elif key in TEXT_METRIC_SORTS:
        column = _as_number(F.col(key))
    elif source := metric_column(key):
        column = _as_number(F.from_json(source, "map<string,string>")[key])
        column = column if source == "pmu_json" else F.coalesce(column, F.lit(0.0))
    else:
        column = F.col("file")
    first = [F.when(test, 0).otherwise(1).asc() for wanted, test in (
        (query.sampled_first, is_sampled()), (query.function_first, has_function())) if wanted]
    return [*first, column.desc_nulls_last() if query.desc else column.asc_nulls_first(), F.asc("file"), F.asc("line")]


def query_lines(lines: DataFrame, query: LineFilter) -> tuple[DataFrame, DataFrame]:
    """``(total, page)``: a one-row count before paging, and the ordered page."""
    rows = filter_lines(lines, query)
    page = rows.orderBy(*line_order(query)).offset(query.offset).limit(page_limit(query.limit))
    return rows.agg(F.count(F.lit(1)).alias("total")), page


def save_ranked(rows: DataFrame, order: list[Column], path: str, slice_rows: int | None = None) -> None:
    """Save a table in consecutive ranges of its order, with the first position and row count of each range."""
    ranges = sliced(rows, order, slice_rows)
    ranges.write.partitionBy("_slice").parquet(f"{path}/rows")
    # One row per range.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ranges.groupBy("_slice").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "start", F.coalesce(F.sum("count").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/ranges")


def ranked_page(spark: SparkSession, path: str, order: list[Column], offset: int, limit: int | None = None) -> DataFrame:
    """A page of a saved ranking with 1-based positions: opens only the ranges that it overlaps, however deep it lies."""
    size = page_limit(limit)
    hit = spark.read.parquet(f"{path}/ranges").filter((F.col("start") < offset + size) & (F.col("start") + F.col("count") > offset))
    found = hit.orderBy("start").collect()
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("_slice").isin([r["_slice"] for r in found])).drop("_slice")
    inside = offset - found[0]["start"] if found else 0
    # At most a page.
    return rows.orderBy(*order).offset(inside).limit(size).withColumn("position", F.row_number().over(Window.orderBy(*order)) + offset)


def query_files(files: DataFrame, text: str | None = None, sort: str = "self", desc: bool = True,
                limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    wanted = (text or "").strip()
    rows = files.filter(_like("file", wanted)) if wanted else files
    column = F.col(FILE_SORTS.get(sort, "self_weight"))
    order = [column.desc() if desc else column.asc(), F.desc("accumulated_weight"), F.asc("file")]
    page = rows.orderBy(*order).offset(offset).limit(page_limit(limit))
    return rows.agg(F.count(F.lit(1)).alias("total")), page


def query_functions(functions: DataFrame, limit: int | None = None) -> DataFrame:
    """All functions in order, or the first ``limit``."""
    order = [F.desc("self_weight"), F.desc("accumulated_weight"), F.asc("function"), F.asc("file")]
    ordered = functions.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def top(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    return rows.orderBy(*order).limit(count)


def first_diagnostics(warnings: DataFrame, shown: int) -> DataFrame:
    """The first warnings in order, and one row counting the rest."""
    head = warnings.orderBy("ordinal").limit(shown).select("ordinal", "warning")
    more = warnings.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > shown).select(
        F.lit(None).cast("bigint").alias("ordinal"),
        F.concat((F.col("_n") - shown).cast("string"), F.lit(" additional warnings omitted")).alias("warning"))
    return head.unionByName(more)


def breakdown_order(rows: DataFrame, key: str, ascending: bool | None = None) -> tuple[DataFrame, list[Column]]:
    """Breakdown rows with their parent's sort value, and the order that keeps children below parents.

    Missing values come last ascending; descending reverses the whole parent
    order, ties included. Text keys and cpu start ascending, metrics descending.
    """
    if ascending is None:
        ascending = key in ("cpu", "category")
    if key in ("cpu", "category"):
        value = F.col(key)
        rows = rows.withColumn("_key", value)
    else:
        parents = rows.filter("level = 'parent'").select("cpu", "category", F.regexp_replace(
            F.replace(F.trim(key), F.lit(",")), "%$", "").try_cast("double").alias("_key"))
        rows = rows.join(parents, ["cpu", "category"])
    position = [F.col("cpu"), F.col("category_ordinal")]
    if ascending:
        order = [F.col("_key").asc_nulls_last(), *[p.asc() for p in position]]
    else:
        order = [F.col("_key").desc_nulls_first(), *[p.desc() for p in position]]
    return rows, [*order, F.when(F.col("level") == "parent", 0).otherwise(1).asc(),
                  F.asc("child_ordinal")]


def first_graphs(ranked: DataFrame, count: int) -> DataFrame:
    """The first ``count`` thread graphs of every event, in (process, thread) order of its export."""
    order = Window.partitionBy("event").orderBy("process_rank", "thread_rank", "pid", "tid")
    return ranked.withColumn("graph", F.row_number().over(order)).filter(F.col("graph") <= count)

"""Text rendering rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaprof.functions.metric_value import bound, fixed_text, metric_text
from lumaprof.functions.names import SPE_COLUMNS


def escape_angles(text: Column) -> Column:
    """``<`` and ``>`` only, for names inside an embedded JSON blob."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_html(text: Column) -> Column:
    """Ampersand first, then angle brackets and double quotes."""
    safe = escape_angles(F.replace(text, F.lit("&"), F.lit("&amp;")))
    return F.replace(safe, F.lit('"'), F.lit("&quot;"))


def lane_text(enabled: Column, available: Column) -> Column:
    return F.concat(
        F.when(enabled, F.lit("enabled")).otherwise(F.lit("disabled")), F.lit(" / "),
        F.when(available, F.lit("available")).otherwise(F.lit("missing")),
    )


def weights_text(weights: Column) -> Column:
    """``key=value, ...`` of a map, in key order."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(weights)),
                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")


def id_list_text(ids: Column) -> Column:
    """Numeric set as ``0,7``."""
    return F.array_join(F.array_sort(F.array_distinct(ids)).cast("array<string>"), ",")


def summary_text(key: Column, value: Column) -> Column:
    """Percent keys, latency bounds and plain numbers each have their precision."""
    scaled = bound(value, lambda v: F.when(F.abs(v) >= 1000.0, fixed_text(v, 0)).otherwise(fixed_text(v, 3)))
    return (
        F.when(key.endswith("_pct"), F.concat(scaled, F.lit("%")))
        .when(key.endswith("min_latency_cycles") | key.endswith("max_latency_cycles"),
              fixed_text(value, 0))
        .otherwise(scaled)
    )


def is_zero_text(text: Column) -> Column:
    """Does a printed summary show nothing: blank, a state name, or zero."""
    return bound(text, lambda t: (F.trim(t) == "") | t.isin("N/A", "Missing", "Unresolved") | F.coalesce(
        F.regexp_replace(F.trim(t), "%+$", "").try_cast("double") == 0.0, F.lit(False)))


def record_time(epoch_seconds: Column, zone: str | None = None) -> Column:
    """``2024-01-31 (Wednesday) 10:20:30`` in a time zone (the session's by default); '' if not a number."""
    stamp = F.timestamp_seconds(epoch_seconds.try_cast("bigint"))
    if zone is not None:
        since = F.make_dt_interval(secs=epoch_seconds.try_cast("bigint").cast("decimal(18,6)"))
        stamp = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since)
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd (EEEE) HH:mm:ss"), F.lit(""))


def machine_type(product_props: Column, arch: Column) -> Column:
    """``model (device) by maker, arch x`` from ``maker:model:device``, else the arch."""
    parts = F.split(product_props, ":", 3)
    full = F.concat(F.get(parts, F.lit(1)), F.lit(" ("), F.get(parts, F.lit(2)), F.lit(") by "),
                    F.get(parts, F.lit(0)), F.lit(", arch "), arch)
    return F.when(F.size(parts) == 3, full).otherwise(arch)


def annotation(row: Mapping[str, Column], metrics: Column, tag: str,
               sample_count: Column | None = None) -> Column:
    """The comment placed above a sampled line; ``metrics`` is an array of ``key=text``."""
    def or_missing(text: Column) -> Column:
        return F.when(text == "", F.lit("Missing")).otherwise(text)

    head = [] if sample_count is None else [
        F.concat(F.lit("sample_count="), sample_count.cast("string"))]
    head += [F.concat(F.lit(f"{label}="), fixed_text(row[column], 6), F.lit("%"))
             for label, column in (("p", "p_pct"), ("acc_p", "acc_p_pct"),
                                   ("file_p", "file_p_pct"), ("file_acc_p", "file_acc_p_pct"))]
    head += [F.concat(F.lit(f"{label}="), fixed_text(row[column], 0))
             for label, column in (("self_weight", "self_weight"),
                                   ("acc_weight", "accumulated_weight"))]
    head += [F.concat(F.lit("cpu="), or_missing(row["cpu"])),
             F.concat(F.lit("thread="), or_missing(row["thread"]))]
    parts = F.concat(F.array(*head), metrics,
                     F.array(F.concat(F.lit("status="), row["status"])))
    return F.concat(F.lit(f"// {tag} "), F.array_join(parts, ", "))


def query_metric_parts(pmu_texts: Column, spe_texts: Column) -> Column:
    """All counter texts in key order, then the fixed sampling keys that are present."""
    pmu = F.transform(F.array_sort(F.map_entries(pmu_texts)),
                      lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    spe = F.filter(
        F.array(*[F.concat(F.lit(f"{key}="), spe_texts[key]) for key in SPE_COLUMNS]),
        lambda part: part.isNotNull())
    return F.concat(pmu, spe)


def file_metric_parts(pmu: Column, spe: Column, pmu_keys: list[str], spe_keys: list[str]) -> Column:
    """Every shown column in column order; absent metrics print as 0."""
    def parts(metrics: Column, keys: list[str]) -> Column:
        return F.transform(
            F.array(*[F.lit(key) for key in keys]),
            lambda key: F.concat(key, F.lit("="), metric_text(F.element_at(metrics, key))))

    pieces = [parts(pmu, pmu_keys)] + ([parts(spe, spe_keys)] if spe_keys else [])
    return F.concat(*pieces)


def weight_text(count: Column, total: Column, style: str, is_clock: Column | None = None) -> Column:
    """Display form of an event count: ``percent``, ``count`` or ``ms`` (clock events only)."""
    if style == "percent":
        return F.concat(F.format_string("%.2f", count * 100.0 / total), F.lit("%"))
    if style == "ms":
        return F.when(is_clock, F.concat(F.format_string("%.3f", count / 1e6), F.lit(" ms")))
    return F.format_number(count, 0)


def is_clock_event(name: Column) -> Column:
    return name.contains("task-clock") | name.contains("cpu-clock")

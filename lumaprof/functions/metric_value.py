"""The metric value algebra: a number, or a reason why there is none.

A metric value is ``struct<state, value, reason>`` with state ``number``,
``missing``, ``unresolved`` or ``undefined``; it is never a bare null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<state:string,value:double,reason:string>"


def _value(state: str, value: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(state).alias("state"),
        value.cast("double").alias("value"),
        reason.cast("string").alias("reason"),
    )


def number(value: Column) -> Column:
    return _value("number", value, F.lit(None))


def missing(reason: str | Column) -> Column:
    return _value("missing", F.lit(None), F.lit(reason))


def unresolved(reason: str | Column) -> Column:
    return _value("unresolved", F.lit(None), F.lit(reason))


def undefined(reason: str | Column) -> Column:
    return _value("undefined", F.lit(None), F.lit(reason))


def classify(metric: Column) -> Column:
    """zero, nonzero, missing, unresolved or undefined."""
    return (
        F.when(metric["state"] != "number", metric["state"])
        .when(metric["value"] == 0.0, F.lit("zero"))
        .otherwise(F.lit("nonzero"))
    )


def line_metric(key: Column, available: Column, attributed: Column, value: Column) -> Column:
    """Capability first, attribution second, then the number (null counts as 0)."""
    return (
        F.when(~available, missing(F.concat(key, F.lit(" capability is unavailable"))))
        .when(~attributed, unresolved(
            F.concat(key, F.lit(" samples exist but source attribution failed"))))
        .otherwise(number(F.coalesce(value, F.lit(0.0))))
    )


def percent(value: Column, total: Column) -> Column:
    """Share in percent; 0 when the total is not positive."""
    return F.when(total > 0, value.cast("double") / total.cast("double") * 100.0).otherwise(0.0)


def fixed_text(value: Column, digits: int) -> Column:
    """Decimal text rounded from the exact binary value, ties to even.

    Formatting functions round the shortest decimal form instead, which differs
    for values such as 0.0000055. Near a tie the exact product ``2 * 10^digits *
    value`` is compared with the odd integer it would equal: the value is split
    in two halves whose products are exact in double arithmetic.
    """
    return bound(value.cast("double"), lambda v: _rounded_text(v, digits))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use).getItem(0)


def _rounded_text(value: Column, digits: int) -> Column:
    x = F.abs(value)
    scale = 10.0 ** digits
    low = F.floor(x * scale).cast("double")
    carry = x * 134217729.0
    high = carry - (carry - x)
    side = (high * (2 * scale) - (low * 2 + 1)) + (x - high) * (2 * scale)
    is_odd = low % 2 == 1
    nearest = F.when((side > 0) | ((side == 0) & is_odd), low + 1).otherwise(low) / scale
    # Beyond 2^51 units the last digit is below the precision of a double.
    rounded = F.when(x * scale < 2.0 ** 51, nearest).otherwise(x)
    text = F.format_string(f"%.{digits}f", rounded)
    return F.when(value < 0, F.concat(F.lit("-"), text)).when(value.isNotNull(), text)


def number_text(value: Column) -> Column:
    return bound(value.cast("double"), lambda v: F.when(v == F.floor(v), _rounded_text(v, 0)).otherwise(_rounded_text(v, 6)))



def metric_text(metric: Column) -> Column:
    """The printed form; an absent metric prints as 0."""
    return bound(metric, lambda m: F.when(m.isNull(), F.lit("0")).when(
        m["state"] == "number", number_text(m["value"])).otherwise(F.initcap(m["state"])))


def metric_number(metric: Column) -> Column:
    return F.when(metric["state"] == "number", metric["value"])


def drop_zeros(metrics: Column) -> Column:
    """Sparse metric map: entries that are the number 0 are not kept."""
    return F.map_filter(metrics, lambda _, m: ~((m["state"] == "number") & (m["value"] == 0.0)))


def text_map(metrics: Column) -> Column:
    return F.transform_values(metrics, lambda _, m: metric_text(m))


def map_text(metrics: Column) -> Column:
    """``{"k":"text"}`` with keys in order."""
    entries = F.array_sort(F.map_entries(text_map(metrics)))
    return F.to_json(F.map_from_entries(entries))


def row_status(maps: list[Column]) -> Column:
    """``NonZero|Missing|Unresolved|Undefined`` or ``0``; NonZero means above 0."""
    # The values of all maps are gone through once.
    states = F.transform(F.concat(*[F.map_values(m) for m in maps]), lambda m: F.when(
        m["state"] == "number", F.when(m["value"] > 0, F.lit("NonZero"))).otherwise(F.initcap(m["state"])))
    return bound(F.array_distinct(states), lambda seen: F.coalesce(F.nullif(F.concat_ws("|", *[
        F.when(F.array_contains(seen, name), F.lit(name)) for name in ("NonZero", "Missing", "Unresolved", "Undefined")]), F.lit("")), F.lit("0")))


def row_detail(maps: list[Column]) -> Column:
    """``key=text; ...``, each map in key order, maps in the given order."""
    parts = [
        F.transform(F.array_sort(F.map_entries(text_map(m))),
                    lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        for m in maps
    ]
    return F.array_join(F.concat(*parts), "; ")


def status_flags(maps: list[Column]) -> Column:
    """Distinct states in order of first appearance; nonzero has any sign here."""
    states = F.concat(*[
        F.transform(F.array_sort(F.map_entries(m)), lambda e: classify(e["value"])) for m in maps
    ])
    return F.array_distinct(F.filter(states, lambda s: s != "zero"))

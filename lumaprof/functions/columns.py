"""Report column plans, built on the driver from the small event catalog."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from lumaprof.functions.names import DERIVED_PMU_INPUTS, RAW_PMU_COLUMNS


def raw_columns(events: Sequence[tuple[str, str]], requested: Iterable[str] = ()) -> list[str]:
    """Counter columns from ``(event_key, source)`` pairs in catalog order.

    Requested keys in catalog order come first and unlisted ones after, sorted;
    without a request every counter event is shown, and without any the defaults.
    """
    wanted = set(requested)
    keys = [key for key, source in events if (key in wanted if wanted else source == "pmu")]
    keys += sorted(wanted - set(keys))
    return keys or list(RAW_PMU_COLUMNS)


def derived_columns(raw: Iterable[str]) -> list[str]:
    present = set(raw)
    return [key for key, inputs in DERIVED_PMU_INPUTS.items() if present.issuperset(inputs)]


def pmu_columns(events: Sequence[tuple[str, str]], requested: Iterable[str] = ()) -> list[str]:
    raw = raw_columns(events, requested)
    return raw + derived_columns(raw)

"""The source line report of one profile: both sample lanes to finished line rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaprof.operators import counters, lines, resolve, sampling
from lumaprof.operators.reuse import Scratch

MAPS = {"category": "spe_values", "class": "instruction_values", "kind": "load_instruction_values"}


@dataclass(frozen=True)
class Profile:
    """Inputs of a report. ``spe`` may be absent; ``spe_classes`` are the instruction classes of its addresses."""

    samples: DataFrame
    maps: DataFrame
    matches: DataFrame
    line_table: DataFrame
    source: DataFrame
    spe: DataFrame | None = None
    spe_classes: DataFrame | None = None


@dataclass(frozen=True)
class Placed:
    """Address aggregates and where their addresses resolved to; everything later reads these.

    ``addresses`` has one row per distinct address with its first ``lane``.
    """

    by_address: DataFrame
    addresses: DataFrame
    spe_by_address: DataFrame | None = None
    spe_base: DataFrame | None = None


def place(profile: Profile, held: Scratch) -> Placed:
    """Aggregate by address first, then resolve the distinct addresses of both lanes together."""
    by_address = held.written(counters.by_address(profile.samples), "by_address")
    lanes = by_address.select("mapping_id", "ip", F.lit(0).alias("lane"))
    spe_rows = base = None
    if profile.spe is not None:
        spe_rows = held.written(sampling.by_address(profile.spe), "spe_by_address")
        # As many rows as samples, at worst: written before they meet their classes, which go on to the lines.
        base = sampling.base_frequency(profile.spe, profile.spe_classes, sampling.ADDRESS, lambda rows: held.written(rows, "frequency"))
        lanes = lanes.unionByName(spe_rows.select("mapping_id", "ip", F.lit(1).alias("lane")))
    addresses = lanes.groupBy("mapping_id", "ip").agg(F.min("lane").alias("lane"))
    addresses = held.written(addresses, "addresses") if profile.spe is not None else addresses
    resolved = resolve.address_lines(addresses, profile.maps, profile.matches, profile.line_table)
    placed = addresses.join(resolved, ["mapping_id", "ip"]) if profile.spe is not None else resolved.withColumn("lane", F.lit(0))
    return Placed(by_address, held.written(placed, "placed"), spe_rows, base)


def line_facts(profile: Profile, placed: Placed, held: Scratch) -> DataFrame:
    """What is known of sampled lines, of both lanes, as one long table; all but the latencies.

    Counters and ids are written by line, so that the shuffles of one are gone before those of the next.
    """
    facts = [held.written(lines.counters_by_line(placed.by_address, placed.addresses), "counters"), lines.name_facts(placed.addresses)]
    ids = counters.ids_by_address(profile.samples, distinct=False)
    if profile.spe is not None:
        # The lanes share most addresses: they are told apart together.
        ids = ids.unionByName(sampling.ids_by_address(profile.spe, distinct=False))
        outcome = lines.spe_line_values(lines.spe_counters_by_line(placed.spe_by_address, placed.addresses))
        facts.append(lines.outcome_facts(outcome))
    else:
        facts.append(lines.no_outcome_facts(placed.addresses))
    seen = lines.at_lines(ids.distinct(), placed.addresses).select(*lines.LINE, "cpu", "tid").distinct()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*facts, held.written(seen, "seen")])


def line_rows(profile: Profile, plan: lines.CounterPlan) -> DataFrame:
    """Finished line rows: every source line, and every sampled line outside the source text.

    What is written on the way is deleted as soon as no later step reads it; the rows
    read two narrow tables, of the sampled lines and of their statistics, and the source.
    """
    held, entries = Scratch(profile.samples.sparkSession, "lines"), {}
    placed = place(profile, held)
    sampled = held.written(lines.collected(line_facts(profile, placed, held)), "sampled")
    held.drop("by_address", "spe_by_address", "addresses", "counters", "seen")
    if profile.spe is not None:
        shown = {d: m for d, m in MAPS.items() if d != "category" or plan.spe_available}
        freq = lines.frequency_by_dimension(placed.spe_base, placed.addresses, list(shown))
        statistics = held.written(lines.statistics_by_line(freq), "statistics")
    held.drop("frequency", "placed")
    counted = held.written(lines.with_copies(sampled, profile.source), "counted")
    held.drop("sampled")
    rows = lines.percentages(counted, F.col("copies"))
    if profile.spe is not None:
        totals = lines.dimension_totals(statistics)
        rows = rows.join(statistics, lines.LINE, "left").withColumn("totals", totals)
        entries = {m: lines.metric_entries(F.col("statistics"), d, F.col("totals")[d], plan.baseline) for d, m in shown.items()}
        if plan.spe_available:
            entries["spe_values"] = lines.joined_entries(F.col("outcome"), entries["spe_values"])
    return lines.finish(lines.with_source(rows, profile.source), plan, entries)

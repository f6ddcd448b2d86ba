"""Counter samples by address: self and accumulated weights, totals, id sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaprof.functions.names import UNKNOWN_EVENT

ADDRESS = ["mapping_id", "ip"]


#: Catalog entries up to which event keys are looked up in a literal map.
MAP_ENTRIES = 4096


def with_event_key(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Event ordinal to event key; ordinals outside the catalog are unknown.

    A catalog has one entry per configured event, so it is read into a literal map
    and the samples are neither joined nor shuffled by their few ordinals; a
    larger one than ``MAP_ENTRIES`` is joined.
    """
    keys = catalog.select(F.col("ordinal").cast("bigint").alias("event_key_ref"), "event_key")
    found = keys.filter("event_key_ref is not null and event_key is not null").limit(MAP_ENTRIES + 1).collect()
    if len(found) <= MAP_ENTRIES and len({r["event_key_ref"] for r in found}) == len(found):
        known = F.create_map(*[F.lit(x) for r in found for x in (int(r["event_key_ref"]), r["event_key"])]) if found else None
        key = F.lit(None).cast("string") if known is None else F.try_element_at(known, F.col("event_key_ref").cast("bigint"))
        return samples.withColumn("event_key", F.coalesce(key, F.lit(UNKNOWN_EVENT)))
    return samples.join(keys, "event_key_ref", "left").withColumn(
        "event_key", F.coalesce("event_key", F.lit(UNKNOWN_EVENT)))


def address_hits(samples: DataFrame) -> DataFrame:
    """One row per touched address: the sampled one, and every caller under the same mapping id."""
    ips = F.concat(F.array(F.col("ip")), F.col("callchain"))
    return samples.select(
        "mapping_id", F.posexplode_outer(ips).alias("_pos", "ip"), "event_key", "cpu", "tid", "period")


def by_address(samples: DataFrame) -> DataFrame:
    """Long form ``(mapping_id, ip, event_key)`` with self/accumulated weights and samples."""
    own = F.col("_pos") == 0
    return address_hits(samples).groupBy(*ADDRESS, "event_key").agg(
        F.sum(F.when(own, F.col("period")).otherwise(0)).alias("self_weight"),
        F.sum(F.when(own, 1).otherwise(0)).alias("self_samples"),
        F.sum(F.when(own, 0).otherwise(F.col("period"))).alias("acc_weight"),
        F.sum(F.when(own, 0).otherwise(1)).alias("acc_samples"),
    )


def ids_by_address(samples: DataFrame, distinct: bool = True) -> DataFrame:
    """``(mapping_id, ip, cpu, tid)`` seen together; the sets of an address derive from it. Not ``distinct`` for one that takes in more lanes."""
    ids = address_hits(samples).select(*ADDRESS, "cpu", "tid")
    return ids.distinct() if distinct else ids


def totals(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: sample count, observed cpus, observed known event keys."""
    known = with_event_key(samples, catalog)
    seen = F.when(F.col("event_key") != UNKNOWN_EVENT, F.col("event_key"))
    return known.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.array_sort(F.collect_set("cpu")).alias("cpus"),
        F.array_sort(F.collect_set(seen)).alias("event_keys"),
    )

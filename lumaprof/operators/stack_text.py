"""Call stack tables of counter samples: frames by address and whole stacks by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaprof.functions import metric_value as M
from lumaprof.functions.address import frame_label
from lumaprof.functions.text import id_list_text, weights_text
from lumaprof.operators.counters import address_hits
from lumaprof.operators.resolve import to_named_module
from lumaprof.operators.reuse import cut


def _ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "cpu", "tid").distinct().groupBy(*keys).agg(
        id_list_text(F.collect_set("cpu")).alias("cpu"), id_list_text(F.collect_set("tid")).alias("thread"))


def frames(samples: DataFrame, maps: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per (role, ip) with weights, shares, ids and symbol status."""
    role = F.when(F.col("_pos") == 0, F.lit("self")).otherwise(F.lit("callchain"))
    hits = address_hits(samples).withColumn("role", role)
    own = F.col("role") == "self"
    by_event = hits.groupBy("role", "ip", "event_key").agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("period").alias("_w"))
    sums = cut(by_event.groupBy("role", "ip").agg(
        F.sum("sample_count").alias("sample_count"),
        F.sum(F.when(own, F.col("_w")).otherwise(0)).alias("self_weight"),
        F.sum(F.when(own, 0).otherwise(F.col("_w"))).alias("accumulated_weight"),
        weights_text(F.map_from_entries(F.collect_list(F.struct("event_key", "_w")))).alias("event_weights")))
    total = sums.agg(F.struct(F.sum("self_weight").alias("s"), F.sum("accumulated_weight").alias("a"))).scalar()
    named = to_named_module(sums, maps, symbols)
    return (
        sums.join(_ids(hits, ["role", "ip"]), ["role", "ip"]).join(named, "ip").withColumn("_t", total)
        .select(
            "role", "module", "function", "ip", "relative_address", "mapping_id", "cpu", "thread", "sample_count",
            F.col("self_weight").cast("double"), F.col("accumulated_weight").cast("double"),
            M.percent(F.col("self_weight"), F.col("_t.s")).alias("p_pct"),
            M.percent(F.col("accumulated_weight"), F.col("_t.a")).alias("acc_p_pct"), "event_weights",
            F.when(F.col("function") == "", F.lit("UnresolvedSymbol")).otherwise(F.lit("Symbol")).alias("status")))


def frame_order() -> list[Column]:
    keys = ["role", "module", "function", "ip", "relative_address", "mapping_id"]
    return [F.desc("self_weight"), F.desc("accumulated_weight"), *[F.asc(k) for k in keys]]


def stack_key(ips: Column) -> Column:
    """16 bytes that stand for a whole stack of addresses in shuffles and joins."""
    return F.struct(F.xxhash64(ips).alias("a"), F.xxhash64(ips, F.lit("b")).alias("b"))


def label_dictionary(ips: DataFrame, maps: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(ip, label, label_id)`` of each distinct address; the id is 16 bytes and equal for equal labels."""
    named = to_named_module(ips, maps, symbols).select(
        "ip", frame_label(F.col("module"), F.col("function"), F.col("relative_address")).alias("label"))
    return named.withColumn("label_id", stack_key(F.col("label")))


def _in_order(item: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("_pos", item))), lambda e: e[item])


def chain_keys(stacks: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, chain)``: stacks of addresses under 16 bytes over their sequence of label ids."""
    exploded = stacks.select("key", F.posexplode("ips").alias("_pos", "ip"))
    return exploded.join(labels.select("ip", "label_id"), "ip").groupBy("key").agg(stack_key(_in_order("label_id")).alias("chain"))


def chain_texts(stacks: DataFrame, chains: DataFrame, labels: DataFrame) -> DataFrame:
    """Text, leaf and root of each chain, written out once from one of its stacks (leaf first)."""
    one = chains.groupBy("chain").agg(F.min("key").alias("key"))
    exploded = stacks.join(one, "key").select("chain", F.posexplode("ips").alias("_pos", "ip"))
    return exploded.join(labels.select("ip", "label"), "ip").groupBy("chain").agg(_in_order("label").alias("labels")).select(
        "chain", F.array_join("labels", " <- ").alias("stack"),
        F.element_at("labels", 1).alias("leaf"), F.element_at("labels", -1).alias("root"))


def callchains(samples: DataFrame, maps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Whole stacks by their labels. Sums and ids are taken under keys; texts meet the finished rows."""
    ips = F.concat(F.array("ip"), F.col("callchain"))
    raw = samples.select(stack_key(ips).alias("key"), ips.alias("ips"), "event_key", "cpu", "tid", "period")
    # Distinct by hash first: an array is aggregated by sorting, which is for stacks and not for samples.
    stacks = cut(raw.groupBy("key", "ips").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("ips", "n").alias("ips")))
    labels = cut(label_dictionary(stacks.select(F.explode("ips").alias("ip")).distinct(), maps, symbols))
    chains = cut(chain_keys(stacks, labels))
    by_event = raw.groupBy("key", "event_key").agg(F.count(F.lit(1)).alias("n"), F.sum("period").alias("w"))
    labelled = by_event.join(chains, "key").groupBy("chain", "event_key").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    rows = cut(labelled.groupBy("chain").agg(
        F.sum("n").alias("sample_count"), F.sum("w").cast("double").alias("weight"),
        weights_text(F.map_from_entries(F.collect_list(F.struct("event_key", "w")))).alias("event_weights")))
    ids = raw.select("key", "cpu", "tid").distinct().join(chains, "key")
    total = rows.agg(F.sum("weight")).scalar()
    return (rows.join(_ids(ids, ["chain"]), "chain").join(chain_texts(stacks, chains, labels), "chain").drop("chain")
            .withColumn("p_pct", M.percent(F.col("weight"), total)))


def callchain_order() -> list[Column]:
    return [F.desc("weight"), F.asc("stack")]

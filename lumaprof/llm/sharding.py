"""Sharding by a hierarchical weighted hash tree.

A document descends from the root over region and rack to a shard. At every level
each child draws a number from the document's key and the child's own name,
scaled by the weight of the shards below it, and the lowest draw wins (weighted
rendezvous). A change of weights therefore moves documents only into or out of the
subtrees whose weights change. Growing a cluster adds a region of its own, so
documents move only into the new shard.

Slots number the rows of a shard without gaps, in order of key, size and content;
rows are cut into ranges of that order, numbered inside each range, and the counts
of the ranges are added up, so no window holds a whole shard.

Null texts have no bytes and a size of one. Null keys are hashed as the empty text;
repeated rows go to the same shard, each with a slot of its own. Of a text, however
long, only size and checksum are moved. An empty table
gives no row. Only the key and the text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.llm.common import text_bytes, written

#: Region name -> rack name -> shard number -> weight.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Rows that one range of a numbering should hold.
RANGE_ROWS = 1_000_000


def standard_tree(shards: int, base: int = 8) -> dict:
    """Two regions of two racks for the first ``base`` shards; every further shard is a region of its own.

    Hence one more shard beyond ``base`` takes rows only into itself.
    """
    tree: dict = {}
    for shard in range(min(shards, base)):
        tree.setdefault(f"region{shard * 2 // base}", {}).setdefault(f"rack{shard * 4 // base}", {})[shard] = 1.0
    for shard in range(base, shards):
        tree[f"region-of-{shard}"] = {f"rack-of-{shard}": {shard: 1.0}}
    return tree


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of rate ``weight``: the lowest of several is each one's in proportion to its weight."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(2.0 ** 53)
    return -F.log(unit) / F.lit(float(weight))


def _pick(choices: list[tuple[Column, Column]]) -> Column:
    """The value whose draw is lowest."""
    if len(choices) == 1:
        return choices[0][1]
    return F.array_min(F.array(*[F.struct(draw.alias("d"), value.alias("v")) for draw, value in choices]))["v"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key; subtrees without weight get nothing."""
    def total(node) -> float:
        return sum(map(total, node.values())) if isinstance(node, Mapping) else float(node)

    def descend(node, path: str) -> Column:
        live = [(name, child) for name, child in node.items() if total(child) > 0]
        if not live:
            raise ValueError("the tree has no shard with a weight")
        if not isinstance(live[0][1], Mapping):
            return _pick([(_draw(key, f"{path}/{name}", child), F.lit(int(name))) for name, child in live])
        if len(live) == 1:
            return descend(live[0][1], f"{path}/{live[0][0]}")
        winner = _pick([(_draw(key, f"{path}/{name}", total(child)), F.lit(n)) for n, (name, child) in enumerate(live)])
        chosen = None
        for n, (name, child) in enumerate(live):
            below = descend(child, f"{path}/{name}")
            chosen = F.when(winner == n, below) if chosen is None else chosen.when(winner == n, below)
        return chosen

    return descend(tree, "")


def numbered(rows: DataFrame, group: str, order: list[str], slot: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds gapless numbers from 0 within each ``group`` in the given order, by ranges of the order.

    A salt breaks ties, so many equal rows are many ranges too. ``group`` must have few values.
    """
    salted = written(rows.withColumn("_salt", F.monotonically_increasing_id()), "unnumbered")
    total = salted.count()
    ranges = max(1, -(-total // range_rows), min(total // 1000, rows.sparkSession.sparkContext.defaultParallelism))
    keys = [*order, "_salt"]
    dealt = written(salted.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and range, a millionth of the rows.
    offsets = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*keys))
    return (dealt.withColumn("_inside", inside).join(offsets, [group, "_range"])
            .withColumn(slot, F.col("_before") + F.col("_inside") - 1).drop("_salt", "_range", "_before", "_inside"))


def sharded(docs: DataFrame, shards: int = 8, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """Size, checksum, shard and slot of every document, and its shard in the grown tree."""
    text = text_bytes("text")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(key, tree or standard_tree(shards)).alias("shard"),
        shard_of(key, grown or standard_tree(shards + 1)).alias("grown_shard"))
    return numbered(rows, "shard", ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

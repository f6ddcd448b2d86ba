"""Pre-order numbers of tree nodes, so that a subtree is a range and a nested document an ordered stream.

Both sums over a tree are taken by pointer doubling: in each round every node
knows what lies within 2^k steps and who lies 2^k steps above, so a tree of depth
d takes log2(d) rounds of joins over one row per node. No path is exploded into
its ancestors and no node is gathered with its descendants.

The rounds move numbers only: nodes are numbered once, and keys, names and weights
wait in one table until the sums are known. A round's table is deleted after the
next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.operators.reuse import Scratch


def _rounds(nodes: DataFrame) -> int:
    """How often a step must double to reach from the deepest node past a root (depth 1)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 1
    return (deepest - 1).bit_length()


def _named(keys: Sequence[str], node: str) -> list[Column]:
    """A node of a tree as 128 bits; null where a key is, as such nodes are nobody's parent."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return [F.when(known, F.xxhash64(*salt, *keys, node)).alias(name) for name, salt in (("_pa", []), ("_pb", [F.lit("b")]))]


def _numbered(tree: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.written(tree.withColumn("_id", F.monotonically_increasing_id()), "nodes")


def _with_parents(nodes: DataFrame, keys: Sequence[str], *payload: str) -> DataFrame:
    """(_id, up, _pa, _pb, payload): every node with the number of its parent, null for roots."""
    parents = nodes.filter("node is not null").select(*_named(keys, "node"), F.col("_id").alias("_up"))
    children = nodes.select("_id", "depth", *_named(keys, "parent"), *payload)
    up = F.when(F.col("depth") > 1, F.col("_up"))
    return children.join(parents.filter("_pa is not null"), ["_pa", "_pb"], "left").select("_id", up.alias("up"), "_pa", "_pb", *payload)


def _jumped(state: DataFrame, *values: str) -> DataFrame:
    """The nodes that still jump, with the values of the node their jump leads to, as ``_`` and their name."""
    above = state.select(F.col("_id").alias("jump"), *[F.col(v).alias(f"_{v}") for v in values])
    return state.filter("jump is not null").join(above, "jump", "left")


def _sizes(edges: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """(_id, size) from (_id, up)."""
    state = edges.select("_id", F.col("up").alias("jump"), F.lit(1).cast("bigint").alias("size"))
    for k in range(rounds):
        # A node within 2^(k+1) steps below is within 2^k steps of one that jumps here, or within 2^k itself.
        below = state.filter("jump is not null").groupBy(F.col("jump").alias("_id")).agg(F.sum("size").alias("_below"))
        moved = state.withColumn("jump", F.lit(None).cast("bigint"))
        if k < rounds - 1:
            ahead = state.withColumn("next", F.col("jump"))
            moved = moved.filter(state["jump"].isNull()).unionByName(_jumped(ahead, "next").select("_id", F.col("_next").alias("jump"), "size"))
        grown = moved.join(below, "_id", "left").select("_id", "jump", (F.col("size") + F.coalesce("_below", F.lit(0))).alias("size"))
        state = scratch.written(grown, f"sizes-{k}")
        if k:
            scratch.drop(f"sizes-{k - 1}")
    return state.select("_id", "size")


def _sums(edges: DataFrame, rounds: int, value: str, scratch: Scratch) -> DataFrame:
    """(_id, sum) from (_id, up, ``value``)."""
    state = edges.select("_id", F.col("up").alias("jump"), F.col(value).alias("sum"))
    for k in range(rounds):
        whole = F.when(F.col("_sum").isNull(), F.col("sum")).otherwise(F.col("sum") + F.col("_sum"))
        # ``next`` is the jump under a name of its own, as the joined one is taken up by the key.
        moved = _jumped(state.withColumn("next", F.col("jump")), "next", "sum").select("_id", F.col("_next").alias("jump"), whole.alias("sum"))
        state = scratch.written(state.filter("jump is null").unionByName(moved), f"sums-{k}")
        if k:
            scratch.drop(f"sums-{k - 1}")
    return state.select("_id", "sum")


def subtree_sizes(tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, size): nodes of each subtree, its root included. Needs ``node``, ``parent`` and ``depth`` from 1."""
    scratch = Scratch(tree.sparkSession, "subtree-sizes")
    nodes = _numbered(tree.select(*keys, "node", "parent", "depth"), scratch)
    edges = scratch.written(_with_parents(nodes, keys).select("_id", "up"), "edges")
    return nodes.join(_sizes(edges, _rounds(nodes), scratch), "_id").select(*keys, "node", "size")


def path_sums(tree: DataFrame, keys: Sequence[str], value: str, total: str) -> DataFrame:
    """(keys, node, ``total``): the sum of ``value`` over a node and all its ancestors. Needs columns as ``subtree_sizes``."""
    scratch = Scratch(tree.sparkSession, "path-sums")
    nodes = _numbered(tree.select(*keys, "node", "parent", "depth", F.col(value).alias("_value")), scratch)
    edges = scratch.written(_with_parents(nodes, keys, "_value").select("_id", "up", "_value"), "edges")
    sums = _sums(edges, _rounds(nodes), "_value", scratch)
    return nodes.join(sums, "_id").select(*keys, "node", F.col("sum").alias(total))


def preorder(tree: DataFrame, keys: Sequence[str], order: Sequence[str] = ("name", "func")) -> DataFrame:
    """The tree with ``sibling`` (from 1), ``entry`` (pre-order number, from 1) and ``exit`` (the last number below).

    ``b`` lies below ``a`` if and only if ``a.entry < b.entry <= a.exit``. Nodes
    with a null key belong to no tree and are left out.
    """
    keys, scratch = list(keys), Scratch(tree.sparkSession, "preorder")
    nodes = _numbered(tree.dropna(subset=keys).filter("node is not null"), scratch)
    rounds = _rounds(nodes)
    # The families are where the parents were joined: their members are ranked there, and later told by one number.
    members = Window.partitionBy("_pa", "_pb").orderBy(*order)
    ranked = _with_parents(nodes, keys, *order).select(
        "_id", "up", F.row_number().over(members).alias("sibling"),
        F.coalesce("up", -1 - F.first("_id").over(members.rowsBetween(Window.unboundedPreceding, 0))).alias("family"))
    edges = scratch.written(ranked, "edges")
    sizes = _sizes(edges, rounds, scratch)
    earlier = Window.partitionBy("family").orderBy("sibling").rowsBetween(Window.unboundedPreceding, -1)
    steps = scratch.written(edges.join(sizes, "_id").select(
        "_id", "up", "sibling", "size", (1 + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("step")), "steps")
    scratch.drop("edges", *([f"sizes-{rounds - 1}"] if rounds else []))
    entries = _sums(steps, rounds, "step", scratch).withColumnRenamed("sum", "entry")
    rest = [c for c in tree.columns if c not in (*keys, "node")]
    ordered = scratch.written(
        nodes.join(steps.select("_id", "sibling", "size"), "_id").join(entries, "_id").select(
            *keys, "node", *rest, "sibling", "entry", (F.col("entry") + F.col("size") - 1).alias("exit")), "ordered")
    scratch.drop("nodes", "steps", *([f"sums-{rounds - 1}"] if rounds else []))
    return ordered

"""Flame graph layout: same-name merging, pruning by width, positions and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.operators.callstacks import THREAD, node_rows, rolled_stacks
from lumaprof.operators.reuse import cut as reused
from lumaprof.operators.tree_order import path_sums


def calls_below(stacks: DataFrame, func: Column, reverse: bool = False) -> DataFrame:
    """Stacks cut to the part from the topmost occurrence of a function on.

    Forward that is what the function calls, and on the reverse tree what
    calls it. The result is a stack table again, for ``call_tree`` or ``flame``.
    """
    walk = F.col("calls") if reverse else F.reverse("calls")
    at = F.array_position(F.transform(walk, lambda c: c["func"]), func)
    # Position 0 means absent; such stacks are filtered out, but may be evaluated first.
    cut = F.slice(walk, F.greatest(at.cast("int"), F.lit(1)), F.size(walk))
    return stacks.filter(F.exists("calls", lambda c: c["func"] == func)).withColumn(
        "calls", cut if reverse else F.reverse(cut))


def _with_paths(groups: DataFrame, stacks: DataFrame, keys: Sequence[str], reverse: bool) -> DataFrame:
    """Groups with the node and name-node paths of their representative stack.

    Only representative stacks are rolled again. ``rep`` is a hash, so the
    path is checked to lead through the group's own name node.
    """
    wanted = groups.select(*keys, "rep").distinct()
    chosen = stacks.select(*keys, "calls", F.xxhash64("calls").alias("rep")).join(wanted, [*keys, "rep"], "left_semi").distinct()
    paths = rolled_stacks(chosen, reverse, named=True).select(
        *keys, "rep", F.col("_nodes.node").alias("path"), F.col("_nodes.name_node").alias("name_path"))
    return groups.join(paths, [*keys, "rep"]).filter(F.get("name_path", F.col("depth") - 1) == F.col("name_node"))


def flame(stacks: DataFrame, min_width_pct: float, keys: Sequence[str] = tuple(THREAD), reverse: bool = False) -> DataFrame:
    """Kept boxes with depth (from 0), width and x in percent; a ``min_width_pct`` of 0 keeps all.

    Equal names merge among the roots and under a merged box, but not under a
    box of one node. A box narrower than the minimum goes with its subtree and
    takes no room, so at most ``100 / minimum`` boxes remain per graph and
    depth and every step after the first aggregation works on those.
    """
    keys = list(keys)
    nodes = reused(node_rows(stacks, keys, reverse, named=True).groupBy(*keys, "node", "name_node", "depth", "func", "name").agg(
        F.sum("weight").alias("subtree"), F.min("_stack").alias("rep")))

    # Groups of one name path that are wide enough to show, each with one stack that runs through it.
    groups = nodes.groupBy(*keys, "name_node", "depth").agg(
        F.sum("subtree").alias("subtree"), F.count(F.lit(1)).alias("nodes"), F.min("rep").alias("rep"))
    total = groups.filter("depth = 1").groupBy(*keys).agg(F.sum("subtree").alias("total"))
    shown = reused(groups.join(total, keys).filter(F.col("subtree") * 100.0 / F.col("total") >= min_width_pct))

    # Merging stops at the first depth of the path that holds a single node.
    name_path = _with_paths(shown, stacks, keys, reverse).select(
        *keys, "name_node", F.explode(F.slice("name_path", F.lit(1), F.col("depth"))).alias("_ancestor"))
    single = shown.select(*keys, F.col("name_node").alias("_ancestor"),
                          F.when(F.col("nodes") == 1, F.col("depth")).alias("_single"))
    stops = name_path.join(single, [*keys, "_ancestor"]).groupBy(*keys, "name_node").agg(F.min("_single").alias("_stop"))
    merged = shown.select(*keys, "name_node", "total").join(stops, [*keys, "name_node"])

    # Merged boxes are named by their name path, boxes below a single node by their own path.
    stop = F.coalesce("_stop", "depth")
    boxes = (
        nodes.join(merged, [*keys, "name_node"]).withColumn("_stop", stop)
        .withColumn("box", F.when(F.col("depth") > F.col("_stop"), F.col("node")).otherwise(F.col("name_node")))
        .groupBy(*keys, "box", "depth", "name", "total", "_stop").agg(
            F.sum("subtree").alias("subtree"), F.min("func").alias("func"), F.min("rep").alias("rep"), F.min("name_node.a").alias("_a"), F.min("name_node.b").alias("_b"))
        .withColumn("name_node", F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))))
    kept = reused(boxes.withColumn("width", F.col("subtree") * 100.0 / F.col("total")).filter(
        F.col("width") >= min_width_pct))
    upper = F.least("_stop", "depth")
    chain = F.concat(F.slice("name_path", F.lit(1), upper), F.slice("path", upper + 1, F.col("depth") - upper))
    kept = _with_paths(kept, stacks, keys, reverse).withColumn(
        "parent_box", F.when(F.col("depth") > 1, F.get(chain, F.col("depth") - 2)))

    earlier = Window.partitionBy(*keys, "parent_box").orderBy("name", "func").rowsBetween(Window.unboundedPreceding, -1)
    kept = reused(kept.withColumn("offset", F.coalesce(F.sum("width").over(earlier), F.lit(0.0))))
    x = path_sums(kept.select(*keys, F.col("box").alias("node"), F.col("parent_box").alias("parent"), "depth", "offset"), keys, "offset", "x")
    return kept.join(x.withColumnRenamed("node", "box"), [*keys, "box"]).select(
        *keys, "box", "parent_box", (F.col("depth") - 1).alias("depth"), "func", "name", "subtree", "width", "x")


def max_depth(layout: DataFrame, keys: Sequence[str] = tuple(THREAD)) -> DataFrame:
    return layout.groupBy(*keys).agg((F.max("depth") + 1).alias("max_depth"))


def title(name: Column, library: Column, events: Column, weight: Column) -> Column:
    return F.concat(name, F.lit(" | "), library, F.lit(" ("), events.cast("string"), F.lit(" events: "), weight, F.lit(")"))


def highlight(layout: DataFrame, text: str, term: str) -> DataFrame:
    return layout.withColumn("hit", F.col(text).contains(term))


def _rgb(red: Column, green: Column, blue: Column) -> Column:
    return F.struct(*[F.floor(c).cast("int").alias(n) for n, c in (("r", red), ("g", green), ("b", blue))])


def heat_color(width: Column) -> Column:
    cool = 1 - width * 0.01
    return _rgb(245 + 10 * cool, 110 + 105 * cool, F.lit(100))


def stability_color(cv: Column, max_cv: Column) -> Column:
    """Grey-blue for stable, towards red for the least stable function."""
    share = F.least(F.lit(1.0), F.try_divide(cv, max_cv))
    unstable = (max_cv > 0) & (cv > 0)
    return F.when(unstable, _rgb(200 + 20 * share, 210 - 150 * share, 230 - 170 * share)).otherwise(
        _rgb(F.lit(200), F.lit(210), F.lit(230)))

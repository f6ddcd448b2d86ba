"""Callstack profile: roll-ups, dictionaries, call trees, merging and pruning.

Raw samples are reduced to distinct stacks per thread first (``stack_table``);
function tables and trees are built from those, so the per-frame explode runs
over distinct stacks and not over samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.operators.lookup import dense_ids

THREAD = ["event", "pid", "tid"]
FUNCTION = ["lib", "symbol"]


def _cut(depth_limit: int | None) -> Column:
    return F.col("frames") if depth_limit is None else F.slice("frames", 1, depth_limit)


def stack_table(samples: DataFrame, depth_limit: int | None = None) -> DataFrame:
    """Distinct ``frames`` (leaf first) per thread, with weight and samples.

    With a ``depth_limit`` only so many frames from the leaf on are kept;
    ``cut_stacks`` counts what that touches.
    """
    return samples.groupBy(*THREAD, _cut(depth_limit).alias("frames")).agg(
        F.sum("period").alias("weight"), F.count(F.lit(1)).alias("samples"))


def cut_stacks(samples: DataFrame, depth_limit: int) -> DataFrame:
    """Per thread, samples whose stack a ``depth_limit`` cuts, and the frames they lose."""
    over = F.size("frames") - depth_limit
    return samples.groupBy(*THREAD).agg(
        F.count_if(over > 0).alias("cut_samples"), F.sum(F.greatest(over, F.lit(0))).alias("lost_frames"))


def rollup(samples: DataFrame) -> DataFrame:
    """Counts at three levels: event, process (tid null) and thread."""
    e, p, t = F.col("event"), F.col("pid"), F.col("tid")
    return samples.groupingSets([[e], [e, p], [e, p, t]], e, p, t).agg(
        F.sum("period").alias("event_count"), F.count(F.lit(1)).alias("sample_count"),
        F.grouping_id().alias("_g")).withColumn(
        "level", F.when(F.col("_g") == 3, F.lit("event")).when(F.col("_g") == 1, F.lit("process")).otherwise(F.lit("thread"))
    ).drop("_g")


def _seen_order() -> Column:
    # Ties in time are broken by the name itself, so the choice is stable.
    return F.struct("time", "comm")


def thread_names(samples: DataFrame) -> DataFrame:
    """Last seen name of each thread; samples are reduced to the last time of each name, by hash, before names are compared."""
    seen = samples.groupBy(*THREAD, "comm").agg(F.max("time").alias("time"))
    return seen.groupBy(*THREAD).agg(F.max_by("comm", _seen_order()).alias("thread_name"))


def process_names(threads: DataFrame) -> DataFrame:
    """Name of the process's main thread, '' when that thread has no sample."""
    main = F.when(F.col("tid") == F.col("pid"), F.col("thread_name"))
    return threads.groupBy("event", "pid").agg(F.coalesce(F.max(main), F.lit("")).alias("process_name"))


def named_rollup(samples: DataFrame) -> DataFrame:
    threads = thread_names(samples)
    counts = rollup(samples)
    return (
        counts.join(threads, THREAD, "left").join(process_names(threads), ["event", "pid"], "left")
        .select("level", *THREAD, "event_count", "sample_count",
                F.when(F.col("level") == "thread", F.col("thread_name"))
                .when(F.col("level") == "process", F.col("process_name")).alias("name")))


def _frame_rows(samples: DataFrame, depth_limit: int | None) -> DataFrame:
    """Frames of each distinct stack at its first time; a null time is the first of all."""
    first = F.when(~F.bool_or(F.col("time").isNull()), F.min("time"))
    stacks = samples.groupBy(_cut(depth_limit).alias("_frames")).agg(first.alias("time"))
    return stacks.select("time", F.posexplode("_frames").alias("_pos", "f")).select("time", "_pos", "f.*")


def dictionaries(samples: DataFrame, depth_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Libraries and functions with dense ids in first-seen order and their first seen address.

    The dense ids are for export; ``exported`` puts them on rows that name functions by hash.
    """
    rows = _frame_rows(samples, depth_limit)
    seen = F.struct("time", "_pos", *FUNCTION)
    functions = rows.groupBy(*FUNCTION).agg(
        F.min(seen).alias("_s"), F.min_by(F.struct("addr", "len"), seen).alias("_a")).select(
        *FUNCTION, F.col("_s.time").alias("_time"), F.col("_s._pos").alias("_pos"), "_a.addr", "_a.len")
    libs = functions.groupBy("lib").agg(F.min(F.struct("_time", "_pos")).alias("_s")).select(
        "lib", F.col("_s._time").alias("_time"), F.col("_s._pos").alias("_pos"))
    order = ["_time", "_pos", "lib"]
    lib_ids = dense_ids(libs, order, "lib_id").select("lib_id", "lib")
    func_ids = dense_ids(functions, [*order, "symbol"], "func_id")
    return lib_ids, func_ids.join(lib_ids, "lib").select("func_id", "lib_id", *FUNCTION, "addr", "len")


def library_hash(lib: Column) -> Column:
    return F.xxhash64(lib)


def function_hash(lib: Column, symbol: Column) -> Column:
    return F.xxhash64(lib, symbol)


def encode(stacks: DataFrame) -> DataFrame:
    """Stacks with ``calls``: ``array<struct<func, lib, name>>`` in place of symbols.

    ``func`` and ``lib`` are hashes of the names, so a stack is encoded where it
    lies: no dictionary is joined and no frame is exploded.
    """
    calls = F.transform("frames", lambda f: F.struct(
        function_hash(f["lib"], f["symbol"]).alias("func"), library_hash(f["lib"]).alias("lib"), f["symbol"].alias("name")))
    return stacks.withColumn("calls", calls).drop("frames")


def exported(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows with a hashed ``func``, under the dense ids of the function dictionary."""
    ids = functions.select(function_hash(F.col("lib"), F.col("symbol")).alias("func"), "func_id", "lib_id")
    return rows.join(ids, "func").drop("func")


def function_rows(stacks: DataFrame, keys: Sequence[str] = tuple(THREAD)) -> DataFrame:
    """Per thread and function: leaf samples and weight, and the weight of stacks holding it (once each)."""
    leaf = F.element_at("calls", 1)["func"]
    distinct = F.array_distinct("calls")
    rows = stacks.select(*keys, "weight", "samples", leaf.alias("_leaf"), F.explode_outer(distinct).alias("c"))
    own = F.col("c.func") == F.col("_leaf")
    return rows.groupBy(*keys, F.col("c.lib").alias("lib"), F.col("c.func").alias("func"), F.col("c.name").alias("name")).agg(
        F.sum(F.when(own, F.col("samples")).otherwise(0)).alias("sample_count"),
        F.sum(F.when(own, F.col("weight")).otherwise(0)).alias("self"),
        F.sum("weight").alias("subtree"))


def library_rows(functions: DataFrame, keys: Sequence[str] = tuple(THREAD)) -> DataFrame:
    """Leaf weight per library; libraries seen only as callers stay with 0."""
    return functions.groupBy(*keys, "lib").agg(F.sum("self").alias("self"))


NODE = "struct<a:bigint,b:bigint>"


#: Calls that one inner step of a roll gathers; the outer step then appends whole runs.
_RUN = 64


def _roll(calls: Column, named: bool) -> Column:
    """Nodes of one path from the root on; a node is the pair of rolling hashes of its prefix.

    Two independent 64-bit hashes make an accidental merge of two prefixes
    practically impossible, and keep a node at 16 bytes whatever its depth.
    ``named`` also rolls the function names, for same-name merging. The path is
    rolled in runs, so the nodes found so far are not copied at every call.
    """
    zero = F.lit(0).cast("bigint")

    def key(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    row_type = f"struct<depth:int,func:bigint,name:string,node:{NODE},parent:{NODE}" + (f",name_node:{NODE}>" if named else ">")
    rolled = ["node", "name_node"] if named else ["node"]

    def state(hashes: list[Column], depth: Column, nodes: Column) -> Column:
        return F.struct(*[h.alias(r) for h, r in zip(hashes, rolled)], depth.alias("depth"), nodes.alias("nodes"))

    def step(acc: Column, call: Column) -> Column:
        grown = [key(F.xxhash64(acc[r]["a"], call[item]), F.xxhash64(acc[r]["b"], call[item], F.lit("b"))).alias(r)
                 for r, item in zip(rolled, ("func", "name"))]
        row = F.struct((acc["depth"] + 1).alias("depth"), call["func"].alias("func"), call["name"].alias("name"),
                       grown[0], acc["node"].alias("parent"), *grown[1:])
        return state(grown, acc["depth"] + 1, F.concat(acc["nodes"], F.array(row)))

    def run(acc: Column, part: Column) -> Column:
        start = state([acc[r] for r in rolled], acc["depth"], F.array().cast(f"array<{row_type}>"))
        inner = F.aggregate(part, start, step)
        return state([inner[r] for r in rolled], inner["depth"], F.concat(acc["nodes"], F.array(inner["nodes"])))

    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(calls) - 1, F.lit(0)), F.lit(_RUN)),
                       lambda at: F.slice(calls, at + 1, F.lit(_RUN)))
    begin = state([key(zero, zero) for _ in rolled], F.lit(0), F.array().cast(f"array<array<{row_type}>>"))
    return F.aggregate(runs, begin, run, lambda acc: F.flatten(acc["nodes"]))


def rolled_stacks(stacks: DataFrame, reverse: bool, named: bool) -> DataFrame:
    calls = F.col("calls") if reverse else F.reverse("calls")
    return stacks.withColumn("_nodes", _roll(calls, named))


def node_rows(stacks: DataFrame, keys: Sequence[str], reverse: bool = False, named: bool = False) -> DataFrame:
    """One row per (stack, prefix); ``_stack`` is a hash of the whole stack.

    The outer explode keeps the optimizer from inferring a filter on the
    rolled array, which it would evaluate again on every raw sample.
    """
    rolled = rolled_stacks(stacks, reverse, named)
    return rolled.select(
        *keys, "weight", F.size("_nodes").alias("_size"), F.xxhash64("calls").alias("_stack"),
        F.explode_outer("_nodes").alias("n")).filter("n IS NOT NULL").select(
        *keys, "weight", "_stack", (F.col("n.depth") == F.col("_size")).alias("_last"), "n.*")


def call_tree(stacks: DataFrame, keys: Sequence[str] = tuple(THREAD), reverse: bool = False) -> DataFrame:
    """Prefix table of the forward (root to leaf) or reverse (leaf to root) tree.

    ``self`` is the weight of stacks ending at the node, ``subtree`` of all stacks through it.
    """
    rows = node_rows(stacks, keys, reverse)
    return rows.groupBy(*keys, "node", "parent", "depth", "func", "name").agg(
        F.sum(F.when(F.col("_last"), F.col("weight")).otherwise(0)).alias("self"),
        F.sum("weight").alias("subtree"))


def merge_keys(samples: DataFrame) -> DataFrame:
    """``(event, pid, tid)`` to its merged process and thread.

    Processes with one name become the smallest pid; only in those that had a
    name twin are threads of one name merged as well, into the smallest tid.
    """
    threads = thread_names(samples)
    processes = process_names(threads)
    twins = processes.groupBy("event", "process_name").agg(
        F.min("pid").alias("new_pid"), (F.count(F.lit(1)) > 1).alias("merged"))
    keyed = threads.join(processes, ["event", "pid"]).join(twins, ["event", "process_name"])
    same = keyed.filter("merged").groupBy("event", "new_pid", "thread_name").agg(F.min("tid").alias("_tid"))
    return keyed.join(same, ["event", "new_pid", "thread_name"], "left").select(
        *THREAD, "new_pid", F.coalesce("_tid", "tid").alias("new_tid"))


def rekey(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows under their merged process and thread ids; aggregate again afterwards."""
    return rows.join(keys, THREAD).drop("pid", "tid").withColumnsRenamed({"new_pid": "pid", "new_tid": "tid"})


def group_threads(samples: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Thread names replaced by the first pattern that matches the whole name."""
    name = F.col("comm")
    grouped = F.coalesce(*[F.when(name.rlike(f"^(?:{p})$"), F.lit(p)) for p in patterns], name)
    return samples.withColumn("comm", grouped)


def flat_table(functions: DataFrame, names: DataFrame, libs: DataFrame) -> DataFrame:
    """Total, self, samples with process, thread, library and function names."""
    return functions.join(names, THREAD).join(libs.withColumnsRenamed({"lib": "library", "lib_id": "lib"}), "lib").select(
        F.col("subtree").alias("total"), "self", F.col("sample_count").alias("samples"), "event",
        F.col("process_name").alias("process"), F.col("thread_name").alias("thread"), "library",
        F.col("name").alias("function"))


def shares(named: DataFrame, libraries: DataFrame, functions: DataFrame) -> DataFrame:
    """Share of each child in its parent: process, thread, library and function (by self weight)."""
    def level(name: str, rows: DataFrame, total: DataFrame, on: list[str], label: str, count: str) -> DataFrame:
        return rows.join(total, on).select(
            F.lit(name).alias("level"), "event", "pid", "tid", F.col(label).cast("string").alias("item"), F.col(count).alias("event_count"),
            (F.col(count) * 100.0 / F.nullif("_total", F.lit(0))).alias("share"))

    null = F.lit(None).cast("int")
    event = named.filter("level = 'event'").select("event", F.col("event_count").alias("_total"))
    process = named.filter("level = 'process'")
    thread = named.filter("level = 'thread'")
    process_total = process.select("event", "pid", F.col("event_count").alias("_total"))
    thread_total = thread.select(*THREAD, F.col("event_count").alias("_total"))
    lib_total = libraries.select(*THREAD, "lib", F.col("self").alias("_total"))
    return (
        level("process", process.withColumn("tid", null), event, ["event"], "pid", "event_count")
        .unionByName(level("thread", thread, process_total, ["event", "pid"], "tid", "event_count"))
        .unionByName(level("library", libraries, thread_total, THREAD, "lib", "self"))
        .unionByName(level("function", functions, lib_total, [*THREAD, "lib"], "func", "self")))


def prune(functions: DataFrame, trees: Sequence[DataFrame], counts: DataFrame, min_func_pct: float,
          min_chain_pct: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Threads below the event limit go, then functions below it, then tree nodes below the thread limit.

    Subtree weights only shrink along a path, so a per-node test also drops whole subtrees.
    """
    events = counts.filter("level = 'event'").select("event", F.col("event_count").alias("_event"))
    threads = counts.filter("level = 'thread'").select(*THREAD, F.col("event_count").alias("_thread"))
    limit = F.col("_event") * F.lit(min_func_pct) * 0.01
    kept = threads.join(events, "event").withColumn("_limit", limit).filter("_thread >= _limit")
    kept_functions = functions.join(kept, THREAD).filter("subtree >= _limit").select(*functions.columns)
    edge = F.lit(min_chain_pct) * 0.01 * F.col("_thread")
    kept_trees = [t.join(kept, THREAD).filter(F.col("subtree") >= edge).select(*t.columns) for t in trees]
    return kept.select(*THREAD), kept_functions, kept_trees


def trim_dictionary(dictionary: DataFrame, functions: DataFrame, trees: Sequence[DataFrame]) -> DataFrame:
    """Functions that a kept function row or tree node still names."""
    used = functions.select(F.col("func").alias("func_id"))
    for tree in trees:
        used = used.unionByName(tree.select(F.col("func").alias("func_id")))
    return dictionary.join(used.distinct(), "func_id", "left_semi")


def sibling_order(tree: DataFrame, keys: Sequence[str] = tuple(THREAD)) -> DataFrame:
    """Rank among siblings by function name, first-seen function first on equal names."""
    order = Window.partitionBy(*keys, "parent").orderBy("name", "func")
    return tree.withColumn("sibling", F.row_number().over(order))


def export_order(named: DataFrame) -> DataFrame:
    """Process rank by event count and thread rank by sample count, both descending, ids on ties."""
    process = named.filter("level = 'process'").select(
        "event", "pid", F.col("event_count").alias("process_count"),
        F.row_number().over(Window.partitionBy("event").orderBy(F.desc("event_count"), "pid")).alias("process_rank"))
    thread = named.filter("level = 'thread'").select(
        *THREAD, "event_count", "sample_count",
        F.row_number().over(Window.partitionBy("event", "pid").orderBy(F.desc("sample_count"), "tid")).alias("thread_rank"))
    return thread.join(process, ["event", "pid"])

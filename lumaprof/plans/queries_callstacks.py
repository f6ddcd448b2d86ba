"""Queries: callstack roll-ups, call trees, game frames and flame layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaprof.functions import text as X
from lumaprof.operators import callstacks as R
from lumaprof.operators import frames as G
from lumaprof.operators import layout
from lumaprof.operators import tree_order
from lumaprof.operators import views
from lumaprof.operators.reuse import cut
from lumaprof.plans.registry import query, rounded
from lumaprof.sinks import report
from lumaprof.sources.tables import callstack_samples

GAP = 3_600_000_000
THREAD = ["event", "pid", "tid"]
FUNC_PCT, CHAIN_PCT, MIN_WIDTH_PCT = 0.05, 1.0, 0.1
GRAPHS_PER_STEP = 10


# --- roll-ups -------------------------------------------------------------------

@query("r1_rollup_with_names", """
    SELECT level, r.event, r.pid, r.tid, event_count, sample_count,
        CASE level WHEN 'thread' THEN thread_name WHEN 'process' THEN process_name END AS name
    FROM v_rollup r LEFT JOIN v_thread_names t ON t.event = r.event AND t.pid = r.pid AND t.tid = r.tid
    LEFT JOIN v_process_names p ON p.event = r.event AND p.pid = r.pid""")
def rollup(v):
    return R.named_rollup(v.callstacks)


@query("r2_function_rows", "SELECT event, pid, tid, lib, func, name, sample_count, self, subtree FROM v_function_rows")
def function_rows(v):
    return R.function_rows(v.stacks)


@query("r2_library_rows", "SELECT event, pid, tid, lib, sum(self)::BIGINT AS self FROM v_function_rows GROUP BY event, pid, tid, lib")
def library_rows(v):
    return R.library_rows(R.function_rows(v.stacks))


_SEEN = """
    rows_ AS (SELECT time, i - 1 AS pos, n[i] AS x FROM (SELECT time, n, unnest(range(1, len(n) + 1)) AS i FROM v_callstacks)),
    f AS (SELECT 'lib' || (x % 4) AS lib, 'f' || (x // 2) AS symbol, min({'t': time, 'p': pos}) AS seen, x FROM rows_ GROUP BY x),
    l AS (SELECT lib, min(seen) AS seen FROM f GROUP BY lib),
    lib_ids AS (SELECT lib, row_number() OVER (ORDER BY seen, lib) - 1 AS lib_id FROM l)"""


@query("r3_function_dictionary", f"""
    WITH {_SEEN.strip()} SELECT row_number() OVER (ORDER BY seen, lib, symbol) - 1 AS func_id, lib_id, lib, symbol, x * 16 AS addr, 16::BIGINT AS len
    FROM f JOIN lib_ids USING (lib)""")
def function_dictionary(v):
    return R.dictionaries(v.callstacks)[1]


@query("r3_library_dictionary", f"WITH {_SEEN.strip()} SELECT lib_id, lib FROM lib_ids")
def library_dictionary(v):
    return R.dictionaries(v.callstacks)[0]


@query("s5_decoded_callstacks", """
    SELECT event, pid, tid, time, period, len(n) AS depth, 'f' || (n[1] // 2) AS leaf, 'f' || (n[-1] // 2) AS root FROM v_callstacks""")
def decoded(v):
    rows = v.callstacks.select("*", F.element_at("frames", 1).alias("leaf"), F.slice("frames", F.lit(2), F.size("frames")).alias("callchain")).drop("frames")
    cpu, rest = rows.filter("event = 'cpu-cycles'"), rows.filter("event <> 'cpu-cycles'")
    return callstack_samples([cpu, rest]).select(
        *THREAD, "time", "period", F.size("frames").alias("depth"), F.element_at("frames", 1)["symbol"].alias("leaf"),
        F.element_at("frames", -1)["symbol"].alias("root"))


def _encoded(v):
    return R.encode(R.stack_table(v.callstacks))


@query("r3_encoded_stacks", """
    SELECT event, pid, tid, weight, samples, 'f' || array_to_string([x // 2 FOR x IN n], '/f') AS names FROM v_stacks""")
def encoded(v):
    names = F.array_join(F.transform("calls", lambda c: c["name"]), "/")
    return _encoded(v).select(*THREAD, "weight", "samples", names.alias("names"))


# --- trees ------------------------------------------------------------------------

_NODE = "event, pid, tid, depth, func, self, subtree"


@query("r4_r6_forward_tree", f"SELECT {_NODE} FROM v_tree")
def forward_tree(v):
    return R.call_tree(v.stacks).select(*_NODE.split(", "))


@query("r5_r6_reverse_tree", f"SELECT {_NODE} FROM v_reverse_tree")
def reverse_tree(v):
    return R.call_tree(v.stacks, reverse=True).select(*_NODE.split(", "))


@query("r4_tree_edges", """
    SELECT t.depth, t.func, p.func AS parent_func, count(*) AS nodes, sum(t.subtree)::BIGINT AS subtree, sum(p.subtree)::BIGINT AS parent_subtree
    FROM v_tree t LEFT JOIN v_tree p ON p.event = t.event AND p.pid = t.pid AND p.tid = t.tid AND p.path = t.path[1:t.depth - 1]
    GROUP BY ALL""")
def tree_edges(v):
    tree = R.call_tree(v.stacks)
    parents = tree.select(*THREAD, F.col("node").alias("parent"), F.col("func").alias("parent_func"), F.col("subtree").alias("_p"))
    return tree.join(parents, [*THREAD, "parent"], "left").groupBy("depth", "func", "parent_func").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("subtree").alias("subtree"), F.sum("_p").alias("parent_subtree"))


_MERGE = """
    keyed AS (
        SELECT t.*, p.process_name, min(t.pid) OVER (PARTITION BY t.event, p.process_name) AS new_pid,
            (SELECT count(*) FROM v_process_names q WHERE q.event = t.event AND q.process_name = p.process_name) > 1 AS merged
        FROM v_thread_names t JOIN v_process_names p USING (event, pid)),
    merge AS (
        SELECT event, pid, tid, new_pid, CASE WHEN merged THEN min(tid) OVER (PARTITION BY event, new_pid, thread_name, merged) ELSE tid END AS new_tid FROM keyed)"""


@query("r7_merged_threads", f"""
    WITH {_MERGE.strip()}, f AS (SELECT event, new_pid AS pid, new_tid AS tid, func, sum(sample_count) AS sc, sum(self) AS s, sum(subtree) AS t
        FROM v_function_rows JOIN merge USING (event, pid, tid) GROUP BY ALL)
    SELECT event, pid, tid, func, sc::BIGINT AS sample_count, s::BIGINT AS self, t::BIGINT AS subtree FROM f""")
def merged_threads(v):
    keys = R.merge_keys(v.callstacks)
    merged = R.rekey(R.function_rows(v.stacks), keys)
    return merged.groupBy(*THREAD, "func").agg(*[F.sum(c).alias(c) for c in ("sample_count", "self", "subtree")])


@query("r8_thread_groups", """
    SELECT event, CASE WHEN regexp_full_match(comm, 'thr[01]-.*') THEN 'thr[01]-.*' WHEN regexp_full_match(comm, '.*-1') THEN '.*-1' ELSE comm END AS comm,
        count(*) AS samples, sum(period)::BIGINT AS weight FROM v_callstacks GROUP BY ALL""")
def thread_groups(v):
    return R.group_threads(v.callstacks, ["thr[01]-.*", ".*-1"]).groupBy("event", "comm").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("period").alias("weight"))


@query("r9_flat_table", """
    SELECT subtree AS total, self, sample_count AS samples, f.event, process_name AS process, thread_name AS thread, 'lib' || lib AS library, name AS function
    FROM v_function_rows f JOIN v_thread_names USING (event, pid, tid) JOIN v_process_names USING (event, pid)""")
def flat_table(v):
    threads = R.thread_names(v.callstacks)
    names = threads.join(R.process_names(threads), ["event", "pid"])
    functions = R.function_rows(v.stacks)
    libs = functions.select("lib").distinct().select(F.concat(F.lit("lib"), "lib").alias("library"), F.col("lib").alias("lib_id"))
    return R.flat_table(functions, names, libs.withColumnRenamed("library", "lib"))


@query("r10_shares", """
    WITH lib AS (SELECT event, pid, tid, lib, sum(self)::BIGINT AS self FROM v_function_rows GROUP BY event, pid, tid, lib)
    SELECT 'process' AS level, p.event, p.pid, NULL::BIGINT AS tid, p.pid::VARCHAR AS item, p.event_count, round(p.event_count * 100 / e.event_count, 6) AS share
        FROM v_rollup p JOIN v_rollup e ON e.level = 'event' AND e.event = p.event WHERE p.level = 'process'
    UNION ALL SELECT 'thread', t.event, t.pid, t.tid, t.tid::VARCHAR, t.event_count, round(t.event_count * 100 / p.event_count, 6)
        FROM v_rollup t JOIN v_rollup p ON p.level = 'process' AND p.event = t.event AND p.pid = t.pid WHERE t.level = 'thread'
    UNION ALL SELECT 'library', l.event, l.pid, l.tid, l.lib::VARCHAR, l.self, round(l.self * 100 / t.event_count, 6)
        FROM lib l JOIN v_rollup t ON t.level = 'thread' AND t.event = l.event AND t.pid = l.pid AND t.tid = l.tid
    UNION ALL SELECT 'function', f.event, f.pid, f.tid, f.func::VARCHAR, f.self, round(f.self * 100 / nullif(l.self, 0), 6)
        FROM v_function_rows f JOIN lib l ON l.event = f.event AND l.pid = f.pid AND l.tid = f.tid AND l.lib = f.lib""")
def shares(v):
    functions = R.function_rows(v.stacks)
    rows = R.shares(R.named_rollup(v.callstacks), R.library_rows(functions), functions)
    return rounded(rows)


# --- pruning and order ---------------------------------------------------------------

_KEPT = f"""
    limits AS (
        SELECT t.event, t.pid, t.tid, t.event_count AS thread_count, e.event_count * {FUNC_PCT}::DOUBLE * 0.01::DOUBLE AS lim
        FROM v_rollup t JOIN v_rollup e ON e.level = 'event' AND e.event = t.event WHERE t.level = 'thread'),
    kept AS (SELECT * FROM limits WHERE thread_count >= lim),
    kf AS (SELECT f.* FROM v_function_rows f JOIN kept USING (event, pid, tid) WHERE subtree >= lim),
    kt AS (SELECT t.* FROM v_tree t JOIN kept USING (event, pid, tid) WHERE subtree >= {CHAIN_PCT}::DOUBLE * 0.01::DOUBLE * thread_count),
    kr AS (SELECT t.* FROM v_reverse_tree t JOIN kept USING (event, pid, tid) WHERE subtree >= {CHAIN_PCT}::DOUBLE * 0.01::DOUBLE * thread_count)"""


def _pruned(v):
    return R.prune(R.function_rows(v.stacks), [R.call_tree(v.stacks), R.call_tree(v.stacks, reverse=True)], R.rollup(v.callstacks),
                   FUNC_PCT, CHAIN_PCT)


@query("t1_pruned_trees", f"""
    WITH {_KEPT.strip()} SELECT 'function' AS part, event, pid, tid, 0 AS depth, func, self, subtree FROM kf
    UNION ALL SELECT 'forward', {_NODE} FROM kt UNION ALL SELECT 'reverse', {_NODE} FROM kr""")
def pruned(v):
    _, functions, (forward, reverse) = _pruned(v)
    columns = _NODE.split(", ")
    return (functions.withColumn("depth", F.lit(0)).select(F.lit("function").alias("part"), *columns)
            .unionByName(forward.select(F.lit("forward").alias("part"), *columns))
            .unionByName(reverse.select(F.lit("reverse").alias("part"), *columns)))


@query("t2_trimmed_dictionary", f"""
    WITH {_KEPT.strip()} SELECT func_id FROM (SELECT DISTINCT unnest(n) AS func_id FROM v_stacks)
    WHERE func_id IN (SELECT func FROM kf UNION SELECT func FROM kt UNION SELECT func FROM kr)""")
def trimmed(v):
    _, functions, trees = _pruned(v)
    dictionary = v.stacks.select(F.explode("calls").alias("c")).select(F.col("c.func").alias("func_id")).distinct()
    return R.trim_dictionary(dictionary, functions, trees)


@query("t3_sibling_order", """
    SELECT event, pid, tid, depth, func, subtree,
        row_number() OVER (PARTITION BY event, pid, tid, path[1:depth - 1] ORDER BY 'f' || (func // 2), func)::INTEGER AS sibling FROM v_tree""")
def siblings(v):
    return R.sibling_order(R.call_tree(v.stacks)).select(*THREAD, "depth", "func", "subtree", "sibling")


_RANKED = """
    p AS (SELECT event, pid, event_count AS process_count, row_number() OVER (PARTITION BY event ORDER BY event_count DESC, pid)::INTEGER AS process_rank
        FROM v_rollup WHERE level = 'process'),
    ranked AS (SELECT t.event, t.pid, t.tid, t.event_count, t.sample_count, process_count, process_rank,
            row_number() OVER (PARTITION BY t.event, t.pid ORDER BY t.sample_count DESC, t.tid)::INTEGER AS thread_rank
        FROM v_rollup t JOIN p USING (event, pid) WHERE level = 'thread')"""


@query("t4_export_order", f"WITH {_RANKED.strip()} SELECT event, pid, tid, event_count, sample_count, process_count, process_rank, thread_rank FROM ranked")
def export_order(v):
    return R.export_order(R.named_rollup(v.callstacks))


@query("t14_first_graphs", f"""
    WITH {_RANKED.strip()} SELECT event, pid, tid, process_rank, thread_rank,
        row_number() OVER (PARTITION BY event ORDER BY process_rank, thread_rank)::INTEGER AS graph FROM ranked QUALIFY graph <= {GRAPHS_PER_STEP}""")
def first_graphs(v):
    ranked = R.export_order(R.named_rollup(v.callstacks))
    return views.first_graphs(ranked, GRAPHS_PER_STEP).select(*THREAD, "process_rank", "thread_rank", "graph")


@query("p30_weight_texts", """
    SELECT event, pid, tid, printf('%.2f', floor(event_count * 10000 / total + 0.5) / 100) || '%' AS percent,
        format('{:,}', event_count) AS count, CASE WHEN event LIKE '%task-clock%' THEN printf('%.3f', floor(event_count / 1000 + 0.5) / 1000) || ' ms' END AS ms
    FROM v_rollup JOIN (SELECT event, event_count AS total FROM v_rollup WHERE level = 'event') USING (event) WHERE level = 'thread'""")
def weight_texts(v):
    counts = R.rollup(v.callstacks)
    total = counts.filter("level = 'event'").select("event", F.col("event_count").alias("total"))
    count, clock = F.col("event_count"), X.is_clock_event(F.col("event"))
    return counts.filter("level = 'thread'").join(total, "event").select(
        *THREAD, X.weight_text(count, F.col("total"), "percent").alias("percent"),
        X.weight_text(count, F.col("total"), "count").alias("count"), X.weight_text(count, F.col("total"), "ms", clock).alias("ms"))


@query("k5_record_names", """
    SELECT 'process' AS kind, pid::BIGINT AS id, arg_max(process_name, event) AS name FROM v_process_names GROUP BY pid
    UNION ALL SELECT 'thread', tid, arg_max(thread_name, {'e': event, 'p': pid}) FROM v_thread_names GROUP BY tid""")
def record_names(v):
    libs, functions = R.dictionaries(v.callstacks)
    tables = report.record_tables(functions, libs, R.named_rollup(v.callstacks))
    return tables["processes"].select(F.lit("process").alias("kind"), F.col("pid").alias("id"), "name").unionByName(
        tables["threads"].select(F.lit("thread").alias("kind"), F.col("tid").alias("id"), "name"))


@query("k5_name_tables", f"""
    WITH {_SEEN.strip()} SELECT 'library' AS kind, lib_id AS id, NULL::BIGINT AS lib_id, '&lt;' || lib || '&gt;' AS name FROM lib_ids
    UNION ALL SELECT 'function', row_number() OVER (ORDER BY seen, lib, symbol) - 1, lib_id, '&lt;' || symbol || '&gt;' FROM f JOIN lib_ids USING (lib)""")
def name_tables(v):
    """Names in angle brackets, which the record export escapes."""
    bracket = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    libs, functions = R.dictionaries(v.callstacks)
    tables = report.record_tables(functions.withColumn("symbol", bracket("symbol")), libs.withColumn("lib", bracket("lib")), R.named_rollup(v.callstacks))
    no_lib = F.lit(None).cast("bigint").alias("lib_id")
    return tables["libraries"].select(F.lit("library").alias("kind"), F.col("lib_id").alias("id"), no_lib, "name").unionByName(
        tables["functions"].select(F.lit("function").alias("kind"), F.col("func_id").alias("id"), "lib_id", "name"))


@query("k5_tree_entries", """
    SELECT t.event, t.pid, t.tid, t.depth, '{"e":' || t.self || ',"s":' || t.subtree || ',"f":' || t.func || '}' AS value,
        CASE WHEN p.func IS NOT NULL THEN '{"e":' || p.self || ',"s":' || p.subtree || ',"f":' || p.func || '}' END AS parent
    FROM v_tree t LEFT JOIN v_tree p ON p.event = t.event AND p.pid = t.pid AND p.tid = t.tid AND p.path = t.path[1:t.depth - 1]""")
def tree_entries(v):
    entries = report.tree_entries(R.call_tree(v.stacks), THREAD)
    parents = entries.select(*THREAD, F.col("node").alias("parent"), F.col("value").alias("_parent"))
    return entries.join(parents, [*THREAD, "parent"], "left").select(*THREAD, "depth", "value", F.col("_parent").alias("parent"))


def _document_sql(tree):
    """Path order is pre-order; a line closes what is at least as deep as the next one."""
    return f"""
    WITH o AS (
        SELECT *, row_number() OVER (PARTITION BY event, pid, tid ORDER BY sorted) AS entry,
            coalesce(lead(depth) OVER (PARTITION BY event, pid, tid ORDER BY sorted), 0) AS next_depth,
            row_number() OVER (PARTITION BY event, pid, tid, path[1:depth - 1] ORDER BY sorted) AS sibling
        FROM (SELECT *, list_transform(path, lambda x: {{'n': 'f' || (x // 2), 'f': x}}) AS sorted FROM {tree}))
    SELECT event, pid, tid, entry, CASE WHEN sibling > 1 THEN ',' ELSE '' END || '{{"e":' || self || ',"s":' || subtree || ',"f":' || func || ',"c":['
        || repeat(']}}', depth - next_depth + 1) AS value FROM o
    UNION ALL SELECT event, pid, tid, 0, '{{"e":0,"s":' || sum(subtree) || ',"f":-1,"c":[' FROM {tree} WHERE depth = 1 GROUP BY event, pid, tid"""


@query("k5_tree_documents", _document_sql("v_tree"))
def tree_documents(v):
    return report.tree_documents(tree_order.preorder(R.call_tree(v.stacks), THREAD), THREAD)


@query("k5_reverse_tree_documents", _document_sql("v_reverse_tree"))
def reverse_tree_documents(v):
    return report.tree_documents(tree_order.preorder(R.call_tree(v.stacks, reverse=True), THREAD), THREAD)


@query("k5_function_lists", """
    SELECT event, pid, tid, lib, sum(self) OVER (PARTITION BY event, pid, tid, lib)::BIGINT AS lib_self,
        '{"f":' || func || ',"c":[' || sample_count || ',' || self || ',' || subtree || ']}' AS value FROM v_function_rows""")
def function_lists(v):
    functions = R.function_rows(v.stacks)
    return report.function_lists(functions, R.library_rows(functions), THREAD)


# --- game frames -------------------------------------------------------------------------

def _marker(v):
    return G.marker_function(v.timed_functions, "FVulkanViewport::Present")


def _frames(v):
    return cut(G.boundaries(v.timed, G.first_names(v.timed), _marker(v).scalar(), GAP))


def _threads(v):
    return G.matching_threads(G.first_names(v.timed))


@query("f1_marker_function", "SELECT min(f) AS func_id FROM (SELECT unnest(funcs) AS f FROM v_timed) WHERE f = 1")
def marker_function(v):
    return _marker(v)


@query("f2_frame_boundaries", 'SELECT event, frame_idx, start_ AS start, end_ AS "end" FROM v_frames')
def boundaries(v):
    return _frames(v)


@query("f6_frame_threads", "SELECT event, pid, tid, thread_name FROM v_frame_threads")
def frame_threads(v):
    return _threads(v)


@query("j12_samples_in_frames", """
    SELECT event, pid, tid, frame_idx, count(*) AS samples, sum(period)::BIGINT AS weight FROM v_in_frames GROUP BY ALL""")
def in_frames(v):
    placed = G.in_frames(v.timed, _frames(v)).join(_threads(v), THREAD, "left_semi")
    return placed.groupBy(*THREAD, "frame_idx").agg(F.count(F.lit(1)).alias("samples"), F.sum("period").alias("weight"))


@query("f4_frame_totals", "SELECT event, pid, tid, thread_name, frame_idx, total FROM v_frame_totals")
def frame_totals(v):
    frames = _frames(v)
    return G.frame_totals(G.in_frames(v.timed, frames), frames, _threads(v))


@query("f4_frame_functions", "SELECT event, pid, tid, frame_idx, func, self, subtree FROM v_frame_functions")
def frame_functions(v):
    return G.frame_functions(G.in_frames(v.timed, _frames(v)), _threads(v))


_COMBINED = """
    merged AS (
        SELECT pid, tid, comm, time, CASE WHEN kind = 0 THEN period ELSE coalesce(nxt - time, 0) END AS period, funcs, kind FROM (
            SELECT *, lead(time) OVER (PARTITION BY pid, tid ORDER BY time, kind) AS nxt FROM (
                SELECT *, CASE WHEN event = 'cpu-cycles' THEN 0 ELSE 1 END AS kind FROM v_timed))),
    cf AS (
        SELECT row_number() OVER (ORDER BY time) - 1 AS frame_idx, time AS start_, lead(time) OVER (ORDER BY time) AS end_ FROM (
            SELECT time, lag(time) OVER (ORDER BY time) AS prev FROM (SELECT DISTINCT time FROM merged WHERE tid = 1 AND list_contains(funcs, 1)))
        WHERE prev IS NULL OR time - prev > 3600000000),
    placed AS (SELECT m.*, f.frame_idx FROM merged m ASOF JOIN cf f ON m.time >= f.start_ WHERE m.time < f.end_ AND m.tid IN (0, 1, 2, 5))"""


def _combined(v):
    samples = cut(G.combined(v.timed))
    names = G.first_names(samples)
    frames = cut(G.boundaries(samples, names, _marker(v).scalar(), GAP))
    return samples, G.matching_threads(names), frames


@query("f3_j13_off_cpu_durations", f"WITH {_COMBINED.strip()} SELECT pid, tid, kind, time, period FROM merged")
def off_cpu(v):
    return G.combined(v.timed).select("pid", "tid", "kind", "time", "period")


@query("f5_wall_clock_frames", f"""
    WITH {_COMBINED.strip()} SELECT 'cpu-cycles + sched:sched_switch (combined)' AS event, 7 AS pid, tid, thread_name, frame_idx, end_ - start_ AS total
    FROM cf JOIN (SELECT DISTINCT tid, thread_name FROM v_frame_threads) ON true WHERE end_ IS NOT NULL""")
def wall_clock(v):
    samples, threads, frames = _combined(v)
    return G.frame_totals(samples, frames, threads, wall_clock=True)


@query("f5_wall_clock_functions", f"""
    WITH {_COMBINED.strip()} SELECT tid, frame_idx, func, sum(CASE WHEN func = leaf THEN period ELSE 0 END)::BIGINT AS self, sum(period)::BIGINT AS subtree
    FROM (SELECT tid, frame_idx, period, funcs[1] AS leaf, unnest(list_distinct(funcs)) AS func FROM placed) GROUP BY ALL""")
def wall_clock_functions(v):
    samples, threads, frames = _combined(v)
    return G.frame_functions(G.in_frames(samples, frames), threads).drop("event", "pid")


FPS = 1e9 / 20000.0


def _totals_and_functions(v):
    frames = _frames(v)
    placed = cut(G.in_frames(v.timed, frames))
    return G.frame_totals(placed, frames, _threads(v)), cut(G.frame_functions(placed, _threads(v)))


@query("f7_good_and_bad_frames", """
    SELECT event, pid, tid, count(*) FILTER (total <= 20000) AS good, count(*) FILTER (total > 20000) AS bad FROM v_frame_totals GROUP BY event, pid, tid""")
def good_and_bad(v):
    return G.good_and_bad(_totals_and_functions(v)[0], FPS)


@query("f8_function_stats", """
    WITH r AS (SELECT f.*, total, CASE WHEN total > 0 THEN subtree / total ELSE 0 END AS ratio, total > 20000 AS bad
        FROM v_frame_functions f JOIN v_frame_totals USING (event, pid, tid, frame_idx)),
    s AS (SELECT event, pid, tid, func, count(*) AS frames, sum(subtree)::BIGINT AS total_subtree, min(subtree) AS min_frame, max(subtree) AS max_frame,
        round(avg(subtree), 6) AS avg, round(stddev_pop(subtree), 4) AS stddev,
        round(coalesce(avg(subtree) FILTER (bad), 0) - coalesce(avg(subtree) FILTER (NOT bad), 0), 6) AS delta,
        CASE WHEN avg(ratio) > 0 THEN stddev_pop(ratio) / avg(ratio) ELSE 0 END AS cv, median(subtree)::DOUBLE AS median FROM r GROUP BY event, pid, tid, func)
    SELECT * EXCLUDE (cv), round(cv, 6) AS cv, round(max(cv) OVER (PARTITION BY event, pid, tid), 6) AS max_cv FROM s""")
def function_stats(v):
    totals, functions = _totals_and_functions(v)
    stats = G.function_stats(functions, totals, FPS)
    return rounded(stats.withColumn("stddev", F.round("stddev", 4)))


@query("f9_function_series", "SELECT event, pid, tid, func, frame_idx, round(subtree / 1e6, 6) AS ms FROM v_frame_functions")
def function_series(v):
    return rounded(G.function_series(_totals_and_functions(v)[1]))


@query("k5_frame_entries", """
    SELECT event, pid, tid, frame_idx, '[' || total || ',[' || coalesce((SELECT string_agg(func || ',' || self || ',' || subtree, ',' ORDER BY func)
        FROM v_frame_functions f WHERE f.event = t.event AND f.tid = t.tid AND f.frame_idx = t.frame_idx), '') || ']]' AS value FROM v_frame_totals t""")
def frame_entries(v):
    totals, functions = _totals_and_functions(v)
    return report.frame_entries(totals, functions, THREAD)


@query("j17_frame_thread_trees", f"""
    WITH {_RANKED.strip()} SELECT f.event, f.pid, f.tid, f.thread_name, r.event AS tree_event, r.pid AS tree_pid FROM v_frame_threads f
    LEFT JOIN (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY tid ORDER BY event, process_rank, thread_rank) = 1) r ON r.tid = f.tid""")
def thread_trees(v):
    ranked = R.export_order(R.named_rollup(v.callstacks))
    return G.thread_tree_source(_threads(v), ranked)


@query("g6_stability_colors", """
    WITH r AS (SELECT f.*, CASE WHEN total > 0 THEN subtree / total ELSE 0 END AS ratio FROM v_frame_functions f JOIN v_frame_totals USING (event, pid, tid, frame_idx)),
    s AS (SELECT event, pid, tid, func, CASE WHEN avg(ratio) > 0 THEN stddev_pop(ratio) / avg(ratio) ELSE 0 END AS cv FROM r GROUP BY event, pid, tid, func),
    m AS (SELECT *, max(cv) OVER (PARTITION BY event, pid, tid) AS max_cv FROM s)
    SELECT event, pid, tid, func, CASE WHEN max_cv > 0 AND cv > 0 THEN floor(round(200 + 20 * cv / max_cv, 9)) ELSE 200 END::INTEGER AS r,
        CASE WHEN max_cv > 0 AND cv > 0 THEN floor(round(210 - 150 * cv / max_cv, 9)) ELSE 210 END::INTEGER AS g FROM m""")
def stability_colors(v):
    totals, functions = _totals_and_functions(v)
    stats = G.function_stats(functions, totals, FPS)
    color = layout.stability_color(F.col("cv"), F.col("max_cv"))
    return stats.select(*THREAD, "func", color["r"].alias("r"), color["g"].alias("g"))


# --- flame layout -----------------------------------------------------------------------------

# Boxes by name path: merged under the roots and under merged boxes, single below a single node.
_FLAME = """
    nodes AS (SELECT {keys}, depth, r[1:depth] AS path, 'f' || (r[depth] // 2) AS name, ['f' || (x // 2) FOR x IN r[1:depth]] AS names, sum(weight)::BIGINT AS w, r[depth] AS func
        FROM (SELECT *, unnest(range(1, len(r) + 1)) AS depth FROM ({source})) GROUP BY ALL),
    totals AS (SELECT {keys}, sum(w) AS total FROM nodes WHERE depth = 1 GROUP BY {keys}),
    groups AS (SELECT {keys}, depth, names, count(*) AS cnt FROM nodes GROUP BY ALL),
    singles AS (SELECT n.{first}, n.names, min(g.depth) AS single FROM (SELECT DISTINCT {keys}, names, depth FROM nodes) n
        JOIN groups g ON {same_g} AND g.cnt = 1 AND g.depth <= n.depth AND g.names = n.names[1:g.depth] GROUP BY ALL),
    marked AS (SELECT n.*, coalesce(s.single, n.depth) AS single FROM nodes n LEFT JOIN singles s ON {same_s} AND s.names = n.names),
    boxes AS (SELECT {keys}, depth, name, min(func) AS func, sum(w)::BIGINT AS subtree,
            list_concat(names[1:least(single, depth)], [x::VARCHAR FOR x IN path[least(single, depth) + 1:depth]]) AS box
        FROM marked GROUP BY {keys}, depth, name, box),
    wide AS (SELECT b.*, subtree * 100 / total AS width FROM boxes b JOIN totals USING ({keys})),
    kept AS (SELECT * FROM wide WHERE width >= 0.1),
    placed AS (SELECT *, coalesce(sum(width) OVER (PARTITION BY {keys}, depth, box[1:depth - 1] ORDER BY name, func ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM kept),
    flame AS (SELECT p.*, (SELECT sum(a.off) FROM placed a WHERE {same_a} AND a.depth <= p.depth AND a.box = p.box[1:a.depth]) AS x FROM placed p)"""


def _flame_sql(keys, source):
    names = [k.strip() for k in keys.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)
    return _FLAME.format(keys=keys, first=", n.".join(names), source=source, same_g=same("g", "n"), same_s=same("s", "n"), same_a=same("a", "p")).strip()


_FORWARD = "SELECT event, pid, tid, weight, list_reverse(n) AS r FROM v_stacks"


@query("g1_g2_flame_layout", f"""
    WITH {_flame_sql("event", _FORWARD)}
    SELECT event, depth - 1 AS depth, name, subtree, round(width, 6) AS width, round(x, 6) AS x FROM flame""")
def flame(v):
    return rounded(layout.flame(v.stacks, MIN_WIDTH_PCT, keys=["event"]).select("event", "depth", "name", "subtree", "width", "x"))


@query("g2_flame_max_depth", f"WITH {_flame_sql('event', _FORWARD)} SELECT event, max(depth)::INTEGER AS max_depth FROM kept GROUP BY event")
def flame_depth(v):
    return layout.max_depth(layout.flame(v.stacks, MIN_WIDTH_PCT, keys=["event"]), ["event"])


@query("g5_g6_flame_highlight_and_heat", f"""
    WITH {_flame_sql("event", _FORWARD)}
    SELECT event, depth - 1 AS depth, name || ' | lib' || (func % 4) || ' (' || subtree || ' events: x)' AS title, contains(name || ' | lib' || (func % 4) || ' (' || subtree || ' events: x)', 'f1') AS hit,
        floor(245 + 10 * (1 - width * 0.01))::INTEGER AS r, floor(110 + 105 * (1 - width * 0.01))::INTEGER AS g FROM flame""")
def highlight(v):
    rows = layout.flame(v.stacks, MIN_WIDTH_PCT, keys=["event"])
    library = F.concat(F.lit("lib"), F.col("func") % 4)
    titled = rows.withColumn("title", layout.title(F.col("name"), library, F.col("subtree"), F.lit("x")))
    color = layout.heat_color(F.col("width"))
    return layout.highlight(titled, "title", "f1").select("event", "depth", "title", "hit", color["r"].alias("r"), color["g"].alias("g"))


_TARGET = 3


@query("g3_callees", f"""
    WITH {_flame_sql("event", f"SELECT event, weight, r[list_position(r, {_TARGET}):] AS r FROM ({_FORWARD}) WHERE list_contains(r, {_TARGET})")}
    SELECT event, depth - 1 AS depth, name, subtree, round(width, 6) AS width, round(x, 6) AS x FROM flame""")
def callees(v):
    below = layout.calls_below(v.stacks, F.lit(_TARGET))
    return rounded(layout.flame(below, MIN_WIDTH_PCT, keys=["event"]).select("event", "depth", "name", "subtree", "width", "x"))


@query("g4_callers", f"""
    WITH {_flame_sql("event", f"SELECT event, weight, n[list_position(n, {_TARGET}):] AS r FROM v_stacks WHERE list_contains(n, {_TARGET})")}
    SELECT event, depth - 1 AS depth, name, subtree, round(width, 6) AS width, round(x, 6) AS x FROM flame""")
def callers(v):
    above = layout.calls_below(v.stacks, F.lit(_TARGET), reverse=True)
    return rounded(layout.flame(above, MIN_WIDTH_PCT, keys=["event"], reverse=True).select("event", "depth", "name", "subtree", "width", "x"))

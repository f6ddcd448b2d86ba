"""The adapter views and shared intermediate results in SQL, for the side-by-side check."""

from __future__ import annotations

import re

_TAG = 1 << 62
_MASK = (1 << 56) - 1


def _word_class(w: str) -> str:
    def any_of(pairs):
        return "(" + " OR ".join(f"({w} & {mask}) = {value}" for mask, value in pairs) + ")"

    barrier = f"({w} IN ({0xD50330BF}, {0xD50331BF}, {0xD50332BF}, {0xD50333BF}, {0xD5033F9F}) OR " + any_of(
        [(0xFFFFF0FF, 0xD503305F), (0xFFFFF0FF, 0xD503309F), (0xFFFFF0FF, 0xD50330DF)]) + ")"
    branch = f"(({w} >> 26) & 63 IN (5, 37) OR " + any_of(
        [(0x7E000000, 0x34000000), (0x7E000000, 0x36000000), (0xFE000000, 0x54000000), (0xFE000000, 0xD6000000)]) + ")"
    prefetch = any_of([(0xFFC00000, 0xF9800000), (0xFFE00C00, 0xF8800000), (0xFFE00C00, 0xF8A00000), (0xFF000000, 0xD8000000)])
    memory = f"(({w} >> 25) & 7 IN (4, 6))"
    exclusive = f"(({w} & {0x3F000000}) = {0x08000000})"
    acquire = f"({exclusive} AND ({w} >> 23) & 1 = 1 AND ({w} >> 15) & 1 = 1)"
    vector = f"(({w} >> 26) & 1 = 1)"
    literal = f"(({w} & {0x1B000000}) = {0x18000000})"
    pair = f"(({w} & {0x3A000000}) = {0x28000000})"
    load = f"({literal} OR ({w} >> 22) & 1 = 1)"
    sign = f"(({w} >> 31) & 1 = 1 AND ({w} >> 23) & 1 = 1)"
    system = f"({w} & {0xFFC00000}) = {0xD5000000}"
    klass = f"""CASE WHEN {barrier} THEN 'barrier_or_sync' WHEN {system} THEN 'system_instruction'
        WHEN {branch} THEN 'branch' WHEN {prefetch} THEN 'prefetch'
        WHEN {memory} AND {acquire} THEN 'acquire_release' WHEN {memory} AND {exclusive} THEN 'atomic'
        WHEN {memory} AND {vector} AND {load} THEN 'vector_load' WHEN {memory} AND {load} THEN 'scalar_load'
        WHEN {memory} AND {vector} THEN 'vector_store' WHEN {memory} THEN 'scalar_store'
        WHEN ({w} >> 25) & 7 IN (3, 7) THEN 'compute_fp_simd' ELSE 'compute_int' END"""
    kind = f"""CASE WHEN {barrier} OR {system} OR {branch} THEN NULL WHEN {prefetch} THEN 'load_prefetch'
        WHEN NOT ({memory} AND {load}) THEN NULL WHEN {acquire} THEN 'load_acquire'
        WHEN {exclusive} THEN 'load_atomic_exclusive' WHEN {pair} AND {vector} THEN 'load_vector_pair'
        WHEN {pair} THEN 'load_scalar_pair' WHEN {literal} THEN 'load_literal' WHEN {vector} THEN 'load_vector_single'
        WHEN {sign} THEN 'load_sign_extend' ELSE 'load_scalar_single' END"""
    return f"{klass} AS class, {kind} AS kind"


def number_text(value: str) -> str:
    """Printed number: whole values without decimals, others with six."""
    x = f"({value})::DOUBLE"
    return f"CASE WHEN {x} = floor({x}) THEN printf('%.0f', {x}) ELSE printf('%.6f', {x}) END"


def stats_sql(freq: str, keys: str) -> str:
    """Latency statistics of a frequency view ``freq`` grouped by ``keys``."""
    on = " AND ".join(f"r.{k.strip()} IS NOT DISTINCT FROM t.{k.strip()}" for k in keys.split(","))
    return f"""
        WITH t AS (
            SELECT {keys}, sum(cnt) AS sample_count, coalesce(sum(cnt) FILTER (latency IS NOT NULL), 0) AS latency_count,
                coalesce(sum(latency * cnt), 0) AS latency_sum, sum(latency::DOUBLE * latency * cnt) AS sq,
                min(latency) AS min_latency_cycles, max(latency) AS max_latency_cycles
            FROM {freq} GROUP BY {keys}),
        r AS (
            SELECT *, sum(cnt) OVER (PARTITION BY {keys} ORDER BY latency) AS upto
            FROM {freq} WHERE latency IS NOT NULL),
        p AS (
            SELECT t.*, (SELECT min(r.latency) FROM r WHERE {on} AND r.upto >= ceil((95e0 / 100e0) * t.latency_count)) AS p95_latency_cycles,
                (SELECT min(r.latency) FROM r WHERE {on} AND r.upto >= ceil((99e0 / 100e0) * t.latency_count)) AS p99_latency_cycles
            FROM t)
        SELECT {", ".join("t." + k.strip() for k in keys.split(","))}, t.sample_count::BIGINT AS sample_count,
            t.latency_count::BIGINT AS latency_count, t.latency_sum::BIGINT AS latency_sum, t.min_latency_cycles,
            t.max_latency_cycles, t.p95_latency_cycles, t.p99_latency_cycles,
            CASE WHEN t.latency_count > 0 THEN t.latency_sum / t.latency_count END AS avg_latency_cycles,
            CASE WHEN t.latency_count > 0 THEN sqrt(greatest(0.0, t.sq / t.latency_count
                - (t.latency_sum / t.latency_count) * (t.latency_sum / t.latency_count))) END AS std_latency_cycles,
            coalesce((SELECT sum(r.latency * r.cnt) FROM r WHERE {on} AND r.latency > t.p95_latency_cycles), 0)::BIGINT AS over_p95_sum,
            coalesce((SELECT sum(r.latency * r.cnt) FROM r WHERE {on} AND r.latency > t.latency_sum / t.latency_count), 0)::BIGINT AS over_avg_sum
        FROM p AS t"""


_FILE = "'/src/d' || (({0}) % 10) || '/f' || ({0}) || '.cpp'"

VIEWS = {
    "v_addressed": f"""
        SELECT *, l_partkey * 64 + CASE WHEN l_returnflag = 'R' THEN {_TAG} ELSE 0 END AS ip,
            CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' THEN 1 + l_partkey * 64 // 1280
                 WHEN l_linenumber % 2 = 0 THEN 0 WHEN l_linenumber = 7 THEN 1 + l_suppkey
                 ELSE 1 + l_partkey * 64 // 1280 END AS mapping_id,
            l_suppkey % 4 AS cpu, 100 + l_suppkey % 8 AS tid
        FROM lineitem""",
    "v_catalog": """
        SELECT * FROM (VALUES (0, 'cpu_cycles'), (1, 'inst_retired'), (2, 'l1d_cache_access'), (3, 'l1d_cache_refill'),
            (4, 'branch_retired'), (5, 'branch_mispredict')) AS c(ordinal, event_key)""",
    "v_pmu": """
        SELECT coalesce(c.event_key, 'unknown_event') AS event_key, l_linenumber - 1 AS event_key_ref, cpu, tid, mapping_id, ip,
            CAST(l_quantity AS BIGINT) AS period,
            CASE WHEN l_linenumber = 1 THEN []::BIGINT[] WHEN l_linenumber >= 5 THEN [l_partkey // 10 * 64]
                 ELSE [l_partkey // 10 * 64, l_partkey // 100 * 64] END AS callchain
        FROM v_addressed LEFT JOIN v_catalog c ON c.ordinal = l_linenumber - 1""",
    "v_hits": """
        SELECT mapping_id, ip, event_key, cpu, tid, period, true AS own FROM v_pmu
        UNION ALL SELECT mapping_id, unnest(callchain) AS ip, event_key, cpu, tid, period, false AS own FROM v_pmu""",
    "v_by_address": """
        SELECT mapping_id, ip, event_key, sum(CASE WHEN own THEN period ELSE 0 END)::BIGINT AS self_weight,
            count(*) FILTER (own) AS self_samples, sum(CASE WHEN own THEN 0 ELSE period END)::BIGINT AS acc_weight,
            count(*) FILTER (NOT own) AS acc_samples
        FROM v_hits GROUP BY mapping_id, ip, event_key""",
    "v_maps": """
        SELECT s_suppkey + 1 AS mapping_id, s_suppkey * 1280 AS start_, s_suppkey * 1280 + 960 AS end_,
            s_suppkey * 1280 + CASE WHEN s_suppkey % 2 = 0 THEN 256 ELSE 0 END AS offset_,
            CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2048 ELSE -4096 END AS load_bias,
            'mod' || (s_suppkey % 3) AS module_id, s_suppkey AS pos FROM supplier
        UNION ALL
        SELECT 1000001 + g, lo * 1280, hi * 1280 + 640, 0, 0, 'reg' || (g % 5), 1000000 + g FROM (
            SELECT s_suppkey // 20 AS g, min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM supplier GROUP BY 1)""",
    "v_matches": """
        SELECT DISTINCT module_id, CASE WHEN module_id LIKE 'mod%' THEN '/sym/' || module_id || '.debug' END AS candidate_path
        FROM v_maps""",
    "v_symbols": """
        SELECT 'mod' || (p_partkey % 3) AS module_id, 64 + p_partkey * 64 AS address,
            CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 4 END AS size, p_name || '#' || p_partkey AS name FROM part""",
    "v_line_table": f"""
        SELECT 'mod' || (p_partkey % 3) AS module_id, p_partkey * 64 AS lo, p_partkey * 64 + 160 AS hi,
            {_FILE.format('p_partkey // 4')} AS file, p_partkey % 40 AS line,
            CASE WHEN p_partkey % 7 <> 0 THEN 'fn_' || p_brand END AS function FROM part""",
    "v_narrowest": f"""
        SELECT k.ip, m.* FROM (SELECT DISTINCT ip & {_MASK} AS ip FROM v_addressed
            UNION SELECT DISTINCT ip FROM v_hits) k
        JOIN v_maps m ON k.ip >= m.start_ AND k.ip < m.end_
        QUALIFY row_number() OVER (PARTITION BY k.ip ORDER BY m.end_ - m.start_, m.pos) = 1""",
    "v_rel_narrowest": """
        SELECT ip, mapping_id, module_id, CASE WHEN r >= 0 THEN r END AS rel FROM (
            SELECT *, CASE WHEN load_bias <> 0 THEN ip - load_bias ELSE ip - start_ + offset_ END AS r FROM v_narrowest)""",
    "v_modules": f"""
        SELECT k.mapping_id, k.ip AS ip,
            CASE WHEN k.mapping_id = 0 THEN CASE WHEN n.rel IS NOT NULL THEN n.module_id END
                 WHEN x.rel >= 0 THEN x.module_id END AS module_id,
            CASE WHEN k.mapping_id = 0 THEN n.rel WHEN x.rel >= 0 THEN x.rel END AS rel
        FROM (SELECT DISTINCT mapping_id, ip FROM v_hits) k
        LEFT JOIN v_rel_narrowest n ON n.ip = (k.ip & {_MASK})
        LEFT JOIN LATERAL (
            SELECT m.module_id, CASE WHEN m.load_bias <> 0 THEN (k.ip & {_MASK}) - m.load_bias
                ELSE (k.ip & {_MASK}) - m.start_ + m.offset_ END AS rel
            FROM v_maps m WHERE m.mapping_id = k.mapping_id AND (k.ip & {_MASK}) >= m.start_ AND (k.ip & {_MASK}) < m.end_) x ON true""",
    "v_placed": """
        SELECT m.mapping_id, m.ip, m.module_id, m.rel, l.file, l.line, coalesce(l.function, '') AS function
        FROM v_modules m LEFT JOIN v_matches s ON s.module_id = m.module_id
        LEFT JOIN v_line_table l ON l.module_id = m.module_id AND s.candidate_path IS NOT NULL
            AND m.rel >= l.lo AND m.rel < l.hi AND l.line <> 0""",
    "v_by_line": """
        SELECT file, line, event_key, sum(self_weight)::BIGINT AS self_weight, sum(self_samples)::BIGINT AS self_samples,
            sum(acc_weight)::BIGINT AS acc_weight, sum(acc_samples)::BIGINT AS acc_samples
        FROM v_by_address JOIN v_placed USING (mapping_id, ip) WHERE file IS NOT NULL GROUP BY file, line, event_key""",
    "v_counter_rows": """
        SELECT file, line, sum(self_samples + acc_samples)::BIGINT AS sample_count,
            coalesce(sum(self_weight) FILTER (event_key = 'cpu_cycles' AND self_samples > 0), sum(self_weight))::DOUBLE AS self_weight,
            coalesce(sum(acc_weight) FILTER (event_key = 'cpu_cycles' AND acc_samples > 0), sum(acc_weight))::DOUBLE AS accumulated_weight,
            coalesce(sum(self_samples + acc_samples) FILTER (event_key = 'cpu_cycles'), 0)::BIGINT AS n_cycles,
            coalesce(sum(self_samples + acc_samples) FILTER (event_key = 'inst_retired'), 0)::BIGINT AS n_inst,
            coalesce(sum(self_samples + acc_samples) FILTER (event_key = 'l1d_cache_access'), 0)::BIGINT AS n_access,
            coalesce(sum(self_samples + acc_samples) FILTER (event_key = 'l1d_cache_refill'), 0)::BIGINT AS n_refill,
            coalesce(sum(self_samples + acc_samples) FILTER (event_key = 'branch_retired'), 0)::BIGINT AS n_branch
        FROM v_by_line GROUP BY file, line""",
    "v_source": f"""
        SELECT file, (i)::INTEGER AS line, lines[i] AS code FROM (
            SELECT file, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
                SELECT {_FILE.format('doc_id')} AS file,
                    regexp_split_to_array(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') AS lines
                FROM documents WHERE text <> ''))""",
    "v_instructions": f"""
        SELECT *, {_word_class('word')} FROM (
            SELECT 'mod' || (p_partkey % 3) AS module_id, p_partkey * 64 AS address, p_partkey * 2654435761 % 4294967296 AS word FROM part)""",
    "v_spe": f"""
        SELECT *, CASE WHEN category IN ('decode_unknown', 'other_unknown') THEN 'unknown_instruction' ELSE class END AS child FROM (
            SELECT s.*, coalesce(i.class, 'unknown_instruction') AS class, i.kind,
                CASE WHEN decode_status <> 0 THEN 'decode_unknown'
                     WHEN operation_flags & 3 = 3 THEN 'atomic_' || CASE WHEN lvl = 'io' THEN 'unknown' ELSE lvl END
                     WHEN operation_flags & 1 = 1 THEN 'load_' || lvl WHEN operation_flags & 2 = 2 THEN 'store_' || lvl
                     WHEN operation_flags & 4 = 4 THEN CASE branch_result WHEN 1 THEN 'branch_hit' WHEN 2 THEN 'branch_miss' ELSE 'branch_unknown' END
                     WHEN operation_flags & 8 = 8 THEN 'compute_unknown' ELSE 'other_unknown' END AS category
            FROM (
                SELECT cpu, tid, mapping_id, ip, (l_suppkey % 16)::INTEGER AS operation_flags, l_orderkey % 256 AS event_flags,
                    [0, 8, 9, 10, 11, 12, 13, 14, 15, 65535][l_partkey % 10 + 1] AS data_source,
                    ['l1', 'l2', 'peer_core', 'peer_cluster', 'system_cache', 'peer_cluster', 'remote', 'dram', 'io', 'unknown'][l_partkey % 10 + 1] AS lvl,
                    l_linenumber % 3 AS branch_result, (l_orderkey % 3)::INTEGER AS cache_result,
                    CASE WHEN l_orderkey % 37 = 0 THEN 1 ELSE 0 END AS decode_status,
                    CASE WHEN l_orderkey % 11 <> 0 THEN floor(l_extendedprice)::BIGINT % 997 END AS latency
                FROM v_addressed) s
            LEFT JOIN v_modules m USING (mapping_id, ip) LEFT JOIN v_instructions i ON i.module_id = m.module_id AND i.address = m.rel)""",
    "v_spe_placed": """
        SELECT DISTINCT p.* FROM v_placed p JOIN (SELECT DISTINCT mapping_id, ip FROM v_spe) s USING (mapping_id, ip)""",
    "v_spe_freq": """
        SELECT mapping_id, ip, cpu, category, class, kind, child, latency, count(*) AS cnt FROM v_spe
        GROUP BY mapping_id, ip, cpu, category, class, kind, child, latency""",
    "v_stacks": """
        SELECT event, pid, tid, n, sum(period)::BIGINT AS weight, count(*) AS samples FROM v_callstacks GROUP BY event, pid, tid, n""",
    "v_callstacks": """
        SELECT CASE l_returnflag WHEN 'R' THEN 'cpu-cycles' WHEN 'A' THEN 'sched:sched_switch' ELSE 'task-clock' END AS event,
            l_suppkey % 5 AS pid, l_suppkey % 20 AS tid, 'thr' || (l_suppkey % 20 % 3) || '-' || (year(l_shipdate) % 2) AS comm,
            epoch_us(l_shipdate) + l_orderkey AS time, CAST(l_quantity AS BIGINT) AS period,
            [l_partkey, l_partkey // 10, l_partkey // 100, 0][1 + l_linenumber % 4:] AS n
        FROM lineitem""",
    "v_tree_rows": """
        SELECT event, pid, tid, weight, list_reverse(n) AS r, unnest(range(1, len(n) + 1)) AS depth FROM v_stacks""",
    "v_tree": """
        SELECT event, pid, tid, depth, r[1:depth] AS path, r[depth] AS func,
            sum(CASE WHEN depth = len(r) THEN weight ELSE 0 END)::BIGINT AS self, sum(weight)::BIGINT AS subtree
        FROM v_tree_rows GROUP BY event, pid, tid, depth, r[1:depth], r[depth]""",
    "v_reverse_tree": """
        SELECT event, pid, tid, depth, n[1:depth] AS path, n[depth] AS func,
            sum(CASE WHEN depth = len(n) THEN weight ELSE 0 END)::BIGINT AS self, sum(weight)::BIGINT AS subtree
        FROM (SELECT *, unnest(range(1, len(n) + 1)) AS depth FROM v_stacks) GROUP BY event, pid, tid, depth, n[1:depth], n[depth]""",
    "v_function_rows": """
        SELECT event, pid, tid, func % 4 AS lib, func, 'f' || (func // 2) AS name,
            sum(CASE WHEN func = leaf THEN samples ELSE 0 END)::BIGINT AS sample_count,
            sum(CASE WHEN func = leaf THEN weight ELSE 0 END)::BIGINT AS self, sum(weight)::BIGINT AS subtree
        FROM (SELECT event, pid, tid, weight, samples, n[1] AS leaf, unnest(list_distinct(n)) AS func FROM v_stacks)
        GROUP BY event, pid, tid, func""",
    "v_thread_names": """
        SELECT event, pid, tid, comm AS thread_name FROM v_callstacks
        QUALIFY row_number() OVER (PARTITION BY event, pid, tid ORDER BY time DESC, comm DESC) = 1""",
    "v_process_names": """
        SELECT event, pid, coalesce(max(thread_name) FILTER (tid = pid), '') AS process_name FROM v_thread_names GROUP BY event, pid""",
    "v_rollup": """
        SELECT CASE WHEN grouping(tid) = 0 THEN 'thread' WHEN grouping(pid) = 0 THEN 'process' ELSE 'event' END AS level,
            event, pid, tid, sum(period)::BIGINT AS event_count, count(*) AS sample_count
        FROM v_callstacks GROUP BY GROUPING SETS ((event), (event, pid), (event, pid, tid))""",
    "v_timed": """
        SELECT CASE WHEN event_id % 3 = 0 THEN 'sched:sched_switch' ELSE 'cpu-cycles' END AS event, 7 AS pid, user_id % 6 AS tid,
            ['GameThread', 'RHIThread', 'RenderThread 1', 'Worker', 'AudioThread', 'RHIThread 2'][user_id % 6 + 1] AS comm,
            epoch_us(ts) AS time, floor(value * 100)::BIGINT AS period,
            [10 + event_id % 7, 20 + user_id // 10, CASE WHEN event_type = 'purchase' THEN 1 ELSE 2 END, 0] AS funcs
        FROM events""",
    "v_frames": """
        SELECT event, row_number() OVER (PARTITION BY event ORDER BY time) - 1 AS frame_idx, time AS start_,
            lead(time) OVER (PARTITION BY event ORDER BY time) AS end_ FROM (
            SELECT event, time, lag(time) OVER (PARTITION BY event ORDER BY time) AS prev FROM (
                SELECT DISTINCT event, time FROM v_timed WHERE tid = 1 AND list_contains(funcs, 1)))
        WHERE prev IS NULL OR time - prev > 3600000000
        QUALIFY end_ IS NOT NULL""",
    "v_in_frames": """
        SELECT t.*, f.frame_idx FROM v_timed t ASOF JOIN (
            SELECT event, frame_idx, start_, end_ FROM v_frames) f ON t.event = f.event AND t.time >= f.start_
        WHERE t.time < f.end_ AND t.tid IN (0, 1, 2, 5)""",
    "v_frame_threads": """
        SELECT DISTINCT event, pid, tid, comm AS thread_name FROM v_timed WHERE tid IN (0, 1, 2, 5)""",
    "v_frame_totals": """
        SELECT h.event, h.pid, h.tid, h.thread_name, f.frame_idx, coalesce(sum(s.period), 0)::BIGINT AS total
        FROM v_frames f JOIN v_frame_threads h USING (event)
        LEFT JOIN v_in_frames s ON s.event = h.event AND s.tid = h.tid AND s.frame_idx = f.frame_idx
        GROUP BY h.event, h.pid, h.tid, h.thread_name, f.frame_idx""",
    "v_frame_functions": """
        SELECT event, pid, tid, frame_idx, func, sum(CASE WHEN func = leaf THEN period ELSE 0 END)::BIGINT AS self,
            sum(period)::BIGINT AS subtree
        FROM (SELECT event, pid, tid, frame_idx, period, funcs[1] AS leaf, unnest(list_distinct(funcs)) AS func FROM v_in_frames)
        GROUP BY event, pid, tid, frame_idx, func""",
    "v_manifest": """
        SELECT 's' || s_suppkey AS session_id, CASE WHEN s_suppkey % 13 = 0 THEN 'other_bundle' ELSE 'profile_bundle' END AS schema_name,
            CASE WHEN s_suppkey % 17 = 0 THEN 2 ELSE 1 END AS schema_major, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS target_package,
            CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey + 1000 END AS pid, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 10 END AS duration_ms,
            s_suppkey % 2 = 0 AS pmu_enabled, s_suppkey % 3 <> 0 AS pmu_available,
            CASE WHEN s_suppkey % 9 = 0 THEN 'open failed ' || s_nationkey END AS pmu_missing_reason,
            true AS spe_enabled, s_suppkey % 5 <> 0 AS spe_available, CASE WHEN s_suppkey % 10 = 0 THEN 'no device' END AS spe_missing_reason,
            range(0, s_suppkey % 4 + 1) AS selected_cpus, 'cluster' || (s_suppkey % 2) AS cluster, s_suppkey + 8 AS pmu_buffer_pages,
            CASE WHEN s_suppkey % 2 <> 0 THEN s_suppkey * 4096 END AS spe_aux_buffer_bytes, s_suppkey AS s FROM supplier""",
    "v_loss": """
        SELECT 's' || s_suppkey AS session_id, s_suppkey % 3 AS pmu_lost_records, s_suppkey % 2 AS ring_buffer_overruns,
            s_suppkey % 4 AS spe_decode_errors FROM supplier""",
    "v_runs": """
        SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'cpu_cycles' ELSE 'inst_retired' END AS event_key, s_suppkey % 8 AS cpu,
            s_suppkey * 1000 + 500 AS raw_count, CASE WHEN s_suppkey % 6 = 0 THEN 0.0 ELSE s_suppkey * 1001.0 END::DOUBLE AS scaled_count,
            s_suppkey * 1000000 AS time_running_ns FROM supplier""",
    "v_mods": """
        SELECT s_suppkey AS s, 'lib' || s_suppkey || CASE WHEN s_suppkey % 4 = 3 THEN '.jar' ELSE '.so' END AS module_id,
            ['/data/app/x/', '/system/lib/', '/data/local/tmp/', '/opt/'][s_suppkey % 4 + 1] || 'lib' || (s_suppkey % 40) || '.so' AS runtime_path,
            CASE WHEN s_suppkey % 3 = 0 THEN 'b' || (s_suppkey % 30) END AS build_id,
            CASE WHEN s_suppkey % 2 = 0 THEN 'lib' || (s_suppkey % 25) || '.so' END AS soname,
            CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 5 * 100 END AS file_size,
            CASE WHEN s_suppkey % 5 = 1 THEN 'dbg/lib' || (s_suppkey % 20) || '.so' END AS hint FROM supplier""",
    "v_candidates": """
        SELECT DISTINCT '/sym' || (p_partkey % 9) || '/dbg/lib' || (p_partkey % 60) || '.so' AS path, 'lib' || (p_partkey % 60) || '.so' AS base,
            CASE WHEN p_partkey % 2 = 0 THEN 'b' || (p_partkey % 45) END AS build_id, p_partkey % 6 * 100 AS file_size,
            p_size % 2 = 0 AS has_debug_info FROM part""",
    "v_symbol_files": """
        SELECT module_id, runtime_path, path AS candidate_path, coalesce(quality, 'missing') AS quality, coalesce(has_debug_info, false) AS has_debug_info
        FROM (
            SELECT m.module_id, m.runtime_path, t.* FROM v_mods m LEFT JOIN (
                SELECT m.s, 1 AS tier, 'build_id' AS quality, c.path, c.has_debug_info,
                    row_number() OVER (PARTITION BY m.s ORDER BY c.has_debug_info DESC, coalesce(c.file_size = m.file_size, false) DESC, c.file_size DESC, c.path DESC) AS rn
                FROM v_mods m JOIN v_candidates c ON c.build_id = m.build_id
                UNION ALL SELECT m.s, 2, 'user_path', c.path, c.has_debug_info, row_number() OVER (PARTITION BY m.s ORDER BY c.path, c.has_debug_info)
                FROM v_mods m JOIN v_candidates c ON ends_with(c.path, m.hint)
                UNION ALL SELECT m.s, 3, 'soname_and_size', c.path, c.has_debug_info, row_number() OVER (PARTITION BY m.s ORDER BY c.path, c.has_debug_info)
                FROM v_mods m JOIN v_candidates c ON c.base = m.soname AND c.file_size = m.file_size
                UNION ALL SELECT m.s, 4, 'file_name', c.path, c.has_debug_info, row_number() OVER (PARTITION BY m.s ORDER BY c.path, c.has_debug_info)
                FROM v_mods m JOIN v_candidates c ON c.base = split_part(m.runtime_path, '/', -1)) t ON t.s = m.s AND t.rn = 1
            QUALIFY row_number() OVER (PARTITION BY m.s ORDER BY t.tier) = 1)""",
}


def _used(sql: str) -> set[str]:
    return {name for name in VIEWS if re.search(rf"\b{name}\b", sql)}


def with_views(sql: str) -> str:
    """The statement with the views it needs in front, in dependency order."""
    needed, queue = set(), list(_used(sql))
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += _used(VIEWS[name]) - {name}
    ordered: list[str] = []

    def place(name: str) -> None:
        for dependency in sorted(_used(VIEWS[name]) - {name}):
            place(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in sorted(needed):
        place(name)
    if not ordered:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    return f"WITH {views}\n{sql.strip()}" if not sql.strip().upper().startswith("WITH") else (
        f"WITH {views},\n{sql.strip()[4:].strip()}")

"""Queries: counter samples, address resolution, source line reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaprof.functions import address as A
from lumaprof.functions import metric_value as M
from lumaprof.functions import paths as P
from lumaprof.functions import text as X
from lumaprof.operators import counters, lines, resolve, sampling, stack_text
from lumaprof.plans.adapters import PLAN
from lumaprof.plans.line_report import Profile, line_rows
from lumaprof.plans.registry import query, r6, rounded
from lumaprof.plans.sql_views import number_text

MASK = (1 << 56) - 1
ADDRESS_SUMS = "self_weight, self_samples, acc_weight, acc_samples"


@query("weight_per_module", """
    SELECT coalesce(m.module_id, '<unresolved>') AS module_id, event_key, sum(self_weight)::BIGINT AS self_weight,
        sum(acc_weight)::BIGINT AS acc_weight, sum(self_samples + acc_samples)::BIGINT AS samples
    FROM v_by_address JOIN v_modules m USING (mapping_id, ip) GROUP BY 1, 2""")
def weight_per_module(v):
    placed = resolve.to_module(v.by_address, v.maps)
    rows = v.by_address.join(placed, ["mapping_id", "ip"])
    return rows.groupBy(F.coalesce("module_id", F.lit("<unresolved>")).alias("module_id"), "event_key").agg(
        F.sum("self_weight").alias("self_weight"), F.sum("acc_weight").alias("acc_weight"),
        F.sum(F.col("self_samples") + F.col("acc_samples")).alias("samples"))


@query("j1_event_keys", """
    SELECT event_key, event_key_ref, count(*) AS n, sum(period)::BIGINT AS weight FROM v_pmu GROUP BY event_key, event_key_ref""")
def event_keys(v):
    return v.samples.groupBy("event_key", "event_key_ref").agg(
        F.count(F.lit(1)).alias("n"), F.sum("period").alias("weight"))


@query("a1_counters_by_address", f"SELECT mapping_id, ip, event_key, {ADDRESS_SUMS} FROM v_by_address")
def counters_by_address(v):
    return v.by_address


@query("a1_ids_by_address", """
    SELECT mapping_id, ip, array_to_string(list_sort(list(DISTINCT cpu)), ',') AS cpus,
        array_to_string(list_sort(list(DISTINCT tid)), ',') AS tids FROM v_hits GROUP BY mapping_id, ip""")
def ids_by_address(v):
    return counters.ids_by_address(v.samples).groupBy("mapping_id", "ip").agg(
        X.id_list_text(F.collect_set("cpu")).alias("cpus"), X.id_list_text(F.collect_set("tid")).alias("tids"))


@query("a2_counter_totals", """
    SELECT count(*) AS sample_count, array_to_string(list_sort(list(DISTINCT cpu)), ',') AS cpus,
        array_to_string(list_sort(list(DISTINCT event_key) FILTER (event_key <> 'unknown_event')), ',') AS event_keys FROM v_pmu""")
def counter_totals(v):
    rows = counters.totals(v.pmu, v.catalog)
    return rows.select("sample_count", F.array_join(F.col("cpus").cast("array<string>"), ",").alias("cpus"),
                       F.array_join("event_keys", ",").alias("event_keys"))


@query("p6_tag_mask", f"""
    SELECT ip & {MASK} AS ip, count(*) AS n, count(*) FILTER (ip > {MASK}) AS tagged FROM v_addressed GROUP BY 1""")
def tag_mask(v):
    tagged = F.count_if(F.col("ip") > MASK).alias("tagged")
    return v.pmu.groupBy(A.untagged(F.col("ip")).alias("ip")).agg(F.count(F.lit(1)).alias("n"), tagged)


@query("j2_j3_mapping_and_relative_address", "SELECT mapping_id, ip, module_id, rel FROM v_modules")
def modules(v):
    return resolve.to_module(v.by_address, v.maps)


@query("j3_narrowest_mapping", "SELECT ip, mapping_id, module_id, rel FROM v_rel_narrowest WHERE rel IS NOT NULL")
def narrowest(v):
    ips = v.by_address.select("ip").union(v.by_address.select(A.untagged(F.col("ip"))))
    rel = A.relative(F.col("ip"), F.col("start"), F.col("end"), F.col("load_bias"), F.col("offset"))
    return resolve.narrowest_mapping(ips, v.maps).select("ip", "mapping_id", "module_id", rel.alias("rel")).filter("rel IS NOT NULL")


@query("j4_module_match", """
    SELECT m.module_id, s.candidate_path, count(*) AS addresses FROM v_modules m LEFT JOIN v_matches s USING (module_id) GROUP BY 1, 2""")
def module_match(v):
    placed = resolve.with_symbol_file(resolve.to_module(v.by_address, v.maps), v.matches)
    return placed.groupBy("module_id", "candidate_path").agg(F.count(F.lit(1)).alias("addresses"))


@query("j5_symbol_file_match", "SELECT module_id, runtime_path, candidate_path, quality, has_debug_info FROM v_symbol_files")
def symbol_files(v):
    return resolve.match_symbol_files(v.modules, v.candidates)


@query("j6_symbol_names", """
    SELECT a.module_id, a.rel, CASE WHEN s.size = 0 OR a.rel < s.address + s.size THEN s.name END AS name
    FROM (SELECT DISTINCT module_id, rel FROM v_modules WHERE rel IS NOT NULL) a
    ASOF LEFT JOIN v_symbols s ON s.module_id = a.module_id AND a.rel >= s.address""")
def symbol_names(v):
    placed = resolve.to_module(v.by_address, v.maps).filter("rel IS NOT NULL")
    return resolve.symbol_names(placed, v.symbols)


@query("j7_source_lines_of_addresses", """
    SELECT mapping_id, ip, module_id, rel, file, line, function FROM v_placed WHERE file IS NOT NULL""")
def address_lines(v):
    return v.pmu_placed.filter("file IS NOT NULL").select("mapping_id", "ip", "module_id", "rel", "file", "line", "function")


_KNOWN = "SELECT DISTINCT '/src/d' || (doc_id % 10) || '/f' || doc_id || '.cpp' AS path FROM documents"


@query("j8_source_paths", f"""
    WITH raw AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN '/src/d' || (p_partkey % 10) || '/f' || p_partkey || '.cpp'
            WHEN 1 THEN '/build/d' || (p_partkey % 10) || '/f' || p_partkey || '.cpp'
            WHEN 2 THEN 'd' || (p_partkey % 10) || '/f' || p_partkey || '.cpp'
            ELSE 'gone/f' || p_partkey || '.cpp' END AS raw_file, p_partkey % 4 AS form, p_partkey AS p FROM part),
    known AS ({_KNOWN})
    SELECT raw_file, coalesce(k.path, raw_file) AS file FROM raw LEFT JOIN known k ON k.path = '/src/d' || (p % 10) || '/f' || p || '.cpp'""")
def source_paths(v):
    raw = v.table("part").selectExpr("""
        CASE p_partkey % 4 WHEN 0 THEN concat('/src/d', p_partkey % 10, '/f', p_partkey, '.cpp')
            WHEN 1 THEN concat('/build/d', p_partkey % 10, '/f', p_partkey, '.cpp')
            WHEN 2 THEN concat('d', p_partkey % 10, '/f', p_partkey, '.cpp') ELSE concat('gone/f', p_partkey, '.cpp') END AS raw_file""")
    known = v.documents.select(F.col("file").alias("path"))
    return resolve.resolve_source_paths(raw, known, ["/src"], [("/build", "/src")])


@query("j9_lines_with_source", """
    SELECT coalesce(s.file, c.file) AS file, coalesce(s.line, c.line)::INTEGER AS line, coalesce(s.code, '') AS code,
        coalesce(c.sample_count, 0)::BIGINT AS sample_count
    FROM v_source s FULL JOIN v_counter_rows c ON c.file = s.file AND c.line = s.line""")
def lines_with_source(v):
    rows = lines.counter_rows(lines.counters_by_line(v.by_address, v.pmu_placed))
    return lines.with_source(rows, v.source).select(
        "file", "line", "code", F.coalesce("sample_count", F.lit(0)).alias("sample_count"))


@query("j10_counter_and_sampling_lines", """
    SELECT file, line, sum(p)::BIGINT AS pmu_samples, sum(s)::BIGINT AS spe_samples FROM (
        SELECT file, line, sample_count AS p, 0 AS s FROM v_counter_rows
        UNION ALL SELECT file, line, 0, count(*) FROM v_spe JOIN v_placed USING (mapping_id, ip) WHERE file IS NOT NULL GROUP BY file, line)
    GROUP BY file, line""")
def both_lanes(v):
    pmu = lines.counter_rows(lines.counters_by_line(v.by_address, v.pmu_placed)).select(
        "file", "line", F.col("sample_count").alias("p"), F.lit(0).alias("s"))
    spe = lines.spe_counters_by_line(sampling.by_address(v.spe), v.spe_placed).select(
        "file", "line", F.lit(0).alias("p"), F.col("sample_count").alias("s"))
    return pmu.unionByName(spe).groupBy("file", "line").agg(F.sum("p").alias("pmu_samples"), F.sum("s").alias("spe_samples"))


@query("j14_q7_unresolved_addresses", """
    SELECT mapping_id, ip, 'Unresolved PMU sample mapping=' || mapping_id || ' ip=0x' || lower(to_hex(ip)) AS warning
    FROM v_placed WHERE file IS NULL""")
def unresolved(v):
    return resolve.unresolved(v.pmu_placed, "PMU")


@query("m1_counters_by_line", f"SELECT file, line, event_key, {ADDRESS_SUMS} FROM v_by_line")
def counters_by_line(v):
    return lines.counters_by_line(v.by_address, v.pmu_placed)


@query("m1_p23_line_names_and_ids", """
    WITH ids AS (SELECT file, line, array_to_string(list_sort(list(DISTINCT cpu)), ',') AS cpu,
            array_to_string(list_sort(list(DISTINCT tid)), ',') AS thread
        FROM v_hits JOIN v_placed USING (mapping_id, ip) WHERE file IS NOT NULL GROUP BY file, line)
    SELECT file, line, coalesce(first(function ORDER BY mapping_id, ip) FILTER (function <> ''), '') AS function,
        coalesce(first(module_id ORDER BY mapping_id, ip), '') AS module, any_value(cpu) AS cpu, any_value(thread) AS thread
    FROM v_placed JOIN ids USING (file, line) GROUP BY file, line""")
def line_names(v):
    names = lines.line_names(v.pmu_placed.withColumn("lane", F.lit(0)))
    return names.join(lines.line_ids(counters.ids_by_address(v.samples), v.pmu_placed), ["file", "line"])


@query("m2_m3_line_weights", "SELECT file, line, sample_count, self_weight, accumulated_weight FROM v_counter_rows")
def line_weights(v):
    return lines.counter_rows(lines.counters_by_line(v.by_address, v.pmu_placed)).drop("event_samples")


@query("m4_event_support", """
    SELECT k.event_key, coalesce(s.supported, false) AS supported FROM (SELECT DISTINCT p_brand AS event_key FROM part UNION SELECT DISTINCT p_type FROM part) k
    LEFT JOIN (SELECT p_brand AS event_key, bool_or(CASE WHEN p_size % 3 = 0 THEN true ELSE p_partkey % 1000 < 2 AND p_size > 25 END) AS supported
        FROM part GROUP BY 1) s USING (event_key)""")
def event_support(v):
    part = v.table("part")
    keys = part.select(F.col("p_brand").alias("event_key")).union(part.select("p_type")).distinct()
    return lines.event_support(v.support, keys)


@query("m5_dense_supported_counts", """
    SELECT file, line, k.event_key, coalesce(b.self_samples + b.acc_samples, 0)::BIGINT AS samples
    FROM (SELECT DISTINCT file, line FROM v_by_line) l
    JOIN (SELECT event_key FROM v_catalog WHERE event_key <> 'branch_mispredict' UNION ALL SELECT 'l2d_cache_access') k ON true
    LEFT JOIN v_by_line b USING (file, line, event_key)""")
def dense_counts(v):
    # The catalog plus one supported event that no sample carries.
    keys = v.catalog.select("event_key").union(v.spark.range(1).select(F.lit("l2d_cache_access")))
    support = keys.withColumn("supported", F.col("event_key") != "branch_mispredict")
    return lines.dense_counts(lines.counters_by_line(v.by_address, v.pmu_placed), support)


def _metric_columns(rows):
    """Metric map as ``key`` and ``key_state`` columns."""
    keys = [*PLAN.raw_keys, "cpi", "l1d_cache_hit_rate", "l2d_cache_hit_rate", "branch_miss_rate", "mpki", "mips", "mcps"]
    out = []
    for key in keys:
        metric = F.col("pmu_values")[key]
        out += [r6(metric["value"]).alias(key), metric["state"].alias(f"{key}_state")]
    return rows.select("file", "line", *out)


def _ratio(key, column):
    return f"round(CASE WHEN sample_count > 0 THEN {column} / sample_count ELSE 0 END, 6) AS {key}, 'number' AS {key}_state"


def _quotient(key, top, bottom):
    return (f"CASE WHEN {bottom} > 0 THEN round({top} / {bottom}, 6) END AS {key}, "
            f"CASE WHEN {bottom} > 0 THEN 'number' ELSE 'undefined' END AS {key}_state")


@query("m6_m7_line_metrics", f"""
    SELECT file, line, {_ratio('cpu_cycles', 'n_cycles')}, {_ratio('inst_retired', 'n_inst')},
        {_ratio('l1d_cache_access', 'n_access')}, {_ratio('l1d_cache_refill', 'n_refill')}, {_ratio('branch_retired', 'n_branch')},
        NULL::DOUBLE AS branch_mispredict, 'missing' AS branch_mispredict_state,
        {_quotient('cpi', 'n_cycles', 'n_inst')}, {_quotient('l1d_cache_hit_rate', 'greatest(n_access - n_refill, 0)', 'n_access')},
        NULL::DOUBLE AS l2d_cache_hit_rate, 'missing' AS l2d_cache_hit_rate_state,
        NULL::DOUBLE AS branch_miss_rate, 'missing' AS branch_miss_rate_state,
        {_quotient('mpki', 'n_refill * 1000', 'n_inst')},
        round(n_inst / 2.0 / 1e6, 6) AS mips, 'number' AS mips_state, round(n_cycles / 2.0 / 1e6, 6) AS mcps, 'number' AS mcps_state
    FROM v_counter_rows""")
def line_metrics(v):
    rows = lines.counter_rows(lines.counters_by_line(v.by_address, v.pmu_placed))
    return _metric_columns(rows.withColumn("pmu_values", lines.pmu_values(F.col("event_samples"), F.col("sample_count"), PLAN)))


@query("m8_effective_seconds", """
    SELECT CASE WHEN max(time_running_ns) > 0 THEN max(time_running_ns) / 1e9 END AS seconds FROM v_runs""")
def effective_seconds(v):
    duration = v.manifest.agg(F.max("duration_ms").alias("d"))
    return duration.select(lines.effective_seconds(v.runs, F.col("d")).alias("seconds"))


@query("m9_cycles_by_cpu", """
    SELECT cpu, round(sum(CASE WHEN scaled_count > 0 THEN scaled_count ELSE raw_count END), 6)::DOUBLE AS cycles FROM v_runs
    WHERE event_key = 'cpu_cycles' GROUP BY cpu""")
def cycles_by_cpu(v):
    return rounded(lines.cycles_by_cpu(v.runs))


@query("m10_sampling_period", """
    SELECT greatest(1000, coalesce(max(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 30 END), 0), 1)::DOUBLE AS period FROM supplier""")
def sampling_period(v):
    devices = v.table("supplier").selectExpr("if(s_suppkey % 3 = 0, NULL, s_suppkey * 30) AS min_interval")
    requested = v.manifest.agg(F.max("sample_period").alias("requested"))
    return requested.select(lines.sampling_period(F.col("requested"), devices).alias("period"))


# --- finished line rows ----------------------------------------------------------

_LINE_ROWS = """
    SELECT coalesce(s.file, c.file) AS file, coalesce(s.line, c.line)::INTEGER AS line, coalesce(s.code, '') AS code,
        coalesce(n.function, '') AS function, coalesce(n.module, '') AS module, coalesce(i.cpu, '') AS cpu, coalesce(i.thread, '') AS thread,
        coalesce(c.sample_count, 0)::BIGINT AS sample_count, coalesce(c.self_weight, 0)::DOUBLE AS self_weight,
        coalesce(c.accumulated_weight, 0)::DOUBLE AS accumulated_weight,
        coalesce(c.n_cycles, 0) AS n_cycles, coalesce(c.n_inst, 0) AS n_inst, coalesce(c.n_access, 0) AS n_access,
        coalesce(c.n_refill, 0) AS n_refill, coalesce(c.n_branch, 0) AS n_branch
    FROM v_source s FULL JOIN v_counter_rows c ON c.file = s.file AND c.line = s.line
    LEFT JOIN (SELECT file, line, coalesce(first(function ORDER BY mapping_id, ip) FILTER (function <> ''), '') AS function,
        first(module_id ORDER BY mapping_id, ip) AS module FROM v_placed WHERE file IS NOT NULL GROUP BY file, line) n
        ON n.file = c.file AND n.line = c.line
    LEFT JOIN (SELECT file, line, array_to_string(list_sort(list(DISTINCT cpu)), ',') AS cpu, array_to_string(list_sort(list(DISTINCT tid)), ',') AS thread
        FROM v_hits JOIN v_placed USING (mapping_id, ip) WHERE file IS NOT NULL GROUP BY file, line) i ON i.file = c.file AND i.line = c.line"""
# Derived metrics lack branch and cache inputs, so every row has a missing one; rows without
# instructions or accesses have undefined ratios.
_STATUS = """
    CASE WHEN n_cycles + n_inst + n_access + n_refill + n_branch > 0 THEN 'NonZero|' ELSE '' END || 'Missing'
    || CASE WHEN n_inst = 0 OR n_access = 0 THEN '|Undefined' ELSE '' END"""
LINES_SQL = f"""
    WITH base AS ({_LINE_ROWS}), marked AS (SELECT *, {_STATUS} AS status FROM base),
    pct AS (
        SELECT *, self_weight / nullif(sum(self_weight) OVER (), 0) * 100 AS p, accumulated_weight / nullif(sum(accumulated_weight) OVER (), 0) * 100 AS ap,
            self_weight / nullif(sum(self_weight) OVER (PARTITION BY file), 0) * 100 AS fp,
            accumulated_weight / nullif(sum(accumulated_weight) OVER (PARTITION BY file), 0) * 100 AS fap FROM marked),
    line_rows AS (
        SELECT * EXCLUDE (p, ap, fp, fap), coalesce(p, 0) AS p_pct, coalesce(ap, 0) AS acc_p_pct, coalesce(fp, 0) AS file_p_pct,
            coalesce(fap, 0) AS file_acc_p_pct FROM pct)"""


def counter_lines(v):
    """Line rows of the counter lane alone."""
    return line_rows(Profile(v.samples, v.maps, v.matches, v.line_table, v.source), PLAN)


@query("m20_line_percentages", LINES_SQL + """
    SELECT file, line, status, sample_count, self_weight, accumulated_weight, round(p_pct, 6) AS p_pct, round(acc_p_pct, 6) AS acc_p_pct,
        round(file_p_pct, 6) AS file_p_pct, round(file_acc_p_pct, 6) AS file_acc_p_pct FROM line_rows""")
def line_percentages(v):
    return rounded(counter_lines(v).select(
        "file", "line", "status", "sample_count", "self_weight", "accumulated_weight", "p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct"))


@query("m21_file_summary", LINES_SQL + """
    SELECT file, sum(self_weight)::DOUBLE AS self_weight, sum(accumulated_weight)::DOUBLE AS accumulated_weight,
        count(*) FILTER (status LIKE '%NonZero%') AS sample_count, count(*) FILTER (status LIKE '%NonZero%') AS hot_lines,
        count(*) FILTER (status LIKE '%Missing%') AS missing, count(*) FILTER (status LIKE '%Unresolved%') AS unresolved,
        coalesce(max(line) FILTER (status LIKE '%NonZero%'), min(line)) AS hot_line FROM line_rows GROUP BY file""")
def file_summary(v):
    return lines.summarize_files(counter_lines(v))


FUNCTIONS_SQL = LINES_SQL + """
    SELECT file, CASE WHEN function = '' THEN '<unknown>' ELSE function END AS function, min(line) AS line_start, max(line) AS line_end,
        first(module ORDER BY line) AS module, sum(self_weight)::DOUBLE AS self_weight, sum(accumulated_weight)::DOUBLE AS accumulated_weight,
        count(*) FILTER (status LIKE '%NonZero%') AS sample_count,
        coalesce(string_agg(line::VARCHAR, ', ' ORDER BY line) FILTER (status LIKE '%NonZero%'), '') AS hot_lines
    FROM line_rows GROUP BY ALL"""


@query("m22_function_summary", FUNCTIONS_SQL)
def function_summary(v):
    return lines.summarize_functions(counter_lines(v))


_LINE_METRICS = """
    metrics AS (
        SELECT *, CASE WHEN sample_count > 0 THEN (n_cycles + n_inst + n_access + n_refill + n_branch) / sample_count ELSE 0 END
            + CASE WHEN n_inst > 0 THEN n_cycles / n_inst + n_refill * 1000 / n_inst ELSE 0 END
            + CASE WHEN n_access > 0 THEN greatest(n_access - n_refill, 0) / n_access ELSE 0 END
            + n_inst / 2e6 + n_cycles / 2e6 AS total FROM line_rows)"""


@query("m23_typed_file_summary", LINES_SQL + "," + _LINE_METRICS + """
    SELECT file, round(sum(total), 6) AS total_self_weight, count(*) FILTER (total > 0) AS nonzero_line_count,
        count(*) FILTER (total > 0) AS sample_count, 0::BIGINT AS unresolved_count, (4 * count(*))::BIGINT AS missing_metric_count
    FROM metrics GROUP BY file""")
def typed_files(v):
    return rounded(lines.typed_file_summary(counter_lines(v)))


@query("m24_typed_function_summary", LINES_SQL + "," + _LINE_METRICS + """
    SELECT file, function, min(line) AS line_start, max(line) AS line_end, first(module ORDER BY line) AS module,
        round(coalesce(sum(total) FILTER (total > 0), 0), 6) AS self_weight, count(*) FILTER (total > 0) AS sample_count,
        coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (total > 0), '') AS hot_lines
    FROM metrics GROUP BY file, function""")
def typed_functions(v):
    rows = lines.typed_function_summary(counter_lines(v))
    return rounded(rows.withColumn("hot_lines", F.array_join(F.col("hot_lines").cast("array<string>"), ",")))


def _share(column):
    return number_text(f"CASE WHEN sample_count > 0 THEN {column} / sample_count ELSE 0 END")


def _or_undefined(bottom, value):
    return f"CASE WHEN {bottom} = 0 THEN 'Undefined' ELSE {number_text(value)} END"


TEXTS_SQL = f"""
    texts AS (
        SELECT *, {_or_undefined("n_inst", "n_cycles / n_inst")} AS cpi, {_or_undefined("n_inst", "n_refill / n_inst * 1000")} AS mpki,
            {_or_undefined("n_access", "greatest(n_access - n_refill, 0) / n_access")} AS hit,
            {number_text("n_inst / 2e0 / 1e6")} AS mips, {number_text("n_cycles / 2e0 / 1e6")} AS mcps, {_share("n_branch")} AS branch,
            {_share("n_cycles")} AS cycles, {_share("n_inst")} AS inst, {_share("n_access")} AS access, {_share("n_refill")} AS refill
        FROM line_rows)"""


DETAIL_SQL = """'branch_mispredict=Missing; branch_miss_rate=Missing; branch_retired=' || branch || '; cpi=' || cpi
        || '; cpu_cycles=' || cycles || '; inst_retired=' || inst || '; l1d_cache_access=' || access || '; l1d_cache_hit_rate=' || hit
        || '; l1d_cache_refill=' || refill || '; l2d_cache_hit_rate=Missing; l3d_cache_hit_rate=Missing; mcps=' || mcps || '; mips=' || mips
        || '; mpki=' || mpki"""


@query("p19_p20_row_status_and_detail", LINES_SQL + "," + TEXTS_SQL + f"""
    SELECT file, line, status, {DETAIL_SQL} AS detail FROM texts""")
def status_and_detail(v):
    return counter_lines(v).select("file", "line", "status", "detail")


@query("p4_metric_texts", LINES_SQL + """
    SELECT file, line, CASE WHEN n_inst = 0 THEN 'Undefined' WHEN n_cycles % n_inst = 0 THEN printf('%.0f', n_cycles / n_inst) ELSE printf('%.6f', n_cycles / n_inst) END AS cpi,
        'Missing' AS branch_miss_rate, '0' AS absent FROM line_rows""")
def metric_texts(v):
    metric = lambda key: M.metric_text(F.try_element_at("pmu_values", F.lit(key))).alias(key)
    return counter_lines(v).select("file", "line", metric("cpi"), metric("branch_miss_rate"), metric("absent"))


@query("p21_status_flags", LINES_SQL + """
    SELECT file, line, CASE WHEN n_branch + n_inst > 0 THEN 'missing|nonzero' || CASE WHEN n_inst = 0 OR n_access = 0 THEN '|undefined' ELSE '' END
        ELSE 'missing|undefined' || CASE WHEN n_cycles + n_access + n_refill > 0 THEN '|nonzero' ELSE '' END END AS flags FROM line_rows""")
def status_flags(v):
    maps = [F.col("pmu_values"), F.col("spe_values")]
    return counter_lines(v).select("file", "line", F.array_join(M.status_flags(maps), "|").alias("flags"))


# --- stacks as text -----------------------------------------------------------------

_NAMED = f"""
    named AS (
        SELECT k.ip, coalesce(n.mapping_id, 0) AS mapping_id, coalesce(n.module_id, '<unknown>') AS module, coalesce(n.rel, k.ip) AS relative_address,
            coalesce(CASE WHEN s.size = 0 OR n.rel < s.address + s.size THEN s.name END, '') AS function
        FROM (SELECT DISTINCT ip FROM v_hits) k LEFT JOIN (SELECT * FROM v_rel_narrowest WHERE rel IS NOT NULL) n ON n.ip = k.ip
        ASOF LEFT JOIN v_symbols s ON s.module_id = n.module_id AND n.rel >= s.address),
    labels AS (
        SELECT ip, CASE WHEN function = '' THEN module || '+0x' || lower(to_hex(relative_address)) ELSE function || ' (' || module || ')' END AS label FROM named)"""


FRAMES_SQL = f"""
    WITH {_NAMED.strip()},
    w AS (SELECT CASE WHEN own THEN 'self' ELSE 'callchain' END AS role, ip, event_key, sum(period)::BIGINT AS w, count(*) AS n FROM v_hits GROUP BY ALL),
    g AS (SELECT role, ip, sum(n)::BIGINT AS sample_count, sum(CASE WHEN role = 'self' THEN w ELSE 0 END)::DOUBLE AS self_weight,
        sum(CASE WHEN role = 'self' THEN 0 ELSE w END)::DOUBLE AS accumulated_weight, string_agg(event_key || '=' || w, ', ' ORDER BY event_key) AS event_weights
        FROM w GROUP BY role, ip),
    ids AS (SELECT CASE WHEN own THEN 'self' ELSE 'callchain' END AS role, ip, array_to_string(list_sort(list(DISTINCT cpu)), ',') AS cpu,
        array_to_string(list_sort(list(DISTINCT tid)), ',') AS thread FROM v_hits GROUP BY 1, 2)
    SELECT role, module, function, ip, relative_address, mapping_id, cpu, thread, sample_count, self_weight, accumulated_weight,
        round(self_weight / sum(self_weight) OVER () * 100, 6) AS p_pct, round(accumulated_weight / sum(accumulated_weight) OVER () * 100, 6) AS acc_p_pct,
        event_weights, CASE WHEN function = '' THEN 'UnresolvedSymbol' ELSE 'Symbol' END AS status
    FROM g JOIN ids USING (role, ip) JOIN named USING (ip)"""


@query("m26_frames", FRAMES_SQL)
def frames(v):
    return rounded(stack_text.frames(v.samples, v.maps, v.symbols))


@query("p16_frame_labels", f"WITH {_NAMED.strip()} SELECT ip, label FROM labels")
def frame_labels(v):
    named = resolve.to_named_module(counters.address_hits(v.samples), v.maps, v.symbols)
    return named.select("ip", A.frame_label(F.col("module"), F.col("function"), F.col("relative_address")).alias("label"))


CHAINS_SQL = f"""
    WITH {_NAMED.strip()},
    ips AS (SELECT list_prepend(ip, callchain) AS ips, event_key, cpu, tid, period FROM v_pmu),
    texts AS (SELECT ips, string_agg(label, ' <- ' ORDER BY i) AS stack, first(label ORDER BY i) AS leaf, last(label ORDER BY i) AS root
        FROM (SELECT ips, ips[i] AS ip, i FROM (SELECT ips, unnest(range(1, len(ips) + 1)) AS i FROM (SELECT DISTINCT ips FROM ips))) JOIN labels USING (ip) GROUP BY ips),
    e AS (SELECT stack, min(leaf) AS leaf, min(root) AS root, event_key, sum(period)::BIGINT AS w, count(*) AS n FROM ips JOIN texts USING (ips) GROUP BY stack, event_key),
    ids AS (SELECT stack, array_to_string(list_sort(list(DISTINCT cpu)), ',') AS cpu, array_to_string(list_sort(list(DISTINCT tid)), ',') AS thread
        FROM ips JOIN texts USING (ips) GROUP BY stack)
    SELECT stack, min(leaf) AS leaf, min(root) AS root, any_value(cpu) AS cpu, any_value(thread) AS thread, sum(n)::BIGINT AS sample_count,
        sum(w)::DOUBLE AS weight, round(sum(w) / (SELECT sum(period) FROM v_pmu) * 100, 6) AS p_pct, string_agg(event_key || '=' || w, ', ' ORDER BY event_key) AS event_weights
    FROM e JOIN ids USING (stack) GROUP BY stack"""


@query("m27_p24_callchains", CHAINS_SQL)
def callchains(v):
    rows = stack_text.callchains(v.samples, v.maps, v.symbols)
    return rounded(rows.select("stack", "leaf", "root", "cpu", "thread", "sample_count", "weight", "p_pct", "event_weights"))


@query("p13_module_predicates", """
    SELECT module_id, runtime_path, regexp_matches(module_id, '\\.jar$') OR regexp_matches(runtime_path, '^/system/') AS os_module,
        regexp_matches(module_id, '\\.so$') AND regexp_matches(runtime_path, '^/data/(app|local/tmp)/') AS app_native,
        regexp_matches(module_id, '\\.so$') AND regexp_matches(runtime_path, '^/data/(app|local/tmp)/') AS warns FROM v_mods""")
def module_predicates(v):
    name, path = F.col("module_id"), F.col("runtime_path")
    return v.modules.select("module_id", "runtime_path", P.is_os_module(name, path).alias("os_module"),
                            P.is_app_native_module(name, path).alias("app_native"), P.warns_without_symbols(name, path).alias("warns"))

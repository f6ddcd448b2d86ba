"""Queries: instruction sampling, latency distributions and instruction classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumaprof.functions import classify as C
from lumaprof.functions import metric_value as M
from lumaprof.functions import text as X
from lumaprof.functions.names import BREAKDOWN_METRICS, CATEGORY_METRICS, DIMENSION_NAMES
from lumaprof.operators import latency as L
from lumaprof.operators import lines, resolve, sampling, views
from lumaprof.plans.adapters import PLAN
from lumaprof.plans.registry import query, r6, rounded
from lumaprof.plans.sql_views import stats_sql
from lumaprof.sinks import render
from lumaprof.sources import source_text

CYCLES, PERIOD = PLAN.baseline.cpu_cycles, PLAN.baseline.period


# --- classification ------------------------------------------------------------

@query("p8_spe_categories", "SELECT category, count(*) AS n, count(latency) AS with_latency FROM v_spe GROUP BY category")
def categories(v):
    return sampling.with_category(v.spe).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count("latency").alias("with_latency"))


@query("p9_hierarchy_children", "SELECT category, child, count(*) AS n FROM v_spe GROUP BY category, child")
def children(v):
    return v.spe_base.groupBy("category", "child").agg(F.sum("cnt").alias("n"))


@query("p10_instruction_words", "SELECT DISTINCT word, class, kind FROM v_instructions")
def words(v):
    return v.words.select("word").distinct().select("word", C.word_class(F.col("word")).alias("c")).select("word", "c.*")


_MNEMONICS = ("dmb", "msr", "aesd", "pmull2", "b.eq", "tbnz", "prfm", "casal", "ldxr", "ldapr", "stlrh", "ldr", "ldrsw", "ldur", "ldp",
              "str", "stp", "fmul", "scvtf", "add", "mov", "mystery", "ldaxr", "ldnp", "ldtr", "sub")
_OPERANDS = ("x0, [x1]", "v0.4s, v1.4s", "{v0.4s}, [x2]", "w3, label", "q1, [sp]", "")


@query("p11_p12_mnemonics", f"""
    WITH i AS (SELECT {list(_MNEMONICS)}[p_partkey % {len(_MNEMONICS)} + 1] AS mn, {list(_OPERANDS)}[p_size % {len(_OPERANDS)} + 1] AS ops, p_partkey FROM part),
    b AS (SELECT *, split_part(mn, '.', 1) AS base, regexp_matches(ops, '^ *\\{{* *[vqdshb]') AS vec FROM i)
    SELECT mn, ops, CASE WHEN base = 'dmb' THEN 'barrier_or_sync' WHEN base = 'msr' THEN 'system_instruction'
            WHEN base IN ('aesd', 'pmull2') THEN 'compute_crypto' WHEN base IN ('b', 'tbnz') THEN 'branch' WHEN base = 'prfm' THEN 'prefetch'
            WHEN base IN ('casal', 'ldxr') THEN 'atomic' WHEN base IN ('ldapr', 'stlrh') THEN 'acquire_release'
            WHEN base IN ('ldr', 'ldrsw', 'ldur', 'ldp') THEN CASE WHEN vec THEN 'vector_load' ELSE 'scalar_load' END
            WHEN base IN ('str', 'stp') THEN CASE WHEN vec THEN 'vector_store' ELSE 'scalar_store' END
            WHEN base IN ('fmul', 'scvtf') OR vec THEN 'compute_fp_simd' WHEN base IN ('add', 'mov', 'sub') THEN 'compute_int'
            ELSE 'unknown_instruction' END AS class,
        CASE WHEN base = 'prfm' THEN 'load_prefetch' WHEN base IN ('ldxr', 'ldaxr') THEN 'load_atomic_exclusive' WHEN base = 'ldapr' THEN 'load_acquire'
            WHEN base = 'ldrsw' THEN 'load_sign_extend' WHEN base IN ('ldp', 'ldnp') THEN CASE WHEN vec THEN 'load_vector_pair' ELSE 'load_scalar_pair' END
            WHEN base IN ('ldr', 'ldur') THEN CASE WHEN ops NOT LIKE '%[%' THEN 'load_literal' WHEN vec THEN 'load_vector_single' ELSE 'load_scalar_single' END
            WHEN base LIKE 'ld%' THEN 'load_unknown' END AS kind, count(*) AS n
    FROM b GROUP BY ALL""")
def mnemonics(v):
    pick = lambda items, index: F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))
    rows = v.table("part").select(pick(_MNEMONICS, F.col("p_partkey") % len(_MNEMONICS)).alias("mn"),
                                  pick(_OPERANDS, F.col("p_size") % len(_OPERANDS)).alias("ops"))
    return rows.groupBy("mn", "ops").agg(F.count(F.lit(1)).alias("n")).select(
        "mn", "ops", C.mnemonic_class(F.col("mn"), F.col("ops")).alias("class"),
        C.mnemonic_load_kind(F.col("mn"), F.col("ops")).alias("kind"), "n")


def _dimension_sql(dimension, column):
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(DIMENSION_NAMES[dimension]))
    return f"""SELECT d.ordinal::INTEGER AS ordinal, d.name, '{dimension}' AS dimension, count(s.{column}) AS n
        FROM (VALUES {values}) d(ordinal, name) LEFT JOIN v_spe s ON s.{column} = d.name GROUP BY ALL"""


@query("p36_name_dimensions", " UNION ALL ".join(_dimension_sql(d, d) for d in DIMENSION_NAMES))
def dimensions(v):
    def one(dimension):
        counts = v.spe_base.groupBy(F.col(dimension).alias("name")).agg(F.sum("cnt").alias("n"))
        return sampling.dimension(v.spark, dimension).join(counts, "name", "left").select(
            "ordinal", "name", F.lit(dimension).alias("dimension"), F.coalesce("n", F.lit(0)).alias("n"))

    return one("category").unionByName(one("class")).unionByName(one("kind"))


# --- aggregates by address --------------------------------------------------------

@query("a3_sampling_by_address", """
    SELECT mapping_id, ip, count(*) AS sample_count, coalesce(sum(latency), 0)::BIGINT AS latency_sum, count(latency) AS latency_count,
        count(*) FILTER (cache_result = 1) AS cache_hits, count(*) FILTER (cache_result = 2) AS cache_misses,
        count(*) FILTER (branch_result = 1) AS branch_correct, count(*) FILTER (branch_result = 2) AS branch_mispredict,
        bit_or(operation_flags) AS operation_flags_or, bit_or(event_flags) AS event_flags_or,
        count(*) FILTER (decode_status <> 0) AS decode_error_count FROM v_spe GROUP BY mapping_id, ip""")
def sampling_by_address(v):
    return sampling.by_address(v.spe)


@query("a3_data_sources_by_address", """
    SELECT mapping_id, ip, data_source, count(*) AS cnt FROM v_spe WHERE data_source <> 0 GROUP BY mapping_id, ip, data_source""")
def data_sources(v):
    return sampling.data_sources_by_address(v.spe)


def _by_address_and_cpu(dimension):
    return f"""
        SELECT mapping_id, ip, cpu, {dimension} AS name, latency, sum(cnt)::BIGINT AS cnt, false AS all_cpus FROM v_spe_freq
        WHERE {dimension} IS NOT NULL GROUP BY mapping_id, ip, cpu, {dimension}, latency
        UNION ALL SELECT mapping_id, ip, NULL, {dimension}, latency, sum(cnt)::BIGINT, true FROM v_spe_freq
        WHERE {dimension} IS NOT NULL GROUP BY mapping_id, ip, {dimension}, latency"""


def _address_query(name, dimension):
    @query(name, _by_address_and_cpu(dimension))
    def plan(v):
        rows = sampling.address_and_cpu_frequency(v.spe_base, dimension)
        return rows.withColumn("all_cpus", F.col("all_cpus") == 1)

    return plan


_address_query("a4_categories_by_address_and_cpu", "category")
_address_query("a6_classes_by_address_and_cpu", "class")
_address_query("a7_load_kinds_by_address_and_cpu", "kind")


def _hierarchy_sql(keys):
    return f"""SELECT {keys}, category, child, latency, sum(cnt)::BIGINT AS cnt FROM v_spe_freq GROUP BY {keys}, category, child, latency
        UNION ALL SELECT {keys}, category, NULL, latency, sum(cnt)::BIGINT FROM v_spe_freq GROUP BY {keys}, category, latency"""


@query("a5_hierarchy_by_address_and_cpu", _hierarchy_sql("mapping_id, ip, cpu"))
def hierarchy_by_address(v):
    return sampling.hierarchy_frequency(v.spe_base, ["mapping_id", "ip", "cpu"])


@query("a9_hierarchy_by_cpu", _hierarchy_sql("cpu"))
def hierarchy_by_cpu(v):
    return sampling.hierarchy_frequency(v.spe_base, ["cpu"])


@query("a8_fused_frequency", "SELECT mapping_id, ip, cpu, category, class, kind, child, latency, cnt FROM v_spe_freq")
def fused(v):
    return v.spe_base


# --- latency ------------------------------------------------------------------------

_BY_CATEGORY = "freq AS (SELECT category, class, latency, sum(cnt)::BIGINT AS cnt FROM v_spe_freq GROUP BY category, class, latency)"


@query("l0_latency_frequency", f"WITH {_BY_CATEGORY} SELECT category, class, latency, cnt FROM freq")
def frequency(v):
    return v.spe_base.groupBy("category", "class", "latency").agg(F.sum("cnt").alias("cnt"))


def _stats_with(freq, keys):
    """``stats_sql`` with its own views moved behind the frequency view."""
    return f"WITH {freq},\n{stats_sql('freq', keys).strip()[4:].strip()}"


def _rounded_stats(sql):
    return sql.replace("CASE WHEN t.latency_count > 0 THEN t.latency_sum / t.latency_count END AS avg_latency_cycles",
                       "round(CASE WHEN t.latency_count > 0 THEN t.latency_sum / t.latency_count END, 6) AS avg_latency_cycles").replace(
        "CASE WHEN t.latency_count > 0 THEN sqrt(", "CASE WHEN t.latency_count > 0 THEN round(sqrt(").replace(
        "* (t.latency_sum / t.latency_count))) END AS std", "* (t.latency_sum / t.latency_count))), 6) END AS std")


@query("l1_l2_l3_latency_statistics", _rounded_stats(_stats_with(_BY_CATEGORY, "category, class")))
def statistics(v):
    return rounded(L.statistics(L.merge(v.spe_base, ["category", "class"]), ["category", "class"]))


@query("l1_l2_l3_latency_by_address", _rounded_stats(_stats_with(
    "freq AS (SELECT mapping_id, ip, latency, sum(cnt)::BIGINT AS cnt FROM v_spe_freq GROUP BY mapping_id, ip, latency)", "mapping_id, ip")))
def statistics_by_address(v):
    return rounded(L.statistics(L.merge(v.spe_base, ["mapping_id", "ip"]), ["mapping_id", "ip"]))


@query("l4_latency_histogram", """
    WITH freq AS (SELECT cpu, category, latency, sum(cnt)::BIGINT AS cnt FROM v_spe_freq WHERE latency IS NOT NULL GROUP BY ALL),
    g AS (SELECT cpu, category, sum(cnt)::BIGINT AS count, min(latency) AS lo, max(latency) AS hi FROM freq GROUP BY cpu, category),
    w AS (SELECT *, CASE WHEN lo = hi THEN 1 ELSE least(count, 20) END AS b FROM g),
    x AS (SELECT *, ceil((hi - lo + 1) / b)::BIGINT AS width FROM w),
    f AS (SELECT cpu, category, least((latency - lo) // width, b - 1) AS bin, sum(cnt)::BIGINT AS n FROM freq JOIN x USING (cpu, category) GROUP BY ALL)
    SELECT x.cpu, x.category, x.count, lo AS min_latency_cycles, hi AS max_latency_cycles, i.bin::INTEGER AS bin, lo + i.bin * width AS start_latency_cycles,
        least(lo + i.bin * width + width - 1, hi) AS end_latency_cycles, coalesce(f.n, 0)::BIGINT AS bin_count
    FROM x, LATERAL (SELECT unnest(range(0, b)) AS bin) i LEFT JOIN f ON f.cpu = x.cpu AND f.category = x.category AND f.bin = i.bin""")
def histogram(v):
    return L.histogram(L.merge(v.spe_base, ["cpu", "category"]), ["cpu", "category"])


# --- line metrics ---------------------------------------------------------------------

def _number(value):
    return ("CASE WHEN sample_count > 0 AND latency_count = 0 THEN 'missing' ELSE 'number' END",
            f"CASE WHEN sample_count > 0 AND latency_count = 0 THEN NULL ELSE round(coalesce({value}, 0), 6) END")


def _pct(part, whole):
    return f"(CASE WHEN {whole} > 0 THEN {part} / {whole} * 100 ELSE 0 END)"


def _time(cycles, whole, period):
    missing = "sample_count > 0 AND latency_count = 0"
    return (f"CASE WHEN {missing} THEN 'missing' WHEN {whole} <= 0 THEN 'undefined' ELSE 'number' END",
            f"CASE WHEN {missing} OR {whole} <= 0 THEN NULL ELSE round({cycles} * {period} / {whole} * 100, 6) END")


def _latency_pairs(whole, period):
    pairs = [(f"{p}_latency_cycles", *_number(f"{p}_latency_cycles")) for p in ("min", "max", "avg", "std", "p95", "p99")]
    pairs += [(f"over_{t}_est_time_pct", *_time(f"over_{t}_sum", "latency_sum", "1e0")) for t in ("p95", "avg")]
    pairs += [(f"over_{t}_all_est_time_pct", *_time(f"over_{t}_sum", whole, period)) for t in ("p95", "avg")]
    return pairs


def _long_sql(keys, pairs, source):
    rows = ", ".join(f"{{'metric': '{m}', 'state': {s}, 'value': ({x})::DOUBLE}}" for m, s, x in pairs)
    return f"SELECT {keys}, unnest([{rows}], recursive := true) FROM {source}"


def line_metric_sql(dimension):
    freq = f"""freq AS (SELECT file, line, {dimension} AS name, latency, sum(cnt)::BIGINT AS cnt FROM v_spe_freq JOIN v_placed USING (mapping_id, ip)
        WHERE file IS NOT NULL AND {dimension} IS NOT NULL GROUP BY ALL)"""
    pairs = [("sample_count", "'number'", "sample_count"),
             ("sample_pct", "'number'", "round(sample_count / (SELECT sum(cnt) FROM freq) * 100, 6)"),
             ("spe_latency_pct", *_number(_pct("latency_sum", "(SELECT sum(cnt * latency) FROM freq)"))),
             ("est_time_pct", *_time("latency_sum", f"{CYCLES!r}::DOUBLE", f"{PERIOD!r}::DOUBLE")),
             *_latency_pairs(f"{CYCLES!r}::DOUBLE", f"{PERIOD!r}::DOUBLE")]
    return f"WITH {freq}, stats AS ({stats_sql('freq', 'file, line, name')}) " + _long_sql("file, line, name", pairs, "stats")


def _flat(long, keys):
    return long.select(*keys, "metric", "value.state", r6("value.value").alias("value"))


def _line_query(name, dimension):
    @query(name, line_metric_sql(dimension))
    def plan(v):
        freq = lines.frequency_by_line(v.spe_base, v.spe_placed, dimension)
        return _flat(sampling.line_metrics(freq, PLAN.baseline), ["file", "line", "name"])

    return plan


_line_query("m12_line_category_metrics", "category")
_line_query("m13_line_class_metrics", "class")
_line_query("m14_line_load_kind_metrics", "kind")


@query("m0_attributed_totals", """
    SELECT d.dimension, sum(cnt)::BIGINT AS samples, coalesce(sum(latency * cnt), 0)::BIGINT AS cycles FROM (
        SELECT 'category' AS dimension, file, latency, cnt FROM v_spe_freq JOIN v_placed USING (mapping_id, ip)
        UNION ALL SELECT 'class', file, latency, cnt FROM v_spe_freq JOIN v_placed USING (mapping_id, ip)
        UNION ALL SELECT 'kind', file, latency, cnt FROM v_spe_freq JOIN v_placed USING (mapping_id, ip) WHERE kind IS NOT NULL) d
    WHERE file IS NOT NULL GROUP BY d.dimension""")
def totals(v):
    def one(dimension):
        freq = lines.frequency_by_line(v.spe_base, v.spe_placed, dimension)
        return freq.agg(F.sum("cnt").alias("samples"), F.coalesce(F.sum(F.col("latency") * F.col("cnt")), F.lit(0)).alias("cycles")).select(
            F.lit(dimension).alias("dimension"), "samples", "cycles")

    return one("category").unionByName(one("class")).unionByName(one("kind"))


@query("m11_line_sampling_metrics", """
    SELECT file, line, count(*)::DOUBLE AS spe_sample_count, round(avg(latency), 6) AS spe_latency_cycles_avg,
        round(count(*) FILTER (cache_result = 1) / nullif(count(*) FILTER (cache_result IN (1, 2)), 0), 6) AS spe_cache_hit_rate,
        round(count(*) FILTER (branch_result = 2) / nullif(count(*) FILTER (branch_result IN (1, 2)), 0), 6) AS spe_branch_miss_rate,
        count(*) FILTER (decode_status <> 0)::DOUBLE AS spe_decode_errors
    FROM v_spe JOIN v_placed USING (mapping_id, ip) WHERE file IS NOT NULL GROUP BY file, line""")
def line_sampling(v):
    rows = lines.spe_line_values(lines.spe_counters_by_line(sampling.by_address(v.spe), v.spe_placed))
    return rows.select("file", "line", *[r6(F.col(c)["value"]).alias(c) for c in rows.columns if c not in ("file", "line")])


# --- per cpu ------------------------------------------------------------------------------

def _cpu_sql(dimension, with_count):
    freq = f"freq AS (SELECT cpu, {dimension} AS name, latency, sum(cnt)::BIGINT AS cnt FROM v_spe_freq WHERE {dimension} IS NOT NULL GROUP BY ALL)"
    whole = "cpu_cycles"
    share = _number(_pct("latency_sum", whole))
    pairs = ([("sample_count", "'number'", "sample_count")] if with_count else []) + [
        ("sample_pct", "'number'", "round(sample_count / cpu_samples * 100, 6)"), ("spe_latency_pct", *share), ("est_time_pct", *share),
        *_latency_pairs(whole, "1e0")]
    return f"""WITH {freq}, stats AS ({stats_sql('freq', 'cpu, name')}),
        t AS (SELECT cpu, sum(cnt) AS cpu_samples, coalesce(sum(latency * cnt), 0) AS cpu_cycles FROM freq GROUP BY cpu),
        s AS (SELECT * FROM stats JOIN t USING (cpu)) """ + _long_sql("cpu, name", pairs, "s")


def _cpu_frequency(v, dimension):
    rows = v.spe_base.filter(F.col(dimension).isNotNull()).withColumnRenamed(dimension, "name")
    return L.merge(rows, ["cpu", "name"])


def _cpu_query(name, dimension, with_count):
    @query(name, _cpu_sql(dimension, with_count))
    def plan(v):
        return _flat(sampling.cpu_metrics(_cpu_frequency(v, dimension), with_count), ["cpu", "name"])

    return plan


_cpu_query("m15_cpu_categories", "category", False)
_cpu_query("m16_cpu_instruction_classes", "class", True)
_cpu_query("m17_cpu_load_kinds", "kind", True)


def breakdown_of(v):
    return sampling.breakdown(sampling.hierarchy_frequency(v.spe_base, ["cpu"]))


_BREAKDOWN_PAIRS = [
    ("sample_pct", "'number'", "round(sample_count / own_samples * 100, 6)"),
    ("est_time_pct", *_number(_pct("latency_sum", "own_cycles"))),
    ("all_est_time_pct", *_number(_pct("latency_sum", "cpu_cycles"))), *_latency_pairs("cpu_cycles", "1e0")]
_BREAKDOWN = f"""
    WITH freq AS ({_hierarchy_sql("cpu")}), stats AS ({stats_sql('freq', 'cpu, category, child')}),
    t AS (SELECT cpu, sum(sample_count) AS cpu_samples, sum(latency_sum) AS cpu_cycles FROM stats WHERE child IS NULL GROUP BY cpu),
    p AS (SELECT cpu, category, sample_count AS p_samples, latency_sum AS p_cycles FROM stats WHERE child IS NULL),
    s AS (SELECT stats.*, cpu_cycles, CASE WHEN child IS NULL THEN cpu_samples ELSE p_samples END AS own_samples,
        CASE WHEN child IS NULL THEN cpu_cycles ELSE p_cycles END AS own_cycles FROM stats JOIN t USING (cpu) JOIN p USING (cpu, category))"""


@query("m18_breakdown", _BREAKDOWN + " SELECT cpu, category, child, " + ", ".join(
    f"{state} AS {m}_state, ({value})::DOUBLE AS {m}" for m, state, value in _BREAKDOWN_PAIRS) + " FROM s")
def breakdown(v):
    columns = []
    for m in BREAKDOWN_METRICS:
        columns += [F.col(m)["state"].alias(f"{m}_state"), r6(F.col(m)["value"]).alias(m)]
    return breakdown_of(v).select("cpu", "category", "child", *columns)


_ORDINALS = ("ordinals AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(DIMENSION_NAMES["category"]))
             + ") c(category, category_ordinal)), child_ordinals AS (SELECT * FROM (VALUES "
             + ", ".join(f"('{n}', {i})" for i, n in enumerate(DIMENSION_NAMES["class"])) + ") c(child, child_ordinal))")
_SHOWN = " OR ".join(f"coalesce({m}, 0) <> 0" for m in BREAKDOWN_METRICS)


@query("m19_breakdown_rows", _BREAKDOWN + ", rows_ AS (SELECT cpu, category, child, " + ", ".join(
    f"({value})::DOUBLE AS {m}" for m, _, value in _BREAKDOWN_PAIRS) + f""" FROM s), {_ORDINALS}
    SELECT cpu, category, coalesce(child, '') AS child, CASE WHEN child IS NULL THEN 'parent' ELSE 'child' END AS level,
        category_ordinal::INTEGER AS category_ordinal, coalesce(child_ordinal, -1)::INTEGER AS child_ordinal
    FROM rows_ JOIN ordinals USING (category) LEFT JOIN child_ordinals USING (child) WHERE {_SHOWN}""")
def breakdown_rows(v):
    return sampling.breakdown_rows(breakdown_of(v)).select("cpu", "category", "child", "level", "category_ordinal", "child_ordinal")


_SHEET_HEADERS = render.BREAKDOWN_HEADERS


@query("k10_breakdown_sheet", _BREAKDOWN + ", rows_ AS (SELECT cpu, category, child, " + ", ".join(
    f"{state} AS {m}_state, ({value})::DOUBLE AS {m}" for m, state, value in _BREAKDOWN_PAIRS) + f""" FROM s), {_ORDINALS}
    SELECT cpu AS "CPU", category AS "Parent", coalesce(child, '') AS "Child", CASE WHEN child IS NULL THEN 'parent' ELSE 'child' END AS "Level", """ + ", ".join(
    f"CASE {m}_state WHEN 'number' THEN round({m}, 3) END AS \"{h}\"" for m, h in _SHEET_HEADERS.items()) + f"""
    FROM rows_ JOIN ordinals USING (category) LEFT JOIN child_ordinals USING (child) WHERE {_SHOWN}""")
def breakdown_sheet(v):
    """The sheet's rows; printed numbers are read back and compared to three decimals."""
    sheet = render.breakdown_sheet(sampling.breakdown_rows(breakdown_of(v)))
    return sheet.select("CPU", "Parent", "Child", "Level", *[
        F.round(F.col(f"`{h}`").try_cast("double"), 3).alias(h) for h in _SHEET_HEADERS.values()])


def _summary(metric):
    digits = "'%.0f'" if metric.startswith(("min_", "max_")) else f"CASE WHEN abs({metric}) >= 1000 THEN '%.0f' ELSE '%.3f' END"
    text = f"printf({digits}, {metric})" + (" || '%'" if metric.endswith("_pct") else "")
    return f"CASE {metric}_state WHEN 'number' THEN {text} WHEN 'missing' THEN 'Missing' ELSE 'N/A' END AS {metric}"


@query("m19_p5_breakdown_display", _BREAKDOWN + ", rows_ AS (SELECT cpu, category, child, " + ", ".join(
    f"{state} AS {m}_state, ({value.replace(', 6)', ', 9)')})::DOUBLE AS {m}" for m, state, value in _BREAKDOWN_PAIRS) + """ FROM s),
    texts AS (SELECT cpu, category, coalesce(child, '') AS child, """ + ", ".join(_summary(m) for m in BREAKDOWN_METRICS) + f""" FROM rows_),
    shown AS (SELECT * FROM texts WHERE """ + " OR ".join(f"coalesce(try_cast(rtrim({m}, '%') AS DOUBLE), 0) <> 0" for m in BREAKDOWN_METRICS) + """)
    SELECT * FROM shown WHERE EXISTS (SELECT 1 FROM shown p WHERE p.cpu = shown.cpu AND p.category = shown.category AND p.child = '')""")
def breakdown_display(v):
    return sampling.breakdown_rows(breakdown_of(v), display=True).drop("level", "category_ordinal", "child_ordinal")


@query("t13_breakdown_order", _BREAKDOWN + f""", rows_ AS (SELECT cpu, category, child, (sample_count / own_samples * 100) AS sample_pct FROM s), {_ORDINALS},
    parents AS (SELECT cpu, category, sample_pct AS k FROM rows_ WHERE child IS NULL)
    SELECT row_number() OVER (ORDER BY round(k, 6) DESC NULLS FIRST, cpu DESC, category_ordinal DESC, child IS NOT NULL, coalesce(child_ordinal, -1)) AS position,
        cpu, category, coalesce(child, '') AS child
    FROM rows_ JOIN parents USING (cpu, category) JOIN ordinals USING (category) LEFT JOIN child_ordinals USING (child)""")
def breakdown_order(v):
    rows, order = views.breakdown_order(sampling.breakdown_rows(breakdown_of(v)), "sample_pct")
    # A breakdown has at most cpus x 44 x 16 rows, so one task can number them.
    return rows.select(F.row_number().over(Window.orderBy(*order)).alias("position"), "cpu", "category", "child")


_WIDE = ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in CATEGORY_METRICS)


def _sheet_query(name, dimension):
    sql = f"SELECT * FROM (SELECT cpu, name, {_WIDE} FROM (" + _cpu_sql(dimension, True) + ") GROUP BY cpu, name) WHERE "

    @query(name, sql + " OR ".join(f"coalesce({m}, 0) <> 0" for m in CATEGORY_METRICS))
    def plan(v):
        long = sampling.cpu_metrics(_cpu_frequency(v, dimension), True)
        wide = render.per_cpu_sheet(long, CATEGORY_METRICS)
        return wide.select("cpu", "name", *[r6(F.col(m)["value"]).alias(m) for m in CATEGORY_METRICS])

    return plan


_sheet_query("k10_cpu_sheet_load_kinds", "kind")
_sheet_query("k10_cpu_sheet_classes", "class")


@query("m25_metric_summary", "WITH long AS (" + line_metric_sql("category") + """),
    g AS (SELECT name || '.' || metric AS key, sum(value) AS s, count(value) AS n, bool_or(state = 'unresolved') AS u, bool_or(state = 'missing') AS m,
            bool_or(state = 'undefined') AS d FROM long WHERE NOT (state = 'number' AND value = 0) GROUP BY 1),
    t AS (SELECT key, CASE WHEN n > 0 THEN CASE WHEN key LIKE '%min_latency_cycles' OR key LIKE '%max_latency_cycles' THEN printf('%.0f', s)
            ELSE printf(CASE WHEN abs(s) >= 1000 THEN '%.0f' ELSE '%.3f' END, s) || CASE WHEN key LIKE '%\\_pct' ESCAPE '\\' THEN '%' ELSE '' END END
        WHEN u THEN 'Unresolved' WHEN m THEN 'Missing' WHEN d THEN 'N/A' ELSE '0' END AS summary FROM g)
    SELECT key, summary, NOT (summary IN ('Unresolved', 'Missing', 'N/A') OR coalesce(TRY_CAST(rtrim(summary, '%') AS DOUBLE) = 0, false)) AS shown FROM t""")
def metric_summary(v):
    freq = lines.frequency_by_line(v.spe_base, v.spe_placed, "category")
    long = sampling.line_metrics(freq, PLAN.baseline).select(F.concat("name", F.lit("."), "metric").alias("key"), "value")
    rounded_value = F.col("value").withField("value", F.round("value.value", 6))
    kept = long.withColumn("value", rounded_value).filter(~((F.col("value.state") == "number") & (F.col("value.value") == 0)))
    summary = lines.metric_summary(kept).select("key", "summary")
    shown = lines.shown_metrics(summary).select("key", F.lit(True).alias("shown"))
    return summary.join(shown, "key", "left").withColumn("shown", F.coalesce("shown", F.lit(False)))


# --- instruction lookup -----------------------------------------------------------------------

_RESOLVED = "(SELECT DISTINCT module_id, rel FROM v_modules WHERE rel IS NOT NULL)"


@query("j11_address_instruction_classes", """
    SELECT mapping_id, ip, i.word IS NOT NULL AS found, coalesce(i.class, 'unknown_instruction') AS class, i.kind
    FROM v_modules m LEFT JOIN v_instructions i ON i.module_id = m.module_id AND i.address = m.rel""")
def address_classes(v):
    addresses = v.by_address.select("mapping_id", "ip").distinct()
    classes = sampling.address_classes(addresses, v.maps, v.matches, v.instructions).withColumn("found", F.lit(True))
    rows = sampling.classified(addresses.withColumn("category", F.lit("load_l1")), classes)
    return rows.select("mapping_id", "ip", F.coalesce("found", F.lit(False)).alias("found"), "class", "kind")


@query("s9_instruction_words", f"""
    SELECT a.module_id, a.rel, CASE a.rel % 64 WHEN 0 THEN w WHEN 4 THEN w ELSE {0xEFBEADDE} END AS word FROM {_RESOLVED} a
    JOIN (SELECT 'mod' || (p_partkey % 3) AS module_id, p_partkey * 64 AS address, p_partkey * 2654435761 % 4294967296 AS w FROM part) s
        ON s.module_id = a.module_id AND a.rel >= s.address AND a.rel + 4 <= s.address + CASE WHEN w % 2 = 0 THEN 12 ELSE 6 END""")
def section_words(v):
    placed = resolve.to_module(v.by_address, v.maps).filter("rel IS NOT NULL")
    return resolve.instruction_words(placed, v.sections)


def _listing(v):
    """Disassembly text of the parts: an address, machine code tokens, mnemonic and operands."""
    pick = lambda items, index: F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))
    text = F.concat(F.lit("  "), F.lower(F.hex(F.col("p_partkey") * 4)), F.lit(": "), F.lit("d503201f "),
                    pick(_MNEMONICS, F.col("p_partkey") % len(_MNEMONICS)), F.lit(" "), pick(_OPERANDS, F.col("p_size") % len(_OPERANDS)))
    header = F.concat(F.lit("section "), F.col("p_brand"))
    return v.table("part").select(
        F.concat(F.lit("mod"), F.col("p_partkey") % 3).alias("module_id"), F.col("p_partkey").alias("pos"),
        F.when(F.col("p_size") == 50, header).otherwise(text).alias("text"))


_LISTING = f"""
    listing AS (SELECT 'mod' || (p_partkey % 3) AS module_id, p_partkey * 4 AS address, {list(_MNEMONICS)}[p_partkey % {len(_MNEMONICS)} + 1] AS mnemonic,
        {list(_OPERANDS)}[p_size % {len(_OPERANDS)} + 1] AS operands FROM part WHERE p_size <> 50)"""


@query("s10_disassembly", f"WITH {_LISTING.strip()} SELECT module_id, address, mnemonic, operands FROM listing")
def disassembly(v):
    return source_text.disassembly(_listing(v), ["module_id"]).select("module_id", "address", "mnemonic", "operands")


@query("j18_exact_instruction", f"""
    WITH {_LISTING.strip()} SELECT a.module_id, a.rel AS address, l.mnemonic, l.operands FROM {_RESOLVED} a
    LEFT JOIN listing l ON l.module_id = a.module_id AND l.address = a.rel""")
def exact_instruction(v):
    wanted = resolve.to_module(v.by_address, v.maps).filter("rel IS NOT NULL").select("module_id", F.col("rel").alias("address")).distinct()
    return resolve.exact_instruction(wanted, source_text.disassembly(_listing(v), ["module_id"])).select(
        "module_id", "address", "mnemonic", "operands")

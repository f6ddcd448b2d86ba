"""Queries: paged views, printed reports, sinks' tables, session documents and quality checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumaprof.functions import metric_value as M
from lumaprof.functions import paths as P
from lumaprof.functions import text as X
from lumaprof.functions.names import DIMENSION_PREFIX
from lumaprof.functions.address import hex_text
from lumaprof.functions.columns import pmu_columns
from lumaprof.operators import counters, hits, lines, quality, stack_text, views
from lumaprof.operators.views import LineFilter
from lumaprof.plans.adapters import EVENT_KEYS, PLAN, SOURCE_ROOTS
from lumaprof.operators.lookup import dense_ids
from lumaprof.operators.resolve import match_symbol_files
from lumaprof.operators.reuse import Scratch, cut, shared_dir
from lumaprof.plans.line_report import line_rows
from lumaprof.plans.queries_lines import CHAINS_SQL, DETAIL_SQL, FRAMES_SQL, FUNCTIONS_SQL, LINES_SQL, TEXTS_SQL, counter_lines
from lumaprof.plans.queries_sampling import line_metric_sql
from lumaprof.plans.registry import query, r6, rounded
from lumaprof.plans.sql_views import number_text
from lumaprof.sinks import render, report
from lumaprof.sources import bundle, streams
from lumaprof.sources.source_text import numbered_lines

PMU_KEYS = pmu_columns([(k, "pmu") for k in EVENT_KEYS])
_TEXT = {"cpu_cycles": "cycles", "inst_retired": "inst", "l1d_cache_access": "access", "l1d_cache_refill": "refill", "branch_retired": "branch",
         "branch_mispredict": "'Missing'", "cpi": "cpi", "l1d_cache_hit_rate": "hit", "branch_miss_rate": "'Missing'", "mpki": "mpki",
         "mips": "mips", "mcps": "mcps"}
_LINES = LINES_SQL + "," + TEXTS_SQL


def numbered(page, order):
    """Page rows with their position; a page holds at most 10 000 rows."""
    return page.withColumn("position", F.row_number().over(Window.orderBy(*order)))


# --- paged views -----------------------------------------------------------------

_FILTERS = {
    "text": (LineFilter(text="F1"), "file ILIKE '%f1%' OR function ILIKE '%f1%' OR code ILIKE '%f1%'"),
    "cpu": (LineFilter(cpu="3"), "cpu LIKE '%3%'"),
    "thread": (LineFilter(thread="10"), "thread LIKE '%10%'"),
    "min_samples": (LineFilter(min_samples=60), "sample_count >= 60"),
    "nonzero": (LineFilter(nonzero_only=True), "self_weight > 0 OR accumulated_weight > 0"),
    "function": (LineFilter(function_only=True), "function <> '' AND function <> '<unknown>'"),
    "missing": (LineFilter(missing_only=True), "status LIKE '%Missing%'"),
    "unresolved": (LineFilter(unresolved_only=True), "status LIKE '%Unresolved%'"),
    "all_of_them": (LineFilter(text="f1", cpu="1", thread="102", min_samples=50, nonzero_only=True, function_only=True, missing_only=True),
                    "(file ILIKE '%f1%' OR function ILIKE '%f1%' OR code ILIKE '%f1%') AND cpu LIKE '%1%' AND thread LIKE '%102%' AND sample_count >= 50 "
                    "AND (self_weight > 0 OR accumulated_weight > 0) AND function <> '' AND status LIKE '%Missing%'"),
}


@query("t5_line_filters", LINES_SQL + " UNION ALL ".join(
    f" SELECT '{name}' AS option, count(*) AS total FROM line_rows WHERE {test}" for name, (_, test) in _FILTERS.items()))
def line_filters(v):
    # Nine tests read one narrow table; each scans only the columns it asks for.
    read = ["file", "line", "function", "code", "cpu", "thread", "sample_count", "self_weight", "accumulated_weight", "status"]
    rows = Scratch(v.spark, "line-filters").written(counter_lines(v).select(*read), "lines")
    parts = [views.query_lines(rows, option)[0].select(F.lit(name).alias("option"), "total") for name, (option, _) in _FILTERS.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _page_query(name, option, order_sql, where="true"):
    @query(name, f"""{_LINES} SELECT row_number() OVER (ORDER BY {order_sql}, file, line)::INTEGER - {option.offset} AS position, file, line, sample_count, self_weight
        FROM texts WHERE {where} ORDER BY 1 LIMIT {views.page_limit(option.limit)} OFFSET {option.offset}""")
    def plan(v):
        table = report.line_table(counter_lines(v))
        page = views.query_lines(table, option)[1]
        return numbered(page, views.line_order(option)).select("position", "file", "line", "sample_count", "self_weight")

    return plan


_SAMPLED = "CASE WHEN self_weight > 0 OR accumulated_weight > 0 THEN 0 ELSE 1 END"
_NAMED = "CASE WHEN function <> '' AND function <> '<unknown>' THEN 0 ELSE 1 END"
_number = lambda text: f"coalesce(try_cast({text} AS DOUBLE), 0)"
_page_query("t6_t8_page_by_self_weight", LineFilter(sort="self", desc=True, limit=100, offset=20), "self_weight DESC")
_page_query("t6_page_sampled_and_named_first", LineFilter(sort="line", sampled_first=True, function_first=True), f"{_SAMPLED}, {_NAMED}, line")
_page_query("t6_page_by_cpi", LineFilter(sort="cpi", desc=True, limit=300), f"{_number('cpi')} DESC")
_page_query("t6_t7_page_by_counter_metric", LineFilter(sort="inst_retired", desc=True, limit=300, nonzero_only=True), f"{_number('inst')} DESC",
            "self_weight > 0 OR accumulated_weight > 0")
_page_query("t6_page_unknown_key", LineFilter(sort="No Such Key", limit=50, offset=5), "file")


@query("t8_ranked_page", f"""{_LINES} SELECT row_number() OVER (ORDER BY accumulated_weight DESC, file, line)::INTEGER AS position, file, line, accumulated_weight
    FROM texts ORDER BY 1 LIMIT 250 OFFSET 4321""")
def ranked_page(v):
    """A page deep inside of the saved ranking of all lines."""
    order = [F.desc("accumulated_weight"), F.asc("file"), F.asc("line")]
    path = f"{shared_dir(v.spark)}/ranked-{uuid.uuid4().hex}"
    views.save_ranked(counter_lines(v).select("file", "line", "accumulated_weight"), order, path, slice_rows=1000)
    return views.ranked_page(v.spark, path, order, 4321, 250)


_FILES = """, files AS (SELECT file, sum(self_weight)::DOUBLE AS self_weight, sum(accumulated_weight)::DOUBLE AS accumulated_weight,
    count(*) FILTER (status LIKE '%NonZero%') AS hot_lines, count(*) FILTER (status LIKE '%Missing%') AS missing FROM line_rows GROUP BY file)"""


@query("t9_file_page", LINES_SQL + _FILES + """
    SELECT row_number() OVER (ORDER BY hot_lines DESC, accumulated_weight DESC, file)::INTEGER AS position, file, self_weight, accumulated_weight, hot_lines, missing
    FROM files WHERE file ILIKE '%D1/%' ORDER BY 1 LIMIT 40""")
def file_page(v):
    page = views.query_files(lines.summarize_files(counter_lines(v)), text="D1/", sort="hot_lines", limit=40)[1]
    order = [F.desc("hot_lines"), F.desc("accumulated_weight"), F.asc("file")]
    return numbered(page, order).select("position", "file", "self_weight", "accumulated_weight", "hot_lines", "missing")


@query("t10_function_list", LINES_SQL + """, functions AS (
    SELECT file, CASE WHEN function = '' THEN '<unknown>' ELSE function END AS function, sum(self_weight)::DOUBLE AS self_weight,
        sum(accumulated_weight)::DOUBLE AS accumulated_weight FROM line_rows GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY self_weight DESC, accumulated_weight DESC, function, file)::INTEGER AS position, file, function, self_weight, accumulated_weight
    FROM functions""")
def function_list(v):
    rows = views.query_functions(lines.summarize_functions(counter_lines(v)))
    order = [F.desc("self_weight"), F.desc("accumulated_weight"), F.asc("function"), F.asc("file")]
    # The list has no limit, so its positions are given in ranges of the order.
    return dense_ids(rows, order, "_position").select(
        (F.col("_position") + 1).cast("int").alias("position"), "file", "function", "self_weight", "accumulated_weight")


#: Rows that a display of frames and of diagnostics shows.
TOP_FRAMES, DIAGNOSTICS = 200, 80


@query("t11_top_frames", f"""
    {FRAMES_SQL.strip()} ORDER BY self_weight DESC, accumulated_weight DESC, role, module NULLS FIRST, function NULLS FIRST, ip,
        relative_address NULLS FIRST, mapping_id NULLS FIRST LIMIT {TOP_FRAMES}""")
def top_frames(v):
    rows = stack_text.frames(v.samples, v.maps, v.symbols)
    return rounded(views.top(rows, stack_text.frame_order(), TOP_FRAMES))


_WARNINGS = """
    w AS (SELECT session_id, 'PMU Missing: ' || coalesce(pmu_missing_reason, 'unknown') AS warning FROM v_manifest WHERE NOT pmu_available
        UNION ALL SELECT session_id, 'SPE Missing: ' || coalesce(spe_missing_reason, 'unknown') FROM v_manifest WHERE NOT spe_available
        UNION ALL SELECT session_id, 'PMU lost records: ' || pmu_lost_records FROM v_loss WHERE pmu_lost_records > 0
        UNION ALL SELECT session_id, 'SPE decode errors: ' || spe_decode_errors FROM v_loss WHERE spe_decode_errors > 0)"""


@query("t12_first_diagnostics", f"""
    WITH {_WARNINGS.strip()}, n AS (SELECT *, row_number() OVER (ORDER BY session_id, warning) - 1 AS ordinal FROM w)
    SELECT ordinal, warning FROM n WHERE ordinal < {DIAGNOSTICS}
    UNION ALL SELECT NULL, (count(*) - {DIAGNOSTICS}) || ' additional warnings omitted' FROM n HAVING count(*) > {DIAGNOSTICS}""")
def first_diagnostics(v):
    rows = dense_ids(quality.lane_warnings(v.manifest, v.loss), ["session_id", "warning"], "ordinal")
    return views.first_diagnostics(rows, DIAGNOSTICS)


# --- printed reports and sinks -----------------------------------------------------------

_PCT = ", ".join(f"printf('%.6f', {c}) AS {c}" for c in ("p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct"))
_METRIC_TEXTS = ", ".join(f"{_TEXT[k]} AS {k}" for k in PMU_KEYS)


@query("k1_k2_line_rows_as_text", f"""{_LINES}
    SELECT file, line::VARCHAR AS line, function, module, cpu, thread, code, status, {_PCT}, printf('%.0f', self_weight) AS self_weight,
        printf('%.0f', accumulated_weight) AS acc_weight, {_METRIC_TEXTS} FROM texts""")
def line_texts(v):
    return render.line_rows(counter_lines(v), PMU_KEYS, [("pmu_values", k) for k in PMU_KEYS])


@query("k1_sampled_lines", f"{_LINES} SELECT file, line::VARCHAR AS line, status FROM texts WHERE status <> '0'")
def sampled_lines(v):
    return render.line_rows(render.sampled(counter_lines(v)), PMU_KEYS, []).select("file", "line", "status")


@query("k1_file_rows", LINES_SQL + _FILES + """
    SELECT file, printf('%.0f', self_weight) AS self_weight, printf('%.0f', accumulated_weight) AS acc_weight, hot_lines AS sample_count, hot_lines,
        0::BIGINT AS unresolved, missing FROM files""")
def file_texts(v):
    return render.file_rows(lines.summarize_files(counter_lines(v)))


@query("k1_function_rows", f"""
    SELECT function, file, line_start, line_end, module, printf('%.0f', self_weight) AS self_weight, printf('%.0f', accumulated_weight) AS acc_weight,
        sample_count AS samples FROM ({FUNCTIONS_SQL})""")
def function_texts(v):
    return render.function_rows(lines.summarize_functions(counter_lines(v)))


@query("k1_frame_rows", f"""
    SELECT role, module, function, '0x' || lower(to_hex(ip)) AS ip, '0x' || lower(to_hex(relative_address)) AS relative_address, mapping_id, cpu, thread,
        sample_count, printf('%.0f', self_weight) AS self_weight, printf('%.0f', accumulated_weight) AS acc_weight, printf('%.6f', p_pct) AS p_pct,
        printf('%.6f', acc_p_pct) AS acc_p_pct, event_weights, status FROM ({FRAMES_SQL})""")
def frame_texts(v):
    return render.frame_rows(stack_text.frames(v.samples, v.maps, v.symbols))


@query("k1_callchain_rows", f"""
    SELECT stack, leaf, root, cpu, thread, sample_count, printf('%.0f', weight) AS weight, printf('%.6f', p_pct) AS p_pct, event_weights FROM ({CHAINS_SQL})""")
def callchain_texts(v):
    return render.callchain_rows(stack_text.callchains(v.samples, v.maps, v.symbols))


@query("k3_rows_as_json_arrays", f"""{_LINES} SELECT to_json([file, line::VARCHAR, function, module, cpu, thread, status, printf('%.6f', p_pct), cpi, mips])::VARCHAR AS value FROM texts""")
def json_arrays(v):
    printed = render.line_rows(counter_lines(v), PMU_KEYS, [("pmu_values", k) for k in ("cpi", "mips")])
    return report.row_arrays(printed.select("file", "line", "function", "module", "cpu", "thread", "status", "p_pct", "cpi", "mips"))


_JSON = " || ',' || ".join(f"'\"{k}\":\"' || {t} || '\"'" for k, t in sorted({**_TEXT, "l2d_cache_hit_rate": "'Missing'", "l3d_cache_hit_rate": "'Missing'"}.items()))


@query("k4_saved_line_table", f"""{_LINES}
    SELECT file, line, function, module, cpu, thread, status, {DETAIL_SQL} AS detail, sample_count, self_weight, accumulated_weight,
        cpi, hit AS l1d_cache_hit_rate, mips, mcps, '{{' || {_JSON} || '}}' AS pmu_json, '{{}}' AS spe_json FROM texts""")
def saved_lines(v):
    return report.line_table(counter_lines(v)).select(
        "file", "line", "function", "module", "cpu", "thread", "status", "detail", "sample_count", "self_weight", "accumulated_weight",
        "cpi", "l1d_cache_hit_rate", "mips", "mcps", "pmu_json", "spe_json")


@query("k11_numeric_line_rows", f"""{_LINES}
    SELECT file, line, status, self_weight, accumulated_weight AS acc_weight, round(try_cast(cpi AS DOUBLE), 6) AS cpi, round(try_cast(mpki AS DOUBLE), 6) AS mpki,
        NULL::DOUBLE AS branch_miss_rate FROM texts""")
def numeric_lines(v):
    columns = [("pmu_values", k) for k in ("cpi", "mpki", "branch_miss_rate")]
    rows = render.numeric_line_rows(counter_lines(v), columns)
    return rounded(rows.select("file", "line", "status", "self_weight", "acc_weight", "cpi", "mpki", "branch_miss_rate"))


@query("k11_numeric_file_rows", LINES_SQL + _FILES + """
    SELECT file, self_weight, accumulated_weight AS acc_weight, hot_lines AS sample_count, hot_lines, 0::BIGINT AS unresolved, missing FROM files""")
def numeric_files(v):
    return render.numeric_file_rows(lines.summarize_files(counter_lines(v)))


@query("k11_numeric_function_rows", f"""
    SELECT function, file, line_start, line_end, module, self_weight, accumulated_weight AS acc_weight, sample_count AS samples FROM ({FUNCTIONS_SQL})""")
def numeric_functions(v):
    return render.numeric_function_rows(lines.summarize_functions(counter_lines(v)))


@query("k11_numeric_frame_rows", f"""
    SELECT role, module, function, '0x' || lower(to_hex(ip)) AS ip, '0x' || lower(to_hex(relative_address)) AS relative_address, mapping_id, cpu, thread,
        sample_count, self_weight, accumulated_weight AS acc_weight, p_pct, acc_p_pct, event_weights, status FROM ({FRAMES_SQL})""")
def numeric_frames(v):
    return rounded(render.numeric_frame_rows(stack_text.frames(v.samples, v.maps, v.symbols)))


@query("k11_numeric_callchain_rows", CHAINS_SQL)
def numeric_callchains(v):
    return rounded(render.numeric_callchain_rows(stack_text.callchains(v.samples, v.maps, v.symbols)))


_ANNOTATION = ("'// [profile] ' || {count}'p=' || printf('%.6f', p_pct) || '%, acc_p=' || printf('%.6f', acc_p_pct) || '%, file_p=' || printf('%.6f', file_p_pct) "
               "|| '%, file_acc_p=' || printf('%.6f', file_acc_p_pct) || '%, self_weight=' || printf('%.0f', self_weight) || ', acc_weight=' || printf('%.0f', accumulated_weight) "
               "|| ', cpu=' || CASE WHEN cpu = '' THEN 'Missing' ELSE cpu END || ', thread=' || CASE WHEN thread = '' THEN 'Missing' ELSE thread END || ', ' || {metrics} || ', status=' || status")
_QUERY_METRICS = DETAIL_SQL.replace("; ", ", ")
_FILE_METRICS = " || ', ' || ".join(f"'{k}=' || {_TEXT[k]}" for k in PMU_KEYS)
_UNDER = "(file LIKE '/src/d1/%' OR file LIKE '/src/d2/%' OR file LIKE '/src/%')"
TAG = "[profile]"


@query("p18_query_annotations", f"{_LINES} SELECT file, line, {_ANNOTATION.format(count='', metrics=_QUERY_METRICS)} AS annotation FROM texts")
def query_annotations(v):
    rows = counter_lines(v)
    fields = {c: F.col(c) for c in ("p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct", "self_weight", "accumulated_weight", "cpu", "thread", "status")}
    parts = X.query_metric_parts(M.text_map(F.col("pmu_values")), M.text_map(F.col("spe_values")))
    return rows.select("file", "line", X.annotation(fields, parts, TAG).alias("annotation"))


def _annotations(v, roots=SOURCE_ROOTS):
    return cut(report.annotated_rows(counter_lines(v), roots, PMU_KEYS, [], TAG))


_NOTES = (f"notes AS (SELECT file, line, {_ANNOTATION.format(count=chr(39) + 'sample_count=' + chr(39) + ' || sample_count || ' + chr(39) + ', ' + chr(39) + ' || ', metrics=_FILE_METRICS)} AS annotation "
          f"FROM texts WHERE status LIKE '%NonZero%' AND {_UNDER})")
_OUT = ("CASE WHEN file LIKE '/src/d1/%' OR file LIKE '/src/d2/%' THEN substr(file, 9) WHEN file LIKE '/src/%' THEN substr(file, 6) ELSE 'external' || file END")


@query("k6_annotated_source", f"""{_LINES}, {_NOTES}
    SELECT {_OUT} AS path, line, 1 AS kind, code AS text FROM v_source WHERE file IN (SELECT file FROM notes)
    UNION ALL SELECT {_OUT}, line, 0, annotation FROM notes WHERE EXISTS (SELECT 1 FROM v_source s WHERE s.file = notes.file AND s.line = notes.line)""")
def annotated_source(v):
    return report.annotated_lines(v.source, _annotations(v), SOURCE_ROOTS)


@query("k7_annotated_manifest", f"""{_LINES}, {_NOTES}, t AS (SELECT file, count(*) AS total_lines FROM v_source GROUP BY file)
    SELECT file AS original_path, CASE WHEN total_lines IS NOT NULL THEN {_OUT} END AS annotated_path, count(*) AS sampled_lines, total_lines,
        CASE WHEN total_lines IS NULL THEN 'skipped' ELSE 'written' END AS result, CASE WHEN total_lines IS NULL THEN 'source file does not exist on this host' END AS reason
    FROM notes LEFT JOIN t USING (file) GROUP BY ALL""")
def annotated_manifest(v):
    return report.annotated_manifest(_annotations(v), v.source, SOURCE_ROOTS)


@query("k8_annotated_paths", """
    SELECT file, CASE WHEN file LIKE '/src/d3/%' THEN substr(file, 9) ELSE 'external' || file END AS path FROM (SELECT DISTINCT file FROM v_line_table)""")
def annotated_paths(v):
    return v.line_table.select("file").distinct().select("file", report.output_path(F.col("file"), ["/src/d3", "/other"]).alias("path"))


def _capability(v):
    """Nested capability documents: one cpu per supplier with zero to two event details."""
    detail = ("named_struct('event_key', concat('e', i), 'raw_event_name', concat('RAW', i), 'event_source', 'perf', 'type', 'hw', 'config', '0', "
              "'supported', i = 0, 'errno', if(i = 0, NULL, 2), 'failure_reason', if(i = 0, NULL, 'no device'), 'kernel_path', NULL, 'sysfs_path', NULL)")
    flags = ", ".join(f"'{n}', s_suppkey % {i + 2} = 0" for i, n in enumerate(
        ("spe", "cycles", "instructions", "cache", "branch", "callchain", "source_sample_fields")))
    cpu = (f"named_struct('cpu', CAST(s_suppkey AS INT), 'cluster', concat('c', s_suppkey % 2), 'summary', named_struct({flags}), "
           f"'details', transform(sequence(0, CAST(s_suppkey % 3 AS INT)), i -> {detail}), "
           "'spe', if(s_suppkey % 4 = 0, NULL, named_struct('device_path', concat('/dev/spe', s_suppkey))))")
    rows = v.table("supplier").selectExpr("concat('s', s_suppkey) AS session_id", f"array({cpu}) AS cpus")
    # The last detail is dropped, so every third cpu has none.
    trimmed = F.transform("cpus", lambda c: c.withField("details", F.slice(c["details"], F.lit(1), F.size(c["details"]) - 1)))
    return {"capability": rows.withColumn("cpus", trimmed)}


@query("k9_s2_capability_rows", """
    SELECT 's' || s AS session_id, s::INTEGER AS cpu, 'c' || (s % 2) AS cluster, s % 2 = 0 AS spe, s % 3 = 0 AS cycles, 'e' || i AS event_key, i = 0 AS supported,
        CASE WHEN i <> 0 THEN 2 END::INTEGER AS errno, CASE WHEN i IS NULL THEN NULL WHEN i = 0 THEN '' ELSE 'no device' END AS failure_reason,
        CASE WHEN s % 4 = 0 THEN '' ELSE '/dev/spe' || s END AS spe_device
    FROM (SELECT s_suppkey AS s, unnest(CASE WHEN s_suppkey % 3 = 0 THEN [NULL]::BIGINT[] ELSE range(0, s_suppkey % 3) END) AS i FROM supplier)""")
def capability_rows(v):
    return bundle.capability_rows(_capability(v)).select(
        "session_id", "cpu", "cluster", "spe", "cycles", "event_key", "supported", "errno", "failure_reason", "spe_device")


def _catalog_documents(v):
    """Nested event catalogs: one session per supplier, one event per part of its brand group."""
    event = F.struct(F.concat(F.lit("ev"), "p_partkey").alias("event_key"), F.expr(
        "transform(sequence(0, CAST(p_size % 3 AS INT)), i -> named_struct('cpu', CAST(i AS INT), 'supported', i % 2 = 0, 'reason', CAST(NULL AS STRING)))").alias("states"))
    parts = v.table("part").select(F.concat(F.lit("s"), F.expr("p_partkey div 20")).alias("session_id"), "p_partkey", event.alias("e"))
    events = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "e"))), lambda x: F.struct(
        x["e"]["event_key"].alias("event_key"), F.when(x["e"]["states"][0]["supported"] & (F.size(x["e"]["states"]) > 1), x["e"]["states"]).otherwise(
            F.array().cast("array<struct<cpu:int,supported:boolean,reason:string>>")).alias("per_cpu_support")))
    # Twenty events per session.
    return {"event_catalog": parts.groupBy("session_id").agg(events.alias("events"))}


@query("s2_event_support_rows", """
    SELECT 's' || (p_partkey // 20) AS session_id, (p_partkey % 20)::INTEGER AS ordinal, 'ev' || p_partkey AS event_key, i::INTEGER AS cpu, i % 2 = 0 AS supported
    FROM (SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN [NULL]::BIGINT[] ELSE range(0, p_size % 3 + 1) END) AS i FROM part)""")
def event_support_rows(v):
    return bundle.event_support(_catalog_documents(v)).select("session_id", "ordinal", "event_key", "cpu", "supported")


# --- scalar rules ---------------------------------------------------------------------------

def _metrics(v):
    number = M.number(F.col("s_acctbal") * (F.col("s_suppkey") % 3 - 1) + F.lit(0.0))
    value = (F.when(F.col("s_suppkey") % 5 == 0, M.missing("m")).when(F.col("s_suppkey") % 7 == 0, M.unresolved("u"))
             .when(F.col("s_suppkey") % 11 == 0, M.undefined("z")).otherwise(number))
    return v.table("supplier").withColumn("m", value)


_METRIC_STATE = "CASE WHEN s % 5 = 0 THEN 'missing' WHEN s % 7 = 0 THEN 'unresolved' WHEN s % 11 = 0 THEN 'undefined' ELSE 'number' END"
_METRIC_ROWS = f"""m AS (SELECT s, bal, {_METRIC_STATE} AS state, CASE WHEN {_METRIC_STATE} = 'number' THEN bal * (s % 3 - 1) + 0.0 END AS value
    FROM (SELECT s_suppkey AS s, s_acctbal AS bal FROM supplier))"""


@query("p1_metric_classes", f"""
    WITH {_METRIC_ROWS} SELECT s AS s_suppkey, CASE WHEN state <> 'number' THEN state WHEN value = 0 THEN 'zero' ELSE 'nonzero' END AS class, {number_text('value')} AS text FROM m""")
def metric_classes(v):
    return _metrics(v).select("s_suppkey", M.classify(F.col("m")).alias("class"), M.number_text(M.metric_number(F.col("m"))).alias("text"))


@query("p2_p3_metric_constructor", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'missing' WHEN s_suppkey % 3 = 0 THEN 'unresolved' ELSE 'number' END AS state,
        CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' capability is unavailable' WHEN s_suppkey % 3 = 0 THEN s_name || ' samples exist but source attribution failed' END AS reason,
        CASE WHEN s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0 THEN CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_acctbal END END AS value,
        round(CASE WHEN s_nationkey > 0 THEN s_acctbal / s_nationkey * 100 ELSE 0 END, 6) AS pct FROM supplier""")
def metric_constructor(v):
    key = F.col("s_suppkey")
    metric = M.line_metric(F.col("s_name"), key % 2 != 0, key % 3 != 0, F.when(key % 5 != 0, F.col("s_acctbal")))
    return v.table("supplier").select("s_suppkey", metric["state"].alias("state"), metric["reason"].alias("reason"), metric["value"].alias("value"),
                                      r6(M.percent(F.col("s_acctbal"), F.col("s_nationkey"))).alias("pct"))


@query("p22_sparse_metrics", f"WITH {_METRIC_ROWS} SELECT s AS s_suppkey, CASE WHEN state = 'number' AND value = 0 THEN 0 ELSE 1 END::INTEGER AS entries FROM m")
def sparse_metrics(v):
    return _metrics(v).select("s_suppkey", F.size(M.drop_zeros(F.create_map(F.lit("k"), F.col("m")))).alias("entries"))


@query("p5_summary_texts", """
    SELECT s_suppkey, printf(CASE WHEN abs(s_acctbal) >= 1000 THEN '%.0f' ELSE '%.3f' END, s_acctbal) || '%' AS pct,
        printf('%.0f', s_acctbal) AS bound, printf(CASE WHEN abs(s_acctbal) >= 1000 THEN '%.0f' ELSE '%.3f' END, s_acctbal) AS plain FROM supplier""")
def summary_texts(v):
    value = F.col("s_acctbal")
    return v.table("supplier").select("s_suppkey", X.summary_text(F.lit("load_l1.sample_pct"), value).alias("pct"),
                                      X.summary_text(F.lit("load_l1.max_latency_cycles"), value).alias("bound"),
                                      X.summary_text(F.lit("load_l1.sample_count"), value).alias("plain"))


@query("p7_p17_relative_addresses_as_hex", """
    SELECT mapping_id, ip, '0x' || lower(to_hex(ip)) AS ip_text, '0x' || lower(to_hex(rel)) AS rel_text FROM v_modules WHERE rel IS NOT NULL""")
def hex_addresses(v):
    return v.pmu_placed.filter("rel IS NOT NULL").select("mapping_id", "ip", hex_text(F.col("ip")).alias("ip_text"), hex_text(F.col("rel")).alias("rel_text"))


@query("p14_path_remaps", """
    SELECT raw, CASE WHEN raw LIKE 'C:%' THEN '/mnt/c' || CASE WHEN length(raw) > 8 THEN '/' || replace(substr(raw, 9), '\\', '/') ELSE '' END END AS path FROM (
        SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'C:\\work\\' || p_name || '\\f' || p_partkey || '.cpp' ELSE '/x/' || p_name END AS raw FROM part)""")
def path_remaps(v):
    raw = v.table("part").selectExpr(r"if(p_partkey % 2 = 0, concat('C:\\work\\', p_name, '\\f', p_partkey, '.cpp'), concat('/x/', p_name)) AS raw").distinct()
    return raw.select("raw", P.remap(F.col("raw"), F.lit("C:\\work\\"), F.lit("/mnt/c")).alias("path"))


@query("p28_record_time_and_machine", """
    SELECT c_custkey, strftime(make_timestamp(c_custkey * 86461000000), '%Y-%m-%d (%A) %H:%M:%S') AS record_time,
        CASE WHEN c_custkey % 3 = 0 THEN 'arm64' ELSE c_name || ' (' || c_mktsegment || ':x) by ' || c_nationkey || ', arch arm64' END AS machine FROM customer""")
def record_time(v):
    props = F.when(F.col("c_custkey") % 3 != 0, F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_name", "c_mktsegment", F.lit("x"))).otherwise(F.lit("odd"))
    return v.table("customer").select("c_custkey", X.record_time((F.col("c_custkey") * 86461).cast("string"), "UTC").alias("record_time"),
                                      X.machine_type(props, F.lit("arm64")).alias("machine"))


@query("p29_meta_info", """
    SELECT c_custkey, k AS key, v AS value FROM (
        SELECT c_custkey, 'name' AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, 'seg', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'name', 'again' FROM customer WHERE c_custkey % 2 <> 0)""")
def meta_info(v):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws("\u0000", F.lit("name"), "c_name", F.lit("seg"), "c_mktsegment", F.lit("odd"), F.lit(""))).otherwise(
        F.concat_ws("\u0000", F.lit("name"), "c_name", F.lit("seg"), "c_mktsegment", F.lit("name"), F.lit("again"), F.lit("open")))
    rows = v.table("customer").select("c_custkey", F.encode(F.regexp_replace(text, "odd\u0000$", "odd"), "UTF-8").alias("data"))
    return streams.meta_info(rows, ["c_custkey"])


@query("p31_manifest_violations", """
    SELECT session_id, unnest(list_filter([CASE WHEN schema_name <> 'profile_bundle' THEN 'unsupported schema ' || schema_name END,
        CASE WHEN schema_major <> 1 THEN 'unsupported major version ' || schema_major END,
        CASE WHEN pmu_enabled AND pmu_available AND s % 8 <> 0 THEN 'pmu stream is missing' END,
        CASE WHEN spe_available AND s % 3 <> 0 THEN 'spe stream is missing' END], lambda x: x IS NOT NULL)) AS violation FROM v_manifest""")
def manifest_violations(v):
    supplier = v.table("supplier")
    found = supplier.filter("s_suppkey % 8 = 0").selectExpr("concat('s', s_suppkey) AS session_id", "'pmu' AS lane").union(
        supplier.filter("s_suppkey % 3 = 0").selectExpr("concat('s', s_suppkey) AS session_id", "'spe' AS lane"))
    return bundle.manifest_violations(v.manifest, found, "profile_bundle")


@query("p33_escaped_texts", """
    SELECT doc_id, md5(replace(replace(text, '<', '&lt;'), '>', '&gt;')) AS angles,
        md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html FROM documents""")
def escaped_texts(v):
    return v.table("documents").select("doc_id", F.md5(X.escape_angles(F.col("text"))).alias("angles"), F.md5(X.escape_html(F.col("text"))).alias("html"))


@query("p34_p35_paths_and_lanes", """
    SELECT session_id, CASE WHEN s % 2 = 0 THEN '/abs/' || s ELSE '/root/' || session_id || '/src' || s END AS path,
        CASE WHEN pmu_enabled THEN 'enabled' ELSE 'disabled' END || ' / ' || CASE WHEN pmu_available THEN 'available' ELSE 'missing' END AS lane FROM v_manifest""")
def paths_and_lanes(v):
    number = F.substr("session_id", F.lit(2))
    path = F.when(F.col("pmu_enabled"), F.concat(F.lit("/abs/./x/../"), number)).otherwise(F.concat(F.lit("old//../src"), number))
    return v.manifest.select("session_id", P.absolute(F.concat(F.lit("/root/"), "session_id"), path).alias("path"),
                             X.lane_text(F.col("pmu_enabled"), F.col("pmu_available")).alias("lane"))


# --- sources ------------------------------------------------------------------------------------

@query("s6_numbered_source_lines", "SELECT file, line, md5(code) AS code FROM v_source")
def source_lines(v):
    return numbered_lines(v.documents, "file", "text").select("file", "line", F.md5("code").alias("code"))


_EXTENSIONS = ("cpp", "h", "txt", "cc", "cppx", "inl")
_DIRECTORIES = ("src", "Saved", ".git", "annotated_files_2", "a/b", "target/x")


@query("s7_source_file_rules", f"""
    SELECT path, regexp_matches(path, '\\.(c|cc|cpp|cxx|h|hpp|hh|inl)$') AS is_source,
        len(list_intersect(string_split(path, '/'), ['Saved', '.git', 'target'])) > 0 OR path LIKE 'annotated_files%' AS skipped
    FROM (SELECT {list(_DIRECTORIES)}[doc_id % {len(_DIRECTORIES)} + 1] || '/' || source || '/f' || doc_id || '.' || {list(_EXTENSIONS)}[doc_id // 6 % {len(_EXTENSIONS)} + 1] AS path FROM documents)""")
def source_file_rules(v):
    pick = lambda items, index: F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))
    path = F.concat(pick(_DIRECTORIES, F.col("doc_id") % len(_DIRECTORIES)), F.lit("/"), "source", F.lit("/f"), "doc_id", F.lit("."),
                    pick(_EXTENSIONS, F.floor(F.col("doc_id") / 6) % len(_EXTENSIONS)))
    return v.table("documents").select(path.alias("path")).select(
        "path", P.is_source_file(F.col("path")).alias("is_source"), P.in_skipped_directory(F.col("path")).alias("skipped"))


# --- hits -------------------------------------------------------------------------------------------

@query("j15_context_lines", """
    WITH h AS (SELECT function, file, line, sum(self_weight)::BIGINT AS self, sum(acc_weight)::BIGINT AS subtree FROM v_by_address JOIN v_placed USING (mapping_id, ip)
        WHERE file IS NOT NULL GROUP BY function, file, line),
    listed AS (SELECT DISTINCT function, h.file FROM h JOIN v_source s ON s.file = h.file AND s.line = h.line)
    SELECT h.function, s.file, s.line, md5(any_value(s.code)) AS code, sum(CASE WHEN s.line = h.line THEN self ELSE 0 END)::BIGINT AS self,
        sum(CASE WHEN s.line = h.line THEN subtree ELSE 0 END)::BIGINT AS subtree
    FROM h JOIN v_source s ON s.file = h.file AND s.line BETWEEN h.line - 5 AND h.line + 5 JOIN listed l ON l.function = h.function AND l.file = h.file GROUP BY ALL""")
def context_lines(v):
    rows = v.by_address.join(v.pmu_placed.filter("file IS NOT NULL"), ["mapping_id", "ip"]).select(
        "function", "file", "line", F.col("self_weight").alias("self"), F.col("acc_weight").alias("subtree"))
    return hits.context_lines(rows, v.source, ["function"]).select("function", "file", "line", F.md5("code").alias("code"), "self", "subtree")


@query("j16_annotated_disassembly", """
    WITH code AS (SELECT 'mod' || (p_partkey % 3) AS module_id, p_partkey AS pos, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_partkey * 64 END AS address FROM part),
    h AS (SELECT module_id, rel + 8 AS at, sum(self_weight)::BIGINT AS self, sum(acc_weight)::BIGINT AS subtree FROM v_by_address JOIN v_modules USING (mapping_id, ip)
        WHERE rel IS NOT NULL GROUP BY 1, 2),
    placed AS (SELECT c.module_id, c.pos, sum(h.self)::BIGINT AS self, sum(h.subtree)::BIGINT AS subtree FROM h
        ASOF JOIN (SELECT * FROM code WHERE address <> 0) c ON c.module_id = h.module_id AND h.at >= c.address GROUP BY 1, 2)
    SELECT module_id, pos, address, coalesce(self, 0)::BIGINT AS self, coalesce(subtree, 0)::BIGINT AS subtree FROM code LEFT JOIN placed USING (module_id, pos)""")
def annotated_disassembly(v):
    code = v.table("part").selectExpr("concat('mod', p_partkey % 3) AS module_id", "p_partkey AS pos", "if(p_size % 4 = 0, 0L, p_partkey * 64) AS address")
    rows = v.by_address.join(v.pmu_placed.filter("rel IS NOT NULL"), ["mapping_id", "ip"]).groupBy(
        "module_id", (F.col("rel") + 8).alias("address")).agg(F.sum("self_weight").alias("self"), F.sum("acc_weight").alias("subtree"))
    return hits.annotated_disassembly(rows, code, ["module_id"])


# --- quality --------------------------------------------------------------------------------------------

@query("q1_lane_warnings", f"WITH {_WARNINGS.strip()} SELECT session_id, warning FROM w")
def lane_warnings(v):
    return quality.lane_warnings(v.manifest, v.loss)


@query("q2_q3_coverage", """
    WITH t AS (SELECT 's' || l_suppkey AS session_id, list_sort(list(DISTINCT l_orderkey % 3)) AS cpus,
            list_sort(list(DISTINCT event_key) FILTER (event_key IS NOT NULL)) AS events FROM (
            SELECT l_suppkey, l_orderkey, c.event_key FROM lineitem LEFT JOIN v_catalog c ON c.ordinal = CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_linenumber - 1 END) GROUP BY 1)
    SELECT session_id, 'PMU sample CPU coverage is incomplete: selected CPUs [' || array_to_string(list_sort(list_distinct(selected_cpus)), ',')
            || '], observed sample CPUs [' || array_to_string(cpus, ',')
            || ']. If observed CPUs are unexpectedly limited, check recorder PERF_SAMPLE_CPU parsing/capture.' AS warning
        FROM t JOIN v_manifest USING (session_id) WHERE len(list_distinct(selected_cpus)) > 1 AND len(cpus) < len(list_distinct(selected_cpus))
    UNION ALL SELECT session_id, 'PMU samples only contain event(s) [' || coalesce(array_to_string(events, ','), '')
            || ']. Metrics requiring instructions/cache/branch events, such as CPI, MIPS, cache hit rate, and branch miss rate, will be Missing unless those PMU events are captured.'
        FROM t JOIN v_manifest USING (session_id) WHERE coalesce(len(events), 0) <= 1""")
def coverage(v):
    samples = v.table("lineitem").selectExpr("concat('s', l_suppkey) AS session_id", "l_orderkey % 3 AS cpu",
                                             "if(l_suppkey % 2 = 0, 0L, CAST(l_linenumber AS BIGINT) - 1) AS event_key_ref")
    known = counters.with_event_key(samples, v.catalog)
    totals = known.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.collect_set("cpu").alias("cpus"),
        F.collect_set(F.when(F.col("event_key") != "unknown_event", F.col("event_key"))).alias("event_keys"))
    return quality.coverage_warnings(totals, v.manifest.select("session_id", "selected_cpus"))


_NO_FUNCTIONS = quality.NO_FUNCTIONS.replace("'", "''")


@query("q4_attribution", LINES_SQL + f"""
    SELECT '{_NO_FUNCTIONS}' AS warning FROM line_rows HAVING count(*) FILTER (function <> '') = 0
    UNION ALL SELECT '{_NO_FUNCTIONS}' FROM line_rows HAVING count(*) > 0""")
def attribution(v):
    """The real rows, which give no warning, and the same rows without function names."""
    rows = counter_lines(v)
    real = quality.attribution_warnings(rows, has_samples=True)
    nameless = quality.attribution_warnings(rows.withColumn("function", F.lit(" ")), has_samples=True)
    return real.unionByName(nameless)


@query("q5_symbol_file_warnings", """
    SELECT module_id, CASE WHEN quality = 'missing' THEN 'Debug ELF Missing for ' || module_id ELSE 'Debug ELF for ' || module_id || ' matched '
        || coalesce(candidate_path, '<unknown>') || ', but it has no DWARF .debug_line/.debug_info sections. Source Lines cannot be generated from this '
        || 'stripped ELF; use an unstripped device library or enable local program analysis with an unstripped ELF.' END AS warning FROM v_symbol_files
    WHERE module_id LIKE '%.so' AND (runtime_path LIKE '/data/app/%' OR runtime_path LIKE '/data/local/tmp/%') AND (quality = 'missing' OR NOT has_debug_info)""")
def symbol_file_warnings(v):
    return quality.symbol_file_warnings(match_symbol_files(v.modules, v.candidates))


@query("q6_quality_table", """
    SELECT session_id, unnest([
        {'ordinal': 0, 'check': 'PMU capability', 'status': CASE WHEN pmu_available THEN 'OK' ELSE 'Missing' END, 'detail': coalesce(pmu_missing_reason, 'PMU lane accepted')},
        {'ordinal': 1, 'check': 'SPE capability', 'status': CASE WHEN spe_available THEN 'OK' ELSE 'Missing' END, 'detail': coalesce(spe_missing_reason, 'SPE lane accepted')},
        {'ordinal': 2, 'check': 'PMU lost records', 'status': CASE WHEN pmu_lost_records = 0 THEN 'OK' ELSE 'Warning' END, 'detail': pmu_lost_records::VARCHAR},
        {'ordinal': 3, 'check': 'Ring buffer overrun', 'status': CASE WHEN ring_buffer_overruns = 0 THEN 'OK' ELSE 'Warning' END, 'detail': ring_buffer_overruns::VARCHAR},
        {'ordinal': 4, 'check': 'SPE decode errors', 'status': CASE WHEN spe_decode_errors = 0 THEN 'OK' ELSE 'Warning' END, 'detail': spe_decode_errors::VARCHAR},
        {'ordinal': 5, 'check': 'ELF match quality', 'status': 'Pending', 'detail': 'Will be populated by symbol matching stage'},
        {'ordinal': 6, 'check': 'Source attribution rate', 'status': 'Pending', 'detail': 'Will be populated after address-to-line attribution'}], recursive := true)
    FROM v_manifest JOIN v_loss USING (session_id)""")
def quality_table(v):
    return quality.quality_table(v.manifest, v.loss)


@query("q6_overall_quality", """
    SELECT session_id, CASE WHEN pmu_lost_records + ring_buffer_overruns + spe_decode_errors = 0 THEN 'OK' ELSE 'Warning' END AS overall FROM v_loss""")
def overall(v):
    return quality.overall(v.loss)


@query("q8_summary_fields", """
    SELECT session_id, unnest([
        {'ordinal': 0, 'field': 'Session', 'value': session_id}, {'ordinal': 1, 'field': 'Target package', 'value': coalesce(target_package, '')},
        {'ordinal': 2, 'field': 'PID', 'value': coalesce(pid::VARCHAR, 'n/a')}, {'ordinal': 3, 'field': 'Duration ms', 'value': coalesce(duration_ms::VARCHAR, 'partial')},
        {'ordinal': 4, 'field': 'ABI', 'value': 'arm64'}, {'ordinal': 5, 'field': 'Selected CPUs', 'value': array_to_string(selected_cpus, ', ')},
        {'ordinal': 6, 'field': 'Selected clusters', 'value': cluster}, {'ordinal': 7, 'field': 'PMU lane', 'value': 'enabled=' || pmu_enabled || ', available=' || pmu_available},
        {'ordinal': 8, 'field': 'SPE lane', 'value': 'enabled=true, available=' || spe_available}, {'ordinal': 9, 'field': 'PMU buffer pages', 'value': pmu_buffer_pages::VARCHAR},
        {'ordinal': 10, 'field': 'SPE AUX buffer bytes', 'value': coalesce(spe_aux_buffer_bytes::VARCHAR, 'n/a')},
        {'ordinal': 11, 'field': 'Overall quality', 'value': CASE WHEN pmu_lost_records + ring_buffer_overruns + spe_decode_errors = 0 THEN 'OK' ELSE 'Warning' END},
        {'ordinal': 12, 'field': 'HTML report path', 'value': 'r.html'}, {'ordinal': 13, 'field': 'XLSX report path', 'value': 'r.xlsx'}], recursive := true)
    FROM v_manifest JOIN v_loss USING (session_id)""")
def summary_fields(v):
    return quality.summary_fields(v.manifest, v.loss)


@query("q8_session_summary", f"""
    WITH {_WARNINGS.strip()} SELECT session_id, target_package, pid, duration_ms, 'arm64' AS abi, pmu_available, coalesce(n, 0) AS warnings
    FROM v_manifest LEFT JOIN (SELECT session_id, count(*) AS n FROM w GROUP BY session_id) USING (session_id)""")
def session_summary(v):
    rows = report.session_summary(v.manifest, quality.lane_warnings(v.manifest, v.loss))
    return rows.select("session_id", "target_package", "pid", "duration_ms", "device.abi", F.col("pmu_lane.available").alias("pmu_available"),
                       F.size("warnings").cast("bigint").alias("warnings"))


# --- both lanes, end to end -------------------------------------------------------------------------------

@query("line_report_both_lanes", """
    WITH seen AS (SELECT mapping_id, ip, cpu, tid FROM v_hits UNION ALL SELECT mapping_id, ip, cpu, tid FROM v_spe),
    ids AS (SELECT file, line, array_to_string(list_sort(list(DISTINCT cpu)), ',') AS cpu, array_to_string(list_sort(list(DISTINCT tid)), ',') AS thread
        FROM seen JOIN v_placed USING (mapping_id, ip) WHERE file IS NOT NULL GROUP BY file, line),
    lanes AS (SELECT mapping_id, ip, min(lane) AS lane FROM (SELECT mapping_id, ip, 0 AS lane FROM v_hits UNION ALL SELECT mapping_id, ip, 1 FROM v_spe) GROUP BY mapping_id, ip),
    named AS (SELECT file, line, coalesce(first(function ORDER BY lane, mapping_id, ip) FILTER (function <> ''), '') AS function,
            coalesce(first(module_id ORDER BY lane, mapping_id, ip) FILTER (module_id <> ''), '') AS module
        FROM lanes JOIN v_placed USING (mapping_id, ip) WHERE file IS NOT NULL GROUP BY file, line),
    spe AS (SELECT file, line, count(*) AS n, count(*) FILTER (category = 'load_l1') AS loads, count(*) FILTER (class = 'branch') AS branches,
            count(*) FILTER (kind = 'load_literal') AS literals
        FROM v_spe JOIN v_placed USING (mapping_id, ip) WHERE file IS NOT NULL GROUP BY file, line),
    sampled AS (SELECT file, line, ids.cpu, ids.thread, named.function, named.module, coalesce(c.sample_count, 0) AS sample_count,
            coalesce(c.self_weight, 0) AS self_weight, coalesce(c.accumulated_weight, 0) AS accumulated_weight, coalesce(n, 0) AS n,
            coalesce(loads, 0) AS loads, coalesce(branches, 0) AS branches, coalesce(literals, 0) AS literals
        FROM ids LEFT JOIN named USING (file, line) LEFT JOIN v_counter_rows c USING (file, line) LEFT JOIN spe USING (file, line)),
    whole AS (SELECT coalesce(s.file, x.file) AS file, coalesce(s.line, x.line)::INTEGER AS line, coalesce(s.code, '') AS code, coalesce(x.function, '') AS function,
            coalesce(x.module, '') AS module, coalesce(x.cpu, '') AS cpu, coalesce(x.thread, '') AS thread, coalesce(x.sample_count, 0)::BIGINT AS sample_count,
            coalesce(x.self_weight, 0)::DOUBLE AS self_weight, coalesce(x.accumulated_weight, 0)::DOUBLE AS accumulated_weight,
            coalesce(n, 0)::VARCHAR AS spe_sample_count, coalesce(loads, 0)::VARCHAR AS load_l1, coalesce(branches, 0)::VARCHAR AS branch,
            coalesce(literals, 0)::VARCHAR AS load_literal
        FROM v_source s FULL JOIN sampled x ON x.file = s.file AND x.line = s.line)
    SELECT file, line, md5(code) AS code, function, module, cpu, thread, sample_count, self_weight, accumulated_weight, spe_sample_count, load_l1, branch, load_literal,
        round(coalesce(self_weight / nullif(sum(self_weight) OVER (), 0) * 100, 0), 6) AS p_pct,
        round(coalesce(accumulated_weight / nullif(sum(accumulated_weight) OVER (), 0) * 100, 0), 6) AS acc_p_pct,
        round(coalesce(self_weight / nullif(sum(self_weight) OVER (PARTITION BY file), 0) * 100, 0), 6) AS file_p_pct,
        round(coalesce(accumulated_weight / nullif(sum(accumulated_weight) OVER (PARTITION BY file), 0) * 100, 0), 6) AS file_acc_p_pct
    FROM whole""")
def both_lanes(v):
    rows = line_rows(v.profile, PLAN)
    text = lambda column, key, name: M.metric_text(F.try_element_at(column, F.lit(key))).alias(name)
    return rounded(rows.select(
        "file", "line", F.md5("code").alias("code"), "function", "module", "cpu", "thread", "sample_count", "self_weight", "accumulated_weight",
        text("spe_values", "spe_sample_count", "spe_sample_count"), text("spe_values", "load_l1.sample_count", "load_l1"),
        text("instruction_values", "instruction_class.branch.sample_count", "branch"),
        text("load_instruction_values", "load_instruction.load_literal.sample_count", "load_literal"),
        "p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct"))


def _map_sql(dimension, name):
    """Nonzero metrics of one dimension under the keys of the report's map."""
    return f"""SELECT file, line, '{name}' AS map, '{DIMENSION_PREFIX[dimension]}' || name || '.' || metric AS key, state, value
        FROM ({line_metric_sql(dimension)}) WHERE NOT (state = 'number' AND value = 0)"""


@query("line_report_metric_maps", f"""
    WITH spe AS (SELECT file, line, count(*) AS n, avg(latency) AS latency, count(latency) AS timed, count(*) FILTER (cache_result = 1) AS hits,
            count(*) FILTER (cache_result IN (1, 2)) AS cached, count(*) FILTER (branch_result = 2) AS missed,
            count(*) FILTER (branch_result IN (1, 2)) AS branched, count(*) FILTER (decode_status <> 0) AS errors
        FROM v_spe JOIN v_placed USING (mapping_id, ip) WHERE file IS NOT NULL GROUP BY file, line),
    outcome AS (SELECT file, line, 'spe_values' AS map, unnest([
            {{'key': 'spe_sample_count', 'value': n::DOUBLE}}, {{'key': 'spe_latency_cycles_avg', 'value': latency}},
            {{'key': 'spe_cache_hit_rate', 'value': hits / nullif(cached, 0)}}, {{'key': 'spe_branch_miss_rate', 'value': missed / nullif(branched, 0)}},
            {{'key': 'spe_decode_errors', 'value': errors::DOUBLE}}], recursive := true) FROM spe)
    SELECT file, line, map, key, CASE WHEN value IS NULL THEN 'missing' ELSE 'number' END AS state, round(value, 6) AS value FROM outcome WHERE value IS NULL OR value <> 0
    UNION ALL {_map_sql("category", "spe_values")} UNION ALL {_map_sql("class", "instruction_values")}
    UNION ALL {_map_sql("kind", "load_instruction_values")}""")
def metric_maps(v):
    """Every entry of the sampling lane's maps, as the finished lines hold them."""
    rows = line_rows(v.profile, PLAN)
    maps = F.array(*[F.struct(F.lit(m).alias("map"), F.col(m).alias("entries")) for m in ("spe_values", "instruction_values", "load_instruction_values")])
    return rows.select("file", "line", F.inline(maps)).select("file", "line", "map", F.explode("entries").alias("key", "_m")).select(
        "file", "line", "map", "key", F.col("_m.state").alias("state"), r6("_m.value").alias("value"))

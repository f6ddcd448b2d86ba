"""Profile-shaped views of the star schema and event tables.

Every view grows with the table it is built from: one counter sample,
instruction sample and callstack per line item, one mapping per supplier, one
symbol, line entry and instruction word per part, one source file per document
and one timed sample per event.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaprof.functions.classify import word_class
from lumaprof.operators import counters, lines, resolve, sampling
from lumaprof.operators.reuse import cut
from lumaprof.plans.line_report import Profile
from lumaprof.sources.source_text import numbered_lines

TAG = 1 << 62
MAP_STEP, MAP_SIZE, MAPS_PER_REGION = 1280, 960, 20
EVENT_KEYS = ("cpu_cycles", "inst_retired", "l1d_cache_access", "l1d_cache_refill", "branch_retired", "branch_mispredict")
DATA_SOURCES = (0, 8, 9, 10, 11, 12, 13, 14, 15, 65535)
PLAN = lines.CounterPlan(
    raw_keys=EVENT_KEYS, supported={k: k != "branch_mispredict" for k in EVENT_KEYS}, seconds=2.0,
    baseline=sampling.Baseline(1.0e9, 100.0))
SOURCE_ROOTS = ("/src/d1", "/src/d2", "/src")


def source_file(number: str) -> str:
    return f"concat('/src/d', ({number}) % 10, '/f', {number}, '.cpp')"


class Views:
    """Lazily built views over one data directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # --- counter and instruction samples -------------------------------------

    @cached_property
    def _addressed(self) -> DataFrame:
        own = "1 + l_partkey * 64 div 1280"
        columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
        return self.table("lineitem").select(*columns).selectExpr(
            "*", f"l_partkey * 64 + if(l_returnflag = 'R', {TAG}L, 0L) AS ip",
            f"""CASE WHEN l_returnflag = 'N' THEN 0L WHEN l_returnflag = 'A' THEN {own}
                WHEN l_linenumber % 2 = 0 THEN 0L WHEN l_linenumber = 7 THEN 1 + l_suppkey ELSE {own} END AS mapping_id""",
            "l_suppkey % 4 AS cpu", "100 + l_suppkey % 8 AS tid")

    @cached_property
    def pmu(self) -> DataFrame:
        return self._addressed.selectExpr(
            "CAST(l_linenumber AS BIGINT) - 1 AS event_key_ref", "cpu", "tid", "mapping_id", "ip",
            "CAST(l_quantity AS BIGINT) AS period",
            """slice(array(l_partkey div 10 * 64, l_partkey div 100 * 64), 1,
                     CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber >= 5 THEN 1 ELSE 2 END) AS callchain""")

    @cached_property
    def catalog(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(EVENT_KEYS)), "ordinal bigint, event_key string")

    @cached_property
    def samples(self) -> DataFrame:
        return counters.with_event_key(self.pmu, self.catalog)

    @cached_property
    def spe(self) -> DataFrame:
        sources = ", ".join(map(str, DATA_SOURCES))
        return self._addressed.selectExpr(
            "cpu", "tid", "mapping_id", "ip", "CAST(l_suppkey % 16 AS INT) AS operation_flags",
            "l_orderkey % 256 AS event_flags",
            f"element_at(array({sources}), CAST(l_partkey % 10 AS INT) + 1) AS data_source",
            "CAST(l_linenumber % 3 AS INT) AS branch_result", "CAST(l_orderkey % 3 AS INT) AS cache_result",
            "CAST(l_orderkey % 37 = 0 AS INT) AS decode_status",
            "if(l_orderkey % 11 = 0, NULL, CAST(floor(l_extendedprice) AS BIGINT) % 997) AS latency")

    @cached_property
    def instructions(self) -> DataFrame:
        """Classes of the instruction words of all modules."""
        return self.words.select("module_id", "address", word_class(F.col("word")).alias("c")).select("module_id", "address", "c.*")

    @cached_property
    def spe_classes(self) -> DataFrame:
        return cut(sampling.address_classes(self.spe, self.maps, self.matches, self.instructions))

    @cached_property
    def spe_base(self) -> DataFrame:
        return cut(sampling.base_frequency(self.spe, self.spe_classes))

    @cached_property
    def profile(self) -> Profile:
        return Profile(self.samples, self.maps, self.matches, self.line_table, self.source, self.spe, self.spe_classes)

    # --- maps, symbols, lines ------------------------------------------------

    @cached_property
    def maps(self) -> DataFrame:
        supplier = self.table("supplier")
        narrow = supplier.selectExpr(
            "s_suppkey + 1 AS mapping_id", f"s_suppkey * {MAP_STEP} AS start", f"s_suppkey * {MAP_STEP} + {MAP_SIZE} AS end",
            f"s_suppkey * {MAP_STEP} + if(s_suppkey % 2 = 0, 256, 0) AS offset",
            "element_at(array(0L, 2048L, -4096L), CAST(s_suppkey % 3 AS INT) + 1) AS load_bias",
            "concat('mod', s_suppkey % 3) AS module_id", "s_suppkey AS pos")
        wide = supplier.groupBy(F.expr(f"s_suppkey div {MAPS_PER_REGION}").alias("g")).agg(
            F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi")).selectExpr(
            "1000001 + g AS mapping_id", f"lo * {MAP_STEP} AS start", f"hi * {MAP_STEP} + 640 AS end", "0L AS offset",
            "0L AS load_bias", "concat('reg', g % 5) AS module_id", "1000000 + g AS pos")
        return narrow.unionByName(wide)

    @cached_property
    def matches(self) -> DataFrame:
        return self.maps.select("module_id").distinct().selectExpr(
            "module_id", "concat('/data/app/', module_id, '.so') AS runtime_path",
            "if(module_id LIKE 'mod%', concat('/sym/', module_id, '.debug'), NULL) AS candidate_path")

    @cached_property
    def symbols(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('mod', p_partkey % 3) AS module_id", "64 + p_partkey * 64 AS address",
            "CAST(if(p_size % 5 = 0, 0, p_size * 4) AS BIGINT) AS size", "concat(p_name, '#', p_partkey) AS name")

    @cached_property
    def line_table(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('mod', p_partkey % 3) AS module_id", "p_partkey * 64 AS lo", "p_partkey * 64 + 160 AS hi",
            f"{source_file('p_partkey div 4')} AS file", "CAST(p_partkey % 40 AS INT) AS line",
            "if(p_partkey % 7 = 0, NULL, concat('fn_', p_brand)) AS function")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").selectExpr(f"{source_file('doc_id')} AS file", "text")

    @cached_property
    def source(self) -> DataFrame:
        return numbered_lines(self.documents, "file", "text")

    @cached_property
    def words(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('mod', p_partkey % 3) AS module_id", "p_partkey * 64 AS address",
            "p_partkey * 2654435761 % 4294967296 AS word")

    @cached_property
    def sections(self) -> DataFrame:
        """Executable sections of 12 bytes: two words and 4 bytes that the declared size may cut."""
        little = " || ".join(f"substr(w, {i}, 2)" for i in (7, 5, 3, 1))
        return self.words.selectExpr("*", "lpad(hex(word), 8, '0') AS w").selectExpr(
            "module_id", "address", "CAST(if(word % 2 = 0, 12, 6) AS BIGINT) AS size",
            f"unhex({little} || {little} || 'DEADBEEF') AS bytes", "address AS pos")

    # --- resolved addresses --------------------------------------------------

    @cached_property
    def by_address(self) -> DataFrame:
        return cut(counters.by_address(self.samples))

    @cached_property
    def pmu_placed(self) -> DataFrame:
        return cut(resolve.address_lines(self.by_address, self.maps, self.matches, self.line_table))

    @cached_property
    def spe_placed(self) -> DataFrame:
        return cut(resolve.address_lines(self.spe, self.maps, self.matches, self.line_table))

    # --- callstacks ------------------------------------------------------------

    @cached_property
    def callstacks(self) -> DataFrame:
        """Stacks of function numbers ``p, p/10, p/100, 0`` without their first few, leaf first."""
        numbers = "slice(array(l_partkey, l_partkey div 10, l_partkey div 100, 0L), 1 + l_linenumber % 4, 4)"
        frame = ("transform(n, x -> named_struct('lib', concat('lib', x % 4), 'symbol', concat('f', x div 2), "
                 "'addr', x * 16, 'len', 16L))")
        columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
        return self.table("lineitem").select(*columns).selectExpr("*", f"{numbers} AS n").selectExpr(
            "CASE l_returnflag WHEN 'R' THEN 'cpu-cycles' WHEN 'A' THEN 'sched:sched_switch' ELSE 'task-clock' END AS event",
            "l_suppkey % 5 AS pid", "l_suppkey % 20 AS tid",
            "concat('thr', l_suppkey % 20 % 3, '-', year(l_shipdate) % 2) AS comm",
            "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate) + l_orderkey AS time", "CAST(l_quantity AS BIGINT) AS period",
            f"{frame} AS frames", "n")

    @cached_property
    def stacks(self) -> DataFrame:
        """Distinct stacks with the function number as id, so both engines name functions alike."""
        entry = F.transform("n", lambda x: F.struct(
            x.alias("func"), (x % 4).alias("lib"), F.concat(F.lit("f"), F.floor(x / 2)).alias("name")))
        return cut(self.callstacks.groupBy("event", "pid", "tid", "n").agg(
            F.sum("period").alias("weight"), F.count(F.lit(1)).alias("samples")).withColumn("calls", entry).drop("n"))

    @cached_property
    def timed(self) -> DataFrame:
        name = ("element_at(array('GameThread', 'RHIThread', 'RenderThread 1', 'Worker', 'AudioThread', 'RHIThread 2'), "
                "CAST(user_id % 6 AS INT) + 1)")
        return self.table("events").selectExpr(
            "if(event_id % 3 = 0, 'sched:sched_switch', 'cpu-cycles') AS event", "7L AS pid", "user_id % 6 AS tid",
            f"{name} AS comm", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS time",
            "CAST(floor(value * 100) AS BIGINT) AS period",
            "array(10 + event_id % 7, 20 + user_id div 10, if(event_type = 'purchase', 1L, 2L), 0L) AS funcs")

    @cached_property
    def timed_functions(self) -> DataFrame:
        """Names of all function ids seen in the timed stacks; id 1 is the marker."""
        return self.timed.select(F.explode("funcs").alias("func_id")).distinct().selectExpr(
            "func_id", "if(func_id = 1, 'FVulkanViewport::Present', concat('Work::f', func_id)) AS name")

    # --- session documents ------------------------------------------------------

    @cached_property
    def manifest(self) -> DataFrame:
        """One session per supplier."""
        return self.table("supplier").selectExpr(
            "concat('s', s_suppkey) AS session_id", "if(s_suppkey % 13 = 0, 'other_bundle', 'profile_bundle') AS schema_name",
            "CAST(if(s_suppkey % 17 = 0, 2, 1) AS INT) AS schema_major", "if(s_suppkey % 4 = 0, NULL, s_name) AS target_package",
            "if(s_suppkey % 6 = 0, NULL, s_suppkey + 1000) AS pid", "if(s_suppkey % 5 = 0, NULL, s_suppkey * 10) AS duration_ms",
            "'arm64' AS abi", "s_suppkey % 2 = 0 AS pmu_enabled", "s_suppkey % 3 <> 0 AS pmu_available",
            "if(s_suppkey % 9 = 0, concat('open failed ', s_nationkey), NULL) AS pmu_missing_reason",
            "true AS spe_enabled", "s_suppkey % 5 <> 0 AS spe_available", "if(s_suppkey % 10 = 0, 'no device', NULL) AS spe_missing_reason",
            "transform(sequence(0, CAST(s_suppkey % 4 AS INT)), x -> CAST(x AS BIGINT)) AS selected_cpus",
            "array(concat('cluster', s_suppkey % 2)) AS selected_clusters", "s_suppkey + 8 AS pmu_buffer_pages",
            "if(s_suppkey % 2 = 0, NULL, s_suppkey * 4096) AS spe_aux_buffer_bytes", "'r.html' AS html_path", "'r.xlsx' AS xlsx_path",
            "1000L AS sample_period")

    @cached_property
    def loss(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "concat('s', s_suppkey) AS session_id", "s_suppkey % 3 AS pmu_lost_records",
            "s_suppkey % 2 AS ring_buffer_overruns", "s_suppkey % 4 AS spe_decode_errors")

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "if(s_suppkey % 2 = 0, 'cpu_cycles', 'inst_retired') AS event_key", "s_suppkey % 8 AS cpu",
            "s_suppkey * 1000 + 500 AS raw_count", "if(s_suppkey % 6 = 0, 0D, s_suppkey * 1001D) AS scaled_count",
            "s_suppkey * 1000000 AS time_running_ns")

    @cached_property
    def support(self) -> DataFrame:
        """Per-cpu support states; parts of one brand stand for one event."""
        return self.table("part").selectExpr(
            "p_brand AS event_key", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey % 1000 < 2 AND p_size > 25 END AS supported")

    @cached_property
    def modules(self) -> DataFrame:
        """One module per supplier, with a mix of build ids, hints, sonames and bare paths."""
        return self.table("supplier").selectExpr(
            "concat('lib', s_suppkey, if(s_suppkey % 4 = 3, '.jar', '.so')) AS module_id",
            "concat(element_at(array('/data/app/x/', '/system/lib/', '/data/local/tmp/', '/opt/'), CAST(s_suppkey % 4 AS INT) + 1), "
            "'lib', s_suppkey % 40, '.so') AS runtime_path",
            "if(s_suppkey % 3 = 0, concat('b', s_suppkey % 30), NULL) AS build_id",
            "if(s_suppkey % 2 = 0, concat('lib', s_suppkey % 25, '.so'), NULL) AS soname",
            "if(s_suppkey % 7 = 0, NULL, s_suppkey % 5 * 100) AS file_size",
            "if(s_suppkey % 5 = 1, concat('dbg/lib', s_suppkey % 20, '.so'), NULL) AS debug_elf_candidate_path")

    @cached_property
    def candidates(self) -> DataFrame:
        """One symbol file per part."""
        return self.table("part").selectExpr(
            "concat('/sym', p_partkey % 9, '/dbg/lib', p_partkey % 60, '.so') AS path",
            "if(p_partkey % 2 = 0, concat('b', p_partkey % 45), NULL) AS build_id", "p_partkey % 6 * 100 AS file_size",
            "p_size % 2 = 0 AS has_debug_info").distinct()

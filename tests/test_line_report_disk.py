"""The line report moves numbers and not maps, moves them once, and deletes what it has read."""

import os
import time

from pyspark.sql import functions as F

from lumaprof.operators import lines, reuse, sampling
from lumaprof.operators.sampling import Baseline

BASE = "mapping_id bigint, ip bigint, category string, class string, kind string, latency bigint, cnt bigint"
PLACED = "mapping_id bigint, ip bigint, file string, line int"


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in manager.getAllFiles().mkString("\n").split("\n") if os.path.basename(name).startswith("shuffle_")}


def test_a_cut_removes_its_shuffle(spark):
    name, known = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    before = spark.conf.get(name)
    rows = reuse.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while shuffle_files(spark) - known and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - known
    assert spark.conf.get(name) == before
    assert rows.agg(F.sum("count")).first()[0] == 1000


def test_a_line_report_leaves_only_the_tables_it_reads(spark):
    from lumaprof.plans.adapters import PLAN, Views
    from lumaprof.plans.line_report import line_rows

    root = reuse.shared_dir(spark).removeprefix("file:")
    known = set(os.listdir(root))
    v = Views(spark, "/root/testdata/sf0.001")
    rows = line_rows(v.profile, PLAN)
    tables = {t for d in set(os.listdir(root)) - known if d.startswith("lines-") for t in os.listdir(f"{root}/{d}")}
    assert tables == {"counted", "statistics"}
    assert rows.filter("spe_values['spe_sample_count'].value > 0").count() > 0


def sampled(spark):
    rows = [(1, a, c, "branch" if a % 2 else "scalar_load", None if a % 2 else "load_literal", latency, 1 + latency % 3)
            for a in range(6) for c in ("load_l1", "store_l1") for latency in range(a, 40, 3)]
    rows += [(1, 6, "load_l2", "unknown_instruction", None, None, 4), (1, 0, "load_l1", "scalar_load", "load_literal", 0, 5)]
    placed = [(1, a, "f" if a < 4 else "g", a % 2) for a in range(6)] + [(1, 6, "g", 7), (1, 9, None, None)]
    return spark.createDataFrame(rows, BASE), spark.createDataFrame(placed, PLACED)


def test_latencies_move_to_their_lines_once(spark):
    base, placed = (reuse.cut(rows) for rows in sampled(spark))
    found = lines.statistics_by_line(lines.frequency_by_dimension(base, placed, ["category", "class", "kind"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(file" in line for line in plan.splitlines()) == 1
    assert sorted((r.file, r.line) for r in found.collect()) == [("f", 0), ("f", 1), ("g", 0), ("g", 1), ("g", 7)]


def test_entries_of_a_line_are_its_nonzero_metrics(spark):
    base, placed = sampled(spark)
    baseline, dimensions = Baseline(1e6, 100.0), ["category", "class", "kind"]
    by_line = reuse.cut(lines.statistics_by_line(lines.frequency_by_dimension(base, placed, dimensions)))
    rows = by_line.withColumn("totals", lines.dimension_totals(by_line))
    for d, prefix in (("category", ""), ("class", "instruction_class."), ("kind", "load_instruction.")):
        entries = lines.metric_entries(F.col("statistics"), d, F.col("totals")[d], baseline)
        mine = {(r.file, r.line, r.key): r.value for r in rows.select("file", "line", F.inline(entries)).collect()}
        long = sampling.line_metrics(lines.frequency_by_line(base, placed, d), baseline).collect()
        theirs = {(r.file, r.line, f"{prefix}{r.name}.{r.metric}"): r.value for r in long if r.value.state != "number" or r.value.value != 0}
        assert mine == theirs and len(mine) > 20


def test_lines_of_a_file_that_comes_twice_count_twice(spark):
    counted = spark.createDataFrame([("f", 1, 5.0, 20.0), ("f", 2, 5.0, 20.0), ("g", 1, 90.0, 160.0), ("h", None, 1.0, 1.0)],
                                    "file string, line int, self_weight double, accumulated_weight double")
    source = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), ("g", 1, "c"), ("g", 2, "d")], "file string, line int, code string")
    columns = ["file", "line", "p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct"]
    shares = lines.percentages(lines.with_copies(counted, source), F.col("copies"))
    mine = lines.with_source(shares, source).fillna(0.0).select(*columns)
    whole = lines.percentages(lines.with_source(counted, source).fillna(0.0)).select(*columns)
    assert sorted(map(str, mine.collect())) == sorted(map(str, whole.collect()))
    assert [r.file_p_pct for r in mine.filter("file = 'f' and line = 1").collect()] == [5 / 15 * 100] * 2

"""Reports that are written whole or not at all, documents that are broken, and pages of a saved ranking."""

import json

import pytest
from pyspark.sql import functions as F

from lumaprof.functions import metric_value as M
from lumaprof.operators import views
from lumaprof.sinks import report
from lumaprof.sources import bundle, tables
from lumaprof.sources.schemas import DOCUMENTS


def line_rows(spark, count):
    empty = F.create_map().cast(f"map<string,{M.TYPE}>")
    text = {c: F.lit(c) for c in ("function", "module", "cpu", "thread", "status", "code", "detail")}
    numbers = {c: F.lit(1.0) for c in ("self_weight", "accumulated_weight", "p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct")}
    maps = {m: empty for m in ("pmu_values", "spe_values", "instruction_values", "load_instruction_values")}
    return spark.range(count).select(F.lit("a.cpp").alias("file"), F.col("id").cast("int").alias("line"), F.lit(1).alias("sample_count")).withColumns(text | numbers | maps)


def test_a_report_that_fails_halfway_leaves_the_last_one(spark, tmp_path):
    root = str(tmp_path / "report")
    summary = spark.createDataFrame([("s",)], "session_id string")
    small = spark.createDataFrame([("a.cpp", 1)], "file string, n int")
    report.write_report_tables(summary, line_rows(spark, 3), small, small, root)
    first = tables.read_report(spark, root)
    failing = small.withColumn("n", F.raise_error(F.lit("disk lost")).cast("int"))
    with pytest.raises(Exception, match="disk lost"):
        report.write_report_tables(summary, line_rows(spark, 9), failing, small, root)
    assert tables.read_report(spark, root)["source_lines"].count() == 3
    report.write_report_tables(summary, line_rows(spark, 5), small, small, root)
    assert tables.read_report(spark, root)["source_lines"].count() == 5
    # A reader stays with the generation that it has opened.
    assert first["source_lines"].count() == 3


def test_a_root_without_a_whole_report_is_an_error(spark, tmp_path):
    (tmp_path / "commits").mkdir()
    with pytest.raises(Exception):
        tables.read_report(spark, str(tmp_path))


def test_broken_documents_are_rows_with_session_and_document(spark, tmp_path):
    full = {"manifest": {"schema": {"name": "x", "version": {"major": 1, "minor": 0, "patch": 0}}, "artifacts": {"files": []},
                         "lanes": {lane: {"enabled": True, "available": True} for lane in ("pmu", "spe")}},
            "capability": {"cpus": [], "clusters": []}, "maps": {"maps": []}, "threads": {"threads": []}, "build_ids": {"modules": []},
            "loss": {"totals": {"pmu_lost_records": 0}, "by_event_cpu": []}, "event_catalog": {"events": []}, "metric_catalog": {"metrics": []},
            "event_runs": {"runs": []}}
    for name in ("whole", "broken"):
        (tmp_path / name).mkdir()
        for document, body in full.items():
            (tmp_path / name / f"{document}.json").write_text(json.dumps({"session_id": name} | body, indent=1))
    bad = tmp_path / "broken"
    (bad / "loss.json").write_text((bad / "loss.json").read_text()[:40])
    (bad / "maps.json").write_text(json.dumps({"session_id": "broken", "maps": "none"}))
    (bad / "threads.json").write_text(json.dumps({"session_id": "broken"}))
    (bad / "event_runs.json").write_text(json.dumps({"runs": []}))
    assert set(bundle.REQUIRED) == set(DOCUMENTS)
    found = {(r.bundle.rsplit("/", 1)[1], r.session_id, r.document): r.violation for r in bundle.broken_documents(spark, [f"{tmp_path}/*"]).collect()}
    broken = "{} does not parse or has a value of a wrong type"
    assert {k[0] for k in found} == {"broken"}
    assert {k[2]: v for k, v in found.items()} == {
        "loss": broken.format("loss.json"), "maps": broken.format("maps.json"), "threads": "threads.json lacks threads",
        "event_runs": "event_runs.json lacks session_id"}
    assert ("broken", "broken", "threads") in found
    documents = bundle.read_documents(spark, [f"{tmp_path}/*"])
    assert [r.session_id for r in documents["loss"].collect()] == ["whole"] and documents["loss"].columns == ["session_id", "totals", "by_event_cpu"]


def test_a_deep_page_opens_only_its_ranges(spark, tmp_path):
    order, path = [F.desc("w"), F.asc("id")], str(tmp_path / "ranked")
    rows = spark.range(5000).withColumn("w", F.col("id") % 700)
    views.save_ranked(rows, order, path, slice_rows=250)
    wanted = [(r.id, n) for n, r in enumerate(rows.orderBy(*order).collect(), 1)]
    for offset, limit in ((0, 10), (3990, 100), (4990, 100), (5000, 10), (9000, 10)):
        page = views.ranked_page(spark, path, order, offset, limit)
        assert [(r.id, r.position) for r in page.orderBy("position").collect()] == wanted[offset:offset + limit]
    # Of twenty ranges a page reads those it lies in.
    page = views.ranked_page(spark, path, order, 3990, 100)
    assert len({r[0].split("_slice=")[1].split("/")[0] for r in page.select(F.input_file_name()).distinct().collect()}) <= 2

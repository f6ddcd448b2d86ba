import json
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumaprof.functions import paths
from lumaprof.operators import quality
from lumaprof.sinks import report
from lumaprof.sources import bundle, source_text, streams, tables


def header(kind, records, extra=0):
    return struct.pack("<4sHHHHBBHQQQ", b"MPSP", kind, 1, 0, 40 + extra, 1, 1, 0, records, 0, 0) + bytes(extra)


def pmu_record(ip, chain):
    size = 66 + 8 * len(chain)
    return struct.pack("<HHIIIHHIIIQQQQH", 1, size, 0, 0, 2, 0, 0, 10, 11, 3, 1, 99, ip, 1000, len(chain)) + struct.pack(f"<{len(chain)}Q", *chain)


def spe_record(pc, latency, pad=0):
    return struct.pack("<HHIIIIIQQQIIQBBBHHQ", 2, 79 + pad, 0, 0, 10, 11, 3, 1, 100, pc, latency, 1, 3, 1, 1, 2, 7, 0, 0) + bytes(pad)


def test_pmu_stream_in_small_ranges(spark, tmp_path):
    top = 0x80000076A8F50DA0
    body = b"".join(pmu_record(top + i if i == 0 else i, list(range(i % 4))) for i in range(50))
    (tmp_path / "a.bin").write_bytes(header(1, 50, extra=8) + body + b"tail that is not read")
    rows = streams.read_pmu(spark, str(tmp_path / "a.bin"), range_bytes=300).collect()
    assert len(rows) == 50 and sorted(len(r.callchain) for r in rows) == sorted(i % 4 for i in range(50))
    assert {r.ip for r in rows} == {top - (1 << 64), *range(1, 50)}
    assert rows[0].event_key_ref == 2 and rows[0].period == 1000


def test_spe_stream_reads_to_the_end(spark, tmp_path):
    (tmp_path / "s.bin").write_bytes(header(2, 1) + spe_record(0x400000004684, 42) + spe_record(8, 0xFFFFFFFF, pad=5) + spe_record(9, 7))
    rows = {r.ip: r for r in streams.read_spe(spark, str(tmp_path / "s.bin")).collect()}
    first = rows[0x400000004684]
    assert (first.latency, first.operation_flags, first.event_flags, first.cache_level, first.cache_result, first.branch_result, first.data_source) == (
        42, 1, 3, 1, 1, 2, 7)
    assert rows[8].latency is None and rows[9].latency == 7


def test_bad_streams_fail(spark, tmp_path):
    (tmp_path / "k.bin").write_bytes(header(2, 0))
    with pytest.raises(Exception, match="expected 1"):
        streams.read_pmu(spark, str(tmp_path / "k.bin")).collect()
    (tmp_path / "e.bin").write_bytes(b"")
    (tmp_path / "z.bin").write_bytes(bytes(64))
    (tmp_path / "ok.bin").write_bytes(b"x" * 80)
    problems = streams.record_file_problems(spark, [str(tmp_path / f"{n}.bin") for n in ("k", "e", "z", "ok")]).collect()
    assert sorted((Path(r.path).name, r.problem) for r in problems) == [("e.bin", "empty"), ("z.bin", "zeroed header")]


def write_bundle(root, name, lost=0, supported=True, without=()):
    """A small bundle of our own: two cpus, one with a sampling device, and a declared counter stream."""
    summary = {"spe": False, "cycles": True, "instructions": True, "cache": False, "branch": False, "callchain": True, "source_sample_fields": True}
    counts = {"pmu_lost_records": lost, "ring_buffer_overruns": 0, "reader_lag_records": 0, "spe_aux_truncations": 0,
              "spe_decode_errors": lost, "dropped_records": 0}
    documents = {
        "manifest": {
            "schema": {"name": "own.profile", "version": {"major": 1, "minor": 0, "patch": 0}, "min_reader_version": {"major": 1, "minor": 0, "patch": 0}},
            "session_id": name, "recording": {"duration_ms": 5}, "device": {"abi": "arm64"}, "target": {"package": "p", "pid": 7},
            "cpu": {"selected_cpus": [0, 1], "selected_clusters": ["little"]},
            "lanes": {"pmu": {"enabled": True, "available": True}, "spe": {"enabled": False, "available": False, "missing_reason": "no device"}},
            "artifacts": {"files": [{"path": "pmu_samples.bin", "role": "samples", "required": True}, {"path": "x.log", "role": "log"}]}},
        "capability": {"cpus": [
            {"cpu": 0, "cluster": "little", "summary": summary, "details": [{"event_key": "cpu_cycles", "supported": True}, {"event_key": "spe", "supported": False, "errno": 2}]},
            {"cpu": 1, "cluster": "little", "summary": summary, "details": [], "spe": {"device_path": "/dev/spe"}}],
            "clusters": [{"cluster": "little", "cpus": [0, 1], "summary": summary}]},
        "maps": {"maps": [{"mapping_id": 1, "start": 4096, "end": 8192, "path": "/lib/a.so", "module_id": "m", "load_bias": -4096}]},
        "threads": {"threads": [{"pid": 7, "tid": 8, "thread_name": "t", "cpu_affinity": [0]}]},
        "build_ids": {"modules": [{"module_id": "m", "runtime_path": "/lib/a.so", "match_status": "matched"}]},
        "loss": {"totals": counts, "by_event_cpu": [{"event_key": "cpu_cycles", "cpu": c, "run_id": "r", "counts": counts} for c in (0, 1)]},
        "event_catalog": {"events": [
            {"event_key": "cpu_cycles", "per_cpu_support": [{"cpu": 0, "supported": True}]},
            {"event_key": "l3d_cache_access", "per_cpu_support": [{"cpu": 0, "supported": supported, "reason": "absent"}]},
            {"event_key": "bare", "per_cpu_support": []}]},
        "metric_catalog": {"metrics": [{"metric_key": "cpi", "formula": "a / b"}]},
        "event_runs": {"runs": [{"run_id": "r", "event_key": "cpu_cycles", "cpu": 0, "scaled_count": 3000.0, "sample_count": 3, "lost_count": lost}]},
    }
    (root / name).mkdir()
    (root / name / "recording.log").write_text("log")
    for key, value in documents.items():
        if key not in without:
            (root / name / f"{key}.json").write_text(json.dumps({"session_id": name, **value}, indent=1))


def test_bundles(spark, tmp_path):
    write_bundle(tmp_path, "whole")
    write_bundle(tmp_path, "loss", lost=7)
    write_bundle(tmp_path, "missing", supported=False)
    (tmp_path / "whole" / "src").mkdir()
    (tmp_path / "whole" / "src" / "a.cpp").write_text("x")
    assert bundle.incomplete_bundles(spark, [str(tmp_path / "*")]).count() == 0
    documents = bundle.read_documents(spark, [str(tmp_path / "*")])
    manifest, loss = bundle.flat_manifest(documents), bundle.loss_totals(documents)
    none = spark.createDataFrame([], "session_id string, lane string")
    assert [r.violation for r in bundle.manifest_violations(manifest, none, "own.profile").collect()] == ["pmu stream is missing"] * 3
    assert bundle.manifest_violations(manifest, none, "another").filter("violation LIKE 'unsupported%'").count() == 3
    support = bundle.event_support(documents)
    assert [(r.session_id, r.event_key, r.reason) for r in support.filter("NOT supported").collect()] == [("missing", "l3d_cache_access", "absent")]
    assert support.filter("event_key = 'bare' AND supported IS NULL").count() == 3
    lost = quality.lane_warnings(manifest, loss).filter("session_id = 'loss'").collect()
    assert {r.warning.split(":")[0] for r in lost} == {"SPE Missing", "PMU lost records", "SPE decode errors"}
    assert bundle.loss_by_event(documents).filter("session_id = 'loss'").count() == 2
    rows = bundle.capability_rows(documents).filter("session_id = 'loss'").orderBy("pos", "detail_pos").collect()
    assert [(r.cpu, r.event_key, r.supported, r.errno, r.spe_device) for r in rows] == [
        (0, "cpu_cycles", True, None, ""), (0, "spe", False, 2, ""), (1, None, None, None, "/dev/spe")]
    assert bundle.artifact_files(documents).filter("session_id = 'loss'").count() == 2
    for table, count in ((bundle.threads, 3), (bundle.modules, 3), (bundle.runs, 3), (bundle.metrics, 3), (bundle.events, 9), (bundle.clusters, 3)):
        assert table(documents).count() == count


def test_incomplete_bundles_are_named(spark, tmp_path):
    write_bundle(tmp_path, "whole")
    write_bundle(tmp_path, "cut", without=("maps", "loss"))
    found = bundle.incomplete_bundles(spark, [str(tmp_path / "*")]).collect()
    assert sorted((Path(r.bundle).name, r.document, r.violation) for r in found) == [
        ("cut", "loss", "loss.json is missing"), ("cut", "maps", "maps.json is missing")]
    assert bundle.incomplete_bundles(spark, [str(tmp_path / "whole")]).count() == 0


def test_source_roots(spark, tmp_path):
    for name in ("Build/a.cpp", "Engine/Source/b.cpp", "Engine/Source/c.h", "sp ace/50%+1/d.cpp", "x/x/e.cpp", "x/Saved/f.cpp"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("one\n")
    at = lambda *names: [str(tmp_path / n) for n in names]
    found = lambda roots, **kw: sorted(r.path[len(str(tmp_path)) + 1:] for r in source_text.discover(spark, roots, **kw).collect())
    assert found(at("Build")) == [] and found(at("Build"), skip=False) == ["Build/a.cpp"]
    assert found(at("Engine/Source", "Engine/Source/b.cpp")) == ["Engine/Source/b.cpp"]
    assert found(at("x/../x")) == ["x/x/e.cpp"]
    assert found(at("sp ace")) == ["sp ace/50%+1/d.cpp"]
    assert [r.file for r in source_text.read_lines(spark, at("sp ace/50%+1/d.cpp")).collect()] == at("sp ace/50%+1/d.cpp")
    dotted = spark.createDataFrame([("/a//./b/../c/", "/a/c"), ("/../x", "/x"), ("/", "/")], "p string, want string")
    assert dotted.filter(paths.canonical(F.col("p")) != F.col("want")).count() == 0


def test_discovery_and_lines(spark, tmp_path):
    for name in ("a.cpp", "sub/b.h", "Saved/c.cpp", "annotated_files_1/d.cpp", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"one\r\ntwo\n\nlast\n")
    found = lambda **kw: sorted(r.path[len(str(tmp_path)) + 1:] for r in source_text.discover(spark, [str(tmp_path)], **kw).collect())
    assert found() == ["a.cpp", "sub/b.h"]
    assert found(skip=False) == ["Saved/c.cpp", "a.cpp", "annotated_files_1/d.cpp", "sub/b.h"]
    lines = source_text.read_lines(spark, [str(tmp_path / "a.cpp")]).orderBy("line").collect()
    assert [(r.line, r.code) for r in lines] == [(1, "one"), (2, "two"), (3, ""), (4, "last")]


def test_disassembly_last_line_wins(spark, tmp_path):
    (tmp_path / "x.s").write_text("Section .text:\n   1000: 1f 20 03 d5 \tnop\n  1004: f9400020\tldr x0, [x1]\n  1004: 8b020020  add  x0, x1, x2\n  1008:\n")
    rows = {r.address: r for r in source_text.read_disassembly(spark, [str(tmp_path / "x.s")]).collect()}
    assert set(rows) == {0x1000, 0x1004} and rows[0x1000].mnemonic == "nop"
    # "add" is all-hex but has no digit, so it is no machine code.
    assert (rows[0x1004].mnemonic, rows[0x1004].operands, rows[0x1004]["class"]) == ("add", "x0, x1, x2", "compute_int")


def test_csv_quotes_only_where_needed(spark, tmp_path):
    rows = spark.createDataFrame([("plain", 'say "hi"', "a,b", "")], "a string, b string, c string, d string")
    report.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == 'a,b,c,d\nplain,"say ""hi""","a,b",\n'


def test_report_round_trip_and_annotated_files(spark, tmp_path):
    from lumaprof.plans.adapters import PLAN, SOURCE_ROOTS, Views
    from lumaprof.plans.line_report import line_rows
    from lumaprof.operators import lines, views

    v = Views(spark, "/root/testdata/sf0.001")
    rows = line_rows(v.profile, PLAN).persist()
    summary = v.manifest.limit(1).select("session_id")
    report.write_report_tables(summary, rows, lines.summarize_files(rows), lines.summarize_functions(rows), str(tmp_path / "db"))
    saved = tables.read_report(spark, str(tmp_path / "db"))
    assert saved["source_lines"].count() == rows.count()
    hot = saved["source_lines"].filter("spe_json <> '{}'")
    assert hot.count() > 0
    page = views.query_lines(saved["source_lines"], views.LineFilter(sort="spe_sample_count", desc=True, limit=5))[1].collect()
    counts = [float(r.spe_json.split('"spe_sample_count":"')[1].split('"')[0]) for r in page]
    assert counts == sorted(counts, reverse=True) and counts[0] > 0
    notes = report.annotated_rows(rows, SOURCE_ROOTS, list(PLAN.raw_keys), ["spe_sample_count"], "[t]")
    report.write_annotated(report.annotated_lines(v.source, notes, SOURCE_ROOTS), str(tmp_path / "annotated"))
    text = "\n".join(p.read_text() for p in list((tmp_path / "annotated").rglob("*.txt"))[:5])
    assert "// [t] sample_count=" in text and "spe_sample_count=" in text
    counted = rows.agg(F.sum("sample_count")).first()[0]
    assert counted == lines.counter_rows(lines.counters_by_line(v.by_address, v.pmu_placed)).agg(F.sum("sample_count")).first()[0]

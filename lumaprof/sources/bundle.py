"""Bundle metadata: the nine JSON documents of many sessions, flattened to tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaprof.sources.schemas import DOCUMENTS

SESSION = "session_id"


def incomplete_bundles(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``(bundle, document, violation)`` for each of the nine documents that a bundle below the roots lacks.

    A bundle is a directory that a root (a directory or a glob) names and that holds any file.
    """
    found = None
    for root in (r.rstrip("/") for r in roots):
        depth = len(re.sub("^file:/+", "/", root).split("/")) + 1
        path = F.regexp_replace("path", "^file:/+", "/")
        files = spark.read.format("binaryFile").load(f"{root}/*").select(path.alias("path")).filter(F.size(F.split("path", "/")) == depth)
        found = files if found is None else found.unionByName(files)
    cut = F.col("path").substr(F.lit(1), F.length("path") - F.length(F.substring_index("path", "/", -1)) - 1)
    present = found.select(cut.alias("bundle"), F.substring_index("path", "/", -1).alias("file")).groupBy("bundle").agg(
        F.collect_set(F.when(F.col("file").isin(*[f"{n}.json" for n in DOCUMENTS]), F.col("file"))).alias("_files"))
    missing = F.filter(F.array(*[F.lit(n) for n in DOCUMENTS]), lambda n: ~F.array_contains(F.col("_files"), F.concat(n, F.lit(".json"))))
    return present.select("bundle", F.explode(missing).alias("document")).withColumn(
        "violation", F.concat(F.col("document"), F.lit(".json is missing")))


#: Fields without which a document says nothing, besides its session.
REQUIRED = {
    "manifest": ("schema.name", "schema.version.major", "lanes.pmu.enabled", "lanes.pmu.available", "lanes.spe.enabled", "lanes.spe.available",
                 "artifacts.files"),
    "capability": ("cpus", "clusters"), "maps": ("maps",), "threads": ("threads",), "build_ids": ("modules",),
    "loss": ("totals", "by_event_cpu"), "event_catalog": ("events",), "metric_catalog": ("metrics",), "event_runs": ("runs",),
}
_CORRUPT = "_corrupt"


def _parsed(spark: SparkSession, roots: Sequence[str], name: str) -> DataFrame:
    reader = spark.read.schema(f"{DOCUMENTS[name]}, {_CORRUPT} string").option("columnNameOfCorruptRecord", _CORRUPT)
    return reader.json([f"{root.rstrip('/')}/{name}.json" for root in roots], multiLine=True)


def read_documents(spark: SparkSession, roots: Sequence[str]) -> dict[str, DataFrame]:
    """One frame per document over all bundle roots (directories or globs).

    A root without a document is an error; under a glob, ``incomplete_bundles`` names the bundles that lack one.
    Documents that ``broken_documents`` names for not parsing are left out.
    """
    return {name: _parsed(spark, roots, name).filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT) for name in DOCUMENTS}


def broken_documents(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``(bundle, session_id, document, violation)`` of documents that do not parse, have a value of a wrong type, or lack a required field."""
    found = None
    for name in DOCUMENTS:
        rows = _parsed(spark, roots, name)
        path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
        lost = [F.when(F.col(field).isNull(), F.lit(f"{name}.json lacks {field}")) for field in (SESSION, *REQUIRED[name])]
        broken = F.array(F.lit(f"{name}.json does not parse or has a value of a wrong type"))
        violations = F.when(F.col(_CORRUPT).isNotNull(), broken).otherwise(F.array_compact(F.array(*lost)))
        one = rows.select(path.substr(F.lit(1), F.length(path) - len(name) - 6).alias("bundle"), SESSION, F.lit(name).alias("document"),
                          F.explode(violations).alias("violation"))
        found = one if found is None else found.unionByName(one)
    return found


def _explode(doc: DataFrame, column: str, *extra: str) -> DataFrame:
    return doc.select(SESSION, F.posexplode(column).alias("pos", "_r")).select(SESSION, "pos", "_r.*", *extra)


def maps(documents: dict[str, DataFrame]) -> DataFrame:
    return _explode(documents["maps"], "maps")


def threads(documents: dict[str, DataFrame]) -> DataFrame:
    return _explode(documents["threads"], "threads")


def modules(documents: dict[str, DataFrame]) -> DataFrame:
    return _explode(documents["build_ids"], "modules")


def runs(documents: dict[str, DataFrame]) -> DataFrame:
    return _explode(documents["event_runs"], "runs")


def metrics(documents: dict[str, DataFrame]) -> DataFrame:
    return _explode(documents["metric_catalog"], "metrics")


def events(documents: dict[str, DataFrame]) -> DataFrame:
    """Event catalog; samples refer to an event by ``ordinal``."""
    return _explode(documents["event_catalog"], "events").withColumnRenamed("pos", "ordinal")


def event_support(documents: dict[str, DataFrame]) -> DataFrame:
    """Per-cpu states; an event that lists none has one row with null state."""
    return events(documents).select(SESSION, "ordinal", "event_key", F.explode_outer("per_cpu_support").alias("_s")).select(
        SESSION, "ordinal", "event_key", "_s.cpu", "_s.supported", "_s.reason")


def cpus(documents: dict[str, DataFrame]) -> DataFrame:
    """Cpus with capability flags and the optional sampling device."""
    rows = _explode(documents["capability"], "cpus")
    return rows.select(SESSION, "pos", "cpu", "cluster", "details", F.col("spe").alias("device"), "summary")


def clusters(documents: dict[str, DataFrame]) -> DataFrame:
    return _explode(documents["capability"], "clusters").select(SESSION, "pos", "cluster", "cpus", "summary.*")


def capability_rows(documents: dict[str, DataFrame]) -> DataFrame:
    """One row per (cpu, event-open detail); a cpu without details keeps one row."""
    rows = cpus(documents).select(
        SESSION, "pos", "cpu", "cluster", "summary.*", F.coalesce("device.device_path", F.lit("")).alias("spe_device"),
        F.posexplode_outer("details").alias("detail_pos", "d"))
    return capability_table(rows)


def capability_table(rows: DataFrame) -> DataFrame:
    text = lambda c: F.when(F.col("d").isNotNull(), F.coalesce(F.col(f"d.{c}"), F.lit(""))).alias(c)
    return rows.select(
        SESSION, "pos", "detail_pos", "cpu", "cluster", "spe", "cycles", "instructions", "cache", "branch", "callchain",
        "source_sample_fields", "d.event_key", "d.raw_event_name", "d.type", "d.config", "d.supported", "d.errno",
        text("failure_reason"), text("sysfs_path"), "spe_device")


def loss_totals(documents: dict[str, DataFrame]) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(f"totals.{c}"), F.lit(0)).alias(c)
    names = ("pmu_lost_records", "ring_buffer_overruns", "reader_lag_records", "spe_aux_truncations",
             "spe_decode_errors", "dropped_records")
    return documents["loss"].select(SESSION, *[zero(c) for c in names])


def loss_by_event(documents: dict[str, DataFrame]) -> DataFrame:
    return _explode(documents["loss"], "by_event_cpu").select(SESSION, "pos", "event_key", "cpu", "run_id", "counts.*")


def artifact_files(documents: dict[str, DataFrame]) -> DataFrame:
    return documents["manifest"].select(SESSION, F.posexplode("artifacts.files").alias("pos", "f")).select(
        SESSION, "pos", "f.role", "f.path", F.coalesce("f.required", F.lit(False)).alias("required"),
        F.coalesce("f.encoding", F.lit("")).alias("encoding"))


def flat_manifest(documents: dict[str, DataFrame]) -> DataFrame:
    """The one-row-per-session columns the quality operators use."""
    lane = lambda n: [F.col(f"lanes.{n}.{c}").alias(f"{n}_{c}") for c in ("enabled", "available", "missing_reason")]
    return documents["manifest"].select(
        SESSION, F.col("schema.name").alias("schema_name"), F.col("schema.version.major").alias("schema_major"),
        F.col("target.package").alias("target_package"), F.col("target.pid").alias("pid"),
        F.col("recording.duration_ms").alias("duration_ms"), F.col("device.abi").alias("abi"),
        F.col("device.manufacturer").alias("manufacturer"), F.col("device.model").alias("model"),
        F.col("device.android_release").alias("android_release"),
        F.coalesce("cpu.selected_cpus", F.array().cast("array<int>")).alias("selected_cpus"),
        F.coalesce("cpu.selected_clusters", F.array().cast("array<string>")).alias("selected_clusters"),
        *lane("pmu"), *lane("spe"), "capture_options.*", "inputs.*",
        F.col("artifacts.report_paths.html").alias("html_path"), F.col("artifacts.report_paths.xlsx").alias("xlsx_path"))


def manifest_violations(manifest: DataFrame, streams: DataFrame, schema_name: str) -> DataFrame:
    """Sessions that cannot be read: wrong schema, wrong major version, or a declared stream that is not there.

    ``streams`` is ``(session_id, lane)`` of the sample streams found on storage.
    """
    present = streams.groupBy(SESSION).agg(F.collect_set("lane").alias("_lanes"))
    rows = manifest.join(present, SESSION, "left").withColumn("_lanes", F.coalesce("_lanes", F.array().cast("array<string>")))

    def absent(lane: str):
        return F.when(F.col(f"{lane}_enabled") & F.col(f"{lane}_available") & ~F.array_contains("_lanes", lane),
                      F.lit(f"{lane} stream is missing"))

    found = F.filter(F.array(
        F.when(F.col("schema_name") != schema_name, F.concat(F.lit("unsupported schema "), F.col("schema_name"))),
        F.when(F.col("schema_major") != 1, F.concat(F.lit("unsupported major version "), F.col("schema_major").cast("string"))),
        absent("pmu"), absent("spe")), lambda v: v.isNotNull())
    return rows.select(SESSION, F.explode(found).alias("violation"))

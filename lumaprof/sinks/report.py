"""Report writers. Every sink is a distributed write of the printed tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaprof.functions import metric_value as M
from lumaprof.functions import text as X
from lumaprof.functions.paths import external_path, is_under
from lumaprof.operators.stack_text import callchain_order, frame_order
from lumaprof.sinks import render


def write_csv(rows: DataFrame, path: str) -> None:
    """Quotes only where needed, quotes doubled, empty text unquoted."""
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", nullValue="",
                                         ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def csv_exports(tables: Mapping[str, DataFrame], pmu_keys: Sequence[str]) -> dict[str, DataFrame]:
    """The seven exports by name. ``tables``: rows, files, functions, frames, callchains, breakdown."""
    rows = tables["rows"].orderBy("file", "line")
    return {
        "AllLines": render.line_rows(rows, pmu_keys),
        "SampledLines": render.line_rows(render.sampled(rows), pmu_keys),
        "Files": render.file_rows(tables["files"].orderBy("file")),
        "Functions": render.function_rows(tables["functions"].orderBy("file", "function")),
        "CallchainFrames": render.frame_rows(tables["frames"].orderBy(*frame_order())),
        "Callchains": render.callchain_rows(tables["callchains"].orderBy(*callchain_order())),
        "SPEBreakdown": render.breakdown_sheet(tables["breakdown"]),
    }


def write_csv_exports(tables: Mapping[str, DataFrame], pmu_keys: Sequence[str], root: str) -> None:
    for name, rows in csv_exports(tables, pmu_keys).items():
        write_csv(rows, f"{root.rstrip('/')}/{name}")


def row_arrays(rows: DataFrame) -> DataFrame:
    """Each row as one JSON array of its printed cells, headers kept in the schema."""
    return rows.select(F.to_json(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns])).alias("value"))


def write_json_report(summary: DataFrame, tables: Mapping[str, DataFrame], warnings: DataFrame, pmu_keys: Sequence[str],
                      root: str) -> None:
    """The JSON report as a directory: the summary document and one folder of JSON arrays per table."""
    base = root.rstrip("/")
    parts = {"rows": render.line_rows(tables["rows"].orderBy("file", "line"), pmu_keys),
             "callchain_frames": render.frame_rows(tables["frames"].orderBy(*frame_order())),
             "callchains": render.callchain_rows(tables["callchains"].orderBy(*callchain_order()))}
    columns = {f"{name}_columns": F.array(*[F.lit(c) for c in frame.columns]) for name, frame in parts.items()}
    summary.select("*", *[value.alias(name) for name, value in columns.items()]).write.mode("overwrite").json(f"{base}/summary")
    for name, frame in parts.items():
        row_arrays(frame).write.mode("overwrite").text(f"{base}/{name}")
    warnings.write.mode("overwrite").json(f"{base}/warnings")


def line_table(rows: DataFrame) -> DataFrame:
    """Saved line table: fixed columns, four promoted metrics and four metric maps as JSON (three sparse)."""
    text = lambda key: M.metric_text(F.try_element_at("pmu_values", F.lit(key))).alias(key)
    sparse = lambda column: M.map_text(M.drop_zeros(F.col(column)))
    return rows.select(
        "file", "line", "function", "module", "cpu", "thread", "status", "code", "detail", "sample_count", "self_weight",
        "accumulated_weight", "p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct",
        text("cpi"), text("l1d_cache_hit_rate"), text("mips"), text("mcps"),
        M.map_text(F.col("pmu_values")).alias("pmu_json"), sparse("spe_values").alias("spe_json"),
        sparse("instruction_values").alias("instruction_json"),
        sparse("load_instruction_values").alias("load_instruction_json"))


def write_report_tables(summary: DataFrame, rows: DataFrame, files: DataFrame, functions: DataFrame, root: str) -> None:
    """Write the four report tables as one generation; lines are clustered by file so file filters prune.

    Every generation has its own folder. Its name is added to ``commits`` when all
    four tables are whole; readers take the last name there, so that a writer that
    fails halfway leaves the report as it was.
    """
    generation = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    base = f"{root.rstrip('/')}/{generation}"
    metadata = summary.select(F.lit("summary").alias("key"), F.to_json(F.struct("*")).alias("value"))
    metadata.write.mode("overwrite").parquet(f"{base}/metadata")
    line_table(rows).repartitionByRange("file", "line").sortWithinPartitions("file", "line").write.mode("overwrite").parquet(
        f"{base}/source_lines")
    files.write.mode("overwrite").parquet(f"{base}/files")
    functions.write.mode("overwrite").parquet(f"{base}/functions")
    rows.sparkSession.range(1).select(F.lit(generation)).coalesce(1).write.mode("append").text(f"{root.rstrip('/')}/commits")


def session_summary(manifest: DataFrame, warnings: DataFrame) -> DataFrame:
    """Summary document of each session with its warnings, which the document holds as one list."""
    lane = lambda n: F.struct(*[F.col(f"{n}_{c}").alias(c) for c in ("enabled", "available", "missing_reason")])
    found = warnings.groupBy("session_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    options = [c for c in ("sample_period", "callchain_depth", "pmu_buffer_pages", "requested_event_keys",
                           "spe_aux_buffer_bytes", "duration_ms_requested") if c in manifest.columns]
    device = [c for c in ("manufacturer", "model", "android_release", "abi") if c in manifest.columns]
    return manifest.join(found, "session_id", "left").select(
        "session_id", "target_package", "pid", "duration_ms", F.struct(*device).alias("device"), "selected_cpus",
        "selected_clusters", lane("pmu").alias("pmu_lane"), lane("spe").alias("spe_lane"),
        F.struct(*options).alias("capture_options"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


# --- annotated source ----------------------------------------------------------

def annotated_rows(rows: DataFrame, roots: Sequence[str], pmu_keys: Sequence[str], spe_keys: Sequence[str], tag: str) -> DataFrame:
    """``(file, line, annotation)`` of nonzero lines in files under a source root."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | is_under(F.col("file"), F.lit(root))
    kept = rows.filter(inside & F.col("status").contains("NonZero"))
    fields = {c: F.col(c) for c in ("p_pct", "acc_p_pct", "file_p_pct", "file_acc_p_pct", "self_weight",
                                    "accumulated_weight", "cpu", "thread", "status")}
    parts = X.file_metric_parts(F.col("pmu_values"), F.col("spe_values"), list(pmu_keys), list(spe_keys))
    return kept.select("file", "line", X.annotation(fields, parts, tag, F.col("sample_count")).alias("annotation"))


def output_path(file: Column, roots: Sequence[str]) -> Column:
    """Path below the deepest root that holds the file, else under ``external/``."""
    deepest = sorted((r.rstrip("/") for r in roots), key=lambda r: -len([p for p in r.split("/") if p]))
    inner = [F.when(is_under(file, F.lit(r)), F.substr(file, F.lit(len(r) + 2))) for r in deepest]
    return F.coalesce(*inner, external_path(file))


def annotated_lines(source: DataFrame, annotations: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Text of every annotated file that exists: ``(path, line, kind, text)``, annotation above its line."""
    files = annotations.select("file").distinct()
    code = source.join(files, "file", "left_semi").select("file", "line", F.lit(1).alias("kind"), F.col("code").alias("text"))
    notes = annotations.join(source.select("file", "line"), ["file", "line"], "left_semi").select(
        "file", "line", F.lit(0).alias("kind"), F.col("annotation").alias("text"))
    return code.unionByName(notes).select(output_path(F.col("file"), roots).alias("path"), "line", "kind", "text")


def write_annotated(lines: DataFrame, root: str) -> None:
    """One folder per source file; its lines stay in order in one part."""
    lines.repartition("path").sortWithinPartitions("path", "line", "kind").select("path", "text").write.mode(
        "overwrite").partitionBy("path").text(root)


def annotated_manifest(annotations: DataFrame, source: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Written and skipped files with sampled and total line counts; order by ``original_path``."""
    sampled = annotations.groupBy("file").agg(F.count(F.lit(1)).alias("sampled_lines"))
    totals = source.groupBy("file").agg(F.count(F.lit(1)).alias("total_lines"))
    exists = F.col("total_lines").isNotNull()
    return sampled.join(totals, "file", "left").select(
        F.col("file").alias("original_path"), F.when(exists, output_path(F.col("file"), roots)).alias("annotated_path"),
        "sampled_lines", "total_lines",
        F.when(exists, F.lit("written")).otherwise(F.lit("skipped")).alias("result"),
        F.when(~exists, F.lit("source file does not exist on this host")).alias("reason"))


# --- callstack record info -------------------------------------------------------

def record_tables(functions: DataFrame, libraries: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """Flat name tables of the record export, angle brackets escaped in library and function names."""
    return {
        "libraries": libraries.select("lib_id", X.escape_angles(F.col("lib")).alias("name")),
        "functions": functions.select("func_id", "lib_id", X.escape_angles(F.col("symbol")).alias("name")),
        "processes": names.filter("level = 'process'").groupBy("pid").agg(F.max_by("name", "event").alias("name")),
        "threads": names.filter("level = 'thread'").groupBy("tid").agg(F.max_by("name", F.struct("event", "pid")).alias("name")),
    }


def function_lists(functions: DataFrame, libraries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per thread and library: its weight and ``{"f":id,"c":[samples,self,subtree]}`` entries as JSON lines."""
    entry = F.to_json(F.struct(F.col("func").alias("f"), F.array("sample_count", "self", "subtree").alias("c")))
    return functions.join(libraries.withColumnRenamed("self", "lib_self"), [*keys, "lib"]).select(
        *keys, "lib", "lib_self", entry.alias("value"))


def tree_entries(tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Call tree nodes as ``{"e":self,"s":subtree,"f":func}`` JSON lines under their node and parent ids.

    One line per node, not one nested document per thread, so a tree of any size is many rows.
    """
    value = F.to_json(F.struct(F.col("self").alias("e"), F.col("subtree").alias("s"), F.col("func").alias("f")))
    name = lambda c: F.concat(F.hex(f"{c}.a"), F.lit("-"), F.hex(f"{c}.b")).alias(c)
    return tree.select(*keys, "depth", name("node"), name("parent"), value.alias("value"))


#: Function id of the node above all roots of a call tree.
NO_FUNCTION = -1


def tree_documents(ordered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The nested document of each tree as lines: ``(keys, entry, value)``, to be joined in the order of ``entry``.

    ``ordered`` is a tree with pre-order numbers. Line 0 is the node above all
    roots; every further line opens one node, and closes it and each node whose
    subtree ends with it. So a document is a stream of rows, whatever its size.
    """
    root = ordered.groupBy(*keys).agg(
        F.lit(0).cast("bigint").alias("entry"), F.count(F.lit(1)).alias("exit"), F.lit(1).alias("sibling"), F.lit(0).cast("bigint").alias("self"),
        F.sum(F.when(F.col("depth") == 1, F.col("subtree"))).alias("subtree"), F.lit(NO_FUNCTION).cast("bigint").alias("func"))
    nodes = ordered.select(*root.columns).unionByName(root)
    # What ends at a line ends with its node, which has none below; only such lines meet the nodes above them.
    inner, leaves = nodes.filter("entry < exit"), nodes.filter("entry >= exit")
    closed = inner.groupBy(*keys, F.col("exit").alias("entry")).agg(F.count(F.lit(1)).cast("int").alias("_above"))
    ended = leaves.join(closed, [*keys, "entry"], "left").withColumn("_ends", 1 + F.coalesce("_above", F.lit(0))).drop("_above")
    value = F.concat(
        F.when(F.col("sibling") > 1, F.lit(",")).otherwise(F.lit("")), F.lit('{"e":'), F.col("self").cast("string"), F.lit(',"s":'),
        F.col("subtree").cast("string"), F.lit(',"f":'), F.col("func").cast("string"), F.lit(',"c":['), F.repeat(F.lit("]}"), F.col("_ends")))
    return inner.withColumn("_ends", F.lit(0)).unionByName(ended).select(*keys, "entry", value.alias("value"))


def write_tree_documents(lines: DataFrame, keys: Sequence[str], root: str) -> None:
    """One folder per tree; its files in name order are the document, cut between lines."""
    lines.repartitionByRange(*keys, "entry").sortWithinPartitions(*keys, "entry").select(*keys, "value").write.mode(
        "overwrite").partitionBy(*keys).text(root)


def frame_entries(totals: DataFrame, functions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames as ``[total,[func,self,subtree,...]]``; a frame's list is bounded by its distinct functions."""
    triple = F.array("func", "self", "subtree")
    lists = functions.groupBy(*keys, "frame_idx").agg(F.flatten(F.array_sort(F.collect_list(triple))).alias("_funcs"))
    data = F.to_json(F.coalesce("_funcs", F.array().cast("array<bigint>")))
    return totals.join(lists, [*keys, "frame_idx"], "left").select(
        *keys, "frame_idx", F.concat(F.lit("["), F.col("total").cast("string"), F.lit(","), data, F.lit("]")).alias("value"))

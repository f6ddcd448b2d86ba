"""Data quality: warnings, coverage checks and the quality table.

Session documents (``manifest``, ``loss``) are flat frames with one row per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaprof.functions.names import UNKNOWN_FUNCTION
from lumaprof.functions.paths import warns_without_symbols

SESSION = "session_id"

# --- fixed values: message texts ---------------------------------------------------
NO_ROWS = ("No source rows were generated. Check source_root_hints/path_remaps and source file availability.")
NO_SAMPLED = ("No sampled source rows were attributed. PMU/SPE samples exist, but no sample address resolved to "
              "source; check --elf debug ELF paths/build-id matching first, then source roots/path remaps.")
NO_FUNCTIONS = ("No source rows contain function names. This usually means no matching unstripped debug ELF/DWARF "
                "was available; pass debug ELF files or directories with --elf and verify build IDs.")
NO_SAMPLED_FUNCTIONS = ("Sampled source rows were attributed, but none include function names. Check whether matched "
                        "ELF files contain function/debug information.")
CPU_COVERAGE = ("PMU sample CPU coverage is incomplete: selected CPUs [", "], observed sample CPUs [",
                "]. If observed CPUs are unexpectedly limited, check ", " PERF_SAMPLE_CPU parsing/capture.")
EVENT_COVERAGE = ("PMU samples only contain event(s) [",
                  "]. Metrics requiring instructions/cache/branch events, such as CPI, MIPS, cache hit rate, and "
                  "branch miss rate, will be Missing unless those PMU events are captured.")
NO_SYMBOL_FILE = "Debug ELF Missing for "
STRIPPED_FILE = ("Debug ELF for ", " matched ",
                 ", but it has no DWARF .debug_line/.debug_info sections. Source Lines cannot be generated from this "
                 "stripped ELF; use an unstripped device library or enable local program analysis with an unstripped ELF.")
SYMBOLS_PENDING = "Will be populated by symbol matching stage"
ATTRIBUTION_PENDING = "Will be populated after address-to-line attribution"


def _warn(rows: DataFrame, test: Column, text: Column) -> DataFrame:
    return rows.filter(test).select(SESSION, text.alias("warning"))


def lane_warnings(manifest: DataFrame, loss: DataFrame) -> DataFrame:
    """Unavailable lanes and lost data, per session."""
    def lane(name: str) -> DataFrame:
        reason = F.coalesce(F.col(f"{name}_missing_reason"), F.lit("unknown"))
        return _warn(manifest, ~F.col(f"{name}_available"), F.concat(F.lit(f"{name.upper()} Missing: "), reason))

    def lost(column: str, label: str) -> DataFrame:
        return _warn(loss, F.col(column) > 0, F.concat(F.lit(f"{label}: "), F.col(column).cast("string")))

    return (lane("pmu").unionByName(lane("spe"))
            .unionByName(lost("pmu_lost_records", "PMU lost records"))
            .unionByName(lost("spe_decode_errors", "SPE decode errors")))


def _ids(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)).cast("array<string>"), ",")


def coverage_warnings(totals: DataFrame, selected: DataFrame, recorder: str = "recorder") -> DataFrame:
    """Fewer cpus seen than selected, and at most one known event, where there are samples.

    ``totals`` is ``(session_id, sample_count, cpus, event_keys)``, ``selected`` is ``(session_id, selected_cpus)``.
    """
    rows = totals.join(selected, SESSION).filter("sample_count > 0")
    wanted = F.size(F.array_distinct("selected_cpus"))
    cpus = _warn(rows, (wanted > 1) & (F.size("cpus") < wanted), F.concat(
        F.lit(CPU_COVERAGE[0]), _ids(F.col("selected_cpus")), F.lit(CPU_COVERAGE[1]), _ids(F.col("cpus")),
        F.lit(CPU_COVERAGE[2] + recorder + CPU_COVERAGE[3])))
    events = _warn(rows, F.size("event_keys") <= 1, F.concat(
        F.lit(EVENT_COVERAGE[0]), F.array_join(F.array_sort("event_keys"), ","), F.lit(EVENT_COVERAGE[1])))
    return cpus.unionByName(events)


def attribution_warnings(rows: DataFrame, has_samples: bool) -> DataFrame:
    """What the finished line rows say about symbol and source matching."""
    name = F.trim("function")
    named = (name != "") & (name != UNKNOWN_FUNCTION)
    sampled = (F.col("self_weight") > 0) | (F.col("accumulated_weight") > 0)
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(sampled).alias("sampled"),
                      F.count_if(named).alias("named"), F.count_if(sampled & named).alias("both"))
    any_rows = F.col("rows") > 0
    found = F.filter(F.array(
        F.when(~any_rows, F.lit(NO_ROWS)),
        F.when(any_rows & F.lit(has_samples) & (F.col("sampled") == 0), F.lit(NO_SAMPLED)),
        F.when(any_rows & (F.col("named") == 0), F.lit(NO_FUNCTIONS)),
        F.when((F.col("named") > 0) & (F.col("sampled") > 0) & (F.col("both") == 0), F.lit(NO_SAMPLED_FUNCTIONS)),
    ), lambda w: w.isNotNull())
    return counts.select(F.explode(found).alias("warning"))


def symbol_file_warnings(matches: DataFrame) -> DataFrame:
    """App-native modules whose symbol file is missing, or stripped of line information."""
    wanted = matches.filter(warns_without_symbols(F.col("module_id"), F.col("runtime_path")))
    lost = F.col("quality") == "missing"
    stripped = F.concat(
        F.lit(STRIPPED_FILE[0]), F.col("module_id"), F.lit(STRIPPED_FILE[1]),
        F.coalesce("candidate_path", F.lit("<unknown>")), F.lit(STRIPPED_FILE[2]))
    text = F.when(lost, F.concat(F.lit(NO_SYMBOL_FILE), F.col("module_id"))).when(
        ~F.col("has_debug_info"), stripped)
    return wanted.select("module_id", text.alias("warning")).filter("warning is not null")


def quality_table(manifest: DataFrame, loss: DataFrame) -> DataFrame:
    """Seven checks per session: lanes, losses, and two that a report cannot judge."""
    rows = manifest.join(loss, SESSION)

    def lane(check: str, name: str) -> Column:
        state = F.when(F.col(f"{name}_available"), F.lit("OK")).otherwise(F.lit("Missing"))
        return _check(check, state, F.coalesce(F.col(f"{name}_missing_reason"), F.lit(f"{name.upper()} lane accepted")))

    def lost(check: str, column: str) -> Column:
        state = F.when(F.col(column) == 0, F.lit("OK")).otherwise(F.lit("Warning"))
        return _check(check, state, F.col(column).cast("string"))

    checks = F.array(
        lane("PMU capability", "pmu"), lane("SPE capability", "spe"),
        lost("PMU lost records", "pmu_lost_records"), lost("Ring buffer overrun", "ring_buffer_overruns"),
        lost("SPE decode errors", "spe_decode_errors"),
        _check("ELF match quality", F.lit("Pending"), F.lit(SYMBOLS_PENDING)),
        _check("Source attribution rate", F.lit("Pending"), F.lit(ATTRIBUTION_PENDING)))
    return rows.select(SESSION, F.posexplode(checks).alias("ordinal", "c")).select(SESSION, "ordinal", "c.*")


def _check(name: str, status: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"))


def overall(loss: DataFrame) -> DataFrame:
    clean = (F.col("pmu_lost_records") == 0) & (F.col("ring_buffer_overruns") == 0) & (F.col("spe_decode_errors") == 0)
    return loss.select(SESSION, F.when(clean, F.lit("OK")).otherwise(F.lit("Warning")).alias("overall"))


def summary_fields(manifest: DataFrame, loss: DataFrame) -> DataFrame:
    """Field/value rows of the summary sheet, in order."""
    rows = manifest.join(overall(loss), SESSION)
    flag = lambda c: F.col(c).cast("string")
    lane = lambda n: F.concat(F.lit("enabled="), flag(f"{n}_enabled"), F.lit(", available="), flag(f"{n}_available"))
    pairs = (
        ("Session", F.col(SESSION)), ("Target package", F.coalesce("target_package", F.lit(""))),
        ("PID", F.coalesce(F.col("pid").cast("string"), F.lit("n/a"))),
        ("Duration ms", F.coalesce(F.col("duration_ms").cast("string"), F.lit("partial"))),
        ("ABI", F.col("abi")),
        ("Selected CPUs", F.array_join(F.col("selected_cpus").cast("array<string>"), ", ")),
        ("Selected clusters", F.array_join("selected_clusters", ", ")),
        ("PMU lane", lane("pmu")), ("SPE lane", lane("spe")),
        ("PMU buffer pages", F.col("pmu_buffer_pages").cast("string")),
        ("SPE AUX buffer bytes", F.coalesce(F.col("spe_aux_buffer_bytes").cast("string"), F.lit("n/a"))),
        ("Overall quality", F.col("overall")),
        ("HTML report path", F.col("html_path")), ("XLSX report path", F.col("xlsx_path")),
    )
    fields = F.array(*[F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in pairs])
    return rows.select(SESSION, F.posexplode(fields).alias("ordinal", "f")).select(SESSION, "ordinal", "f.*")

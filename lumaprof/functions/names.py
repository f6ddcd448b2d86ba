"""Fixed vocabularies: metric keys, categories, classes and limits.

The values below are part of the report format and must stay as they are.
"""

from __future__ import annotations

# --- fixed values: counter columns -----------------------------------------
RAW_PMU_COLUMNS = (
    "cpu_cycles", "inst_retired",
    "l1d_cache_access", "l1d_cache_refill",
    "l2d_cache_access", "l2d_cache_refill",
    "l3d_cache_access", "l3d_cache_refill",
    "ll_cache_read", "ll_cache_read_miss",
    "branch_retired", "branch_mispredict",
    "stall_frontend", "stall_backend",
)

# Derived metric -> the counters it needs before its column is shown.
DERIVED_PMU_INPUTS = {
    "cpi": ("cpu_cycles", "inst_retired"),
    "l1d_cache_hit_rate": ("l1d_cache_access", "l1d_cache_refill"),
    "l2d_cache_hit_rate": ("l2d_cache_access", "l2d_cache_refill"),
    "l3d_cache_hit_rate": ("l3d_cache_access", "l3d_cache_refill"),
    "branch_miss_rate": ("branch_mispredict", "branch_retired"),
    "mpki": ("l1d_cache_refill", "inst_retired"),
    "mips": ("inst_retired",),
    "mcps": ("cpu_cycles",),
}

SPE_COLUMNS = (
    "spe_sample_count", "spe_latency_cycles_avg", "spe_cache_hit_rate",
    "spe_branch_miss_rate", "spe_decode_errors",
)

# --- fixed values: the 44 SPE categories, in report order -------------------
SPE_CATEGORY_NAMES = (
    "load_l1", "load_l2", "load_l3", "load_llc", "load_peer_core",
    "load_peer_cluster", "load_system_cache", "load_dram", "load_remote",
    "load_io", "load_unknown",
    "store_l1", "store_l2", "store_l3", "store_llc", "store_peer_core",
    "store_peer_cluster", "store_system_cache", "store_dram", "store_remote",
    "store_io", "store_unknown",
    "atomic_l1", "atomic_l2", "atomic_l3", "atomic_peer_core",
    "atomic_peer_cluster", "atomic_system_cache", "atomic_dram",
    "atomic_remote", "atomic_unknown",
    "branch_hit", "branch_miss", "branch_unknown",
    "compute_int", "compute_fp_simd", "compute_crypto", "compute_unknown",
    "frontend_or_decode", "system_instruction", "exception_or_trap",
    "decode_unknown", "data_source_unknown", "other_unknown",
)

# --- fixed values: instruction classes and load kinds, in report order ------
INSTRUCTION_CLASS_NAMES = (
    "compute_int", "compute_fp_simd", "compute_crypto", "system_instruction",
    "barrier_or_sync", "scalar_load", "scalar_store", "vector_load",
    "vector_store", "atomic", "acquire_release", "prefetch", "branch",
    "unknown_instruction", "missing_instruction",
)

LOAD_KIND_NAMES = (
    "load_scalar_single", "load_scalar_pair", "load_sign_extend",
    "load_vector_single", "load_vector_pair", "load_literal",
    "load_atomic_exclusive", "load_acquire", "load_prefetch", "load_unknown",
)

# --- fixed values: latency metrics of one category, class or kind ------------
LATENCY_METRICS = (
    "min_latency_cycles", "max_latency_cycles", "avg_latency_cycles",
    "std_latency_cycles", "p95_latency_cycles", "p99_latency_cycles",
    "over_p95_est_time_pct", "over_avg_est_time_pct",
    "over_p95_all_est_time_pct", "over_avg_all_est_time_pct",
)
CATEGORY_METRICS = ("sample_pct", "spe_latency_pct", "est_time_pct", *LATENCY_METRICS)
BREAKDOWN_METRICS = ("sample_pct", "est_time_pct", "all_est_time_pct", *LATENCY_METRICS)

# --- fixed values: limits and defaults ---------------------------------------
DEFAULT_PAGE_SIZE = 1000
HISTOGRAM_BUCKETS = 20
MARKER_GAP_NS = 1_000_000
FRAME_MARKERS = (
    ("GameThread", "FVulkanViewport::Present"),
    ("RHIThread", "FVulkanViewport::Present"),
    ("RenderThread", "FVulkanViewport::Present"),
)
BOUNDARY_THREAD = "RHIThread"
UNKNOWN_EVENT = "unknown_event"
UNKNOWN_FUNCTION = "<unknown>"
NO_LATENCY = "SPE latency field unavailable"

# Key prefix of each dimension in metric names.
DIMENSION_PREFIX = {"category": "", "class": "instruction_class.", "kind": "load_instruction."}
DIMENSION_NAMES = {
    "category": SPE_CATEGORY_NAMES,
    "class": INSTRUCTION_CLASS_NAMES,
    "kind": LOAD_KIND_NAMES,
}


def dimension_metric_keys(dimension: str) -> list[str]:
    """Generated column names of one dimension, e.g. ``load_l1.sample_pct``."""
    prefix = DIMENSION_PREFIX[dimension]
    return [f"{prefix}{name}.{metric}"
            for name in DIMENSION_NAMES[dimension] for metric in CATEGORY_METRICS]


def spe_column_keys() -> list[str]:
    return [*SPE_COLUMNS, *dimension_metric_keys("category")]

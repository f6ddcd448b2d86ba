"""Explicit schemas of the bundle documents; unknown JSON fields are ignored."""

from __future__ import annotations

_VERSION = "struct<major:int, minor:int, patch:int>"
_LANE = "struct<enabled:boolean, available:boolean, missing_reason:string>"
_SUMMARY = ("struct<spe:boolean, cycles:boolean, instructions:boolean, cache:boolean, branch:boolean, "
            "callchain:boolean, source_sample_fields:boolean>")
_LOSS = ("struct<pmu_lost_records:bigint, ring_buffer_overruns:bigint, reader_lag_records:bigint, "
         "spe_aux_truncations:bigint, spe_decode_errors:bigint, dropped_records:bigint>")

DOCUMENTS = {
    "manifest": f"""
        `schema` struct<name:string, version:{_VERSION}, min_reader_version:{_VERSION}>,
        producer struct<name:string, version:string, git_revision:string>,
        session_id string, created_utc string,
        recording struct<started_utc:string, ended_utc:string, duration_ms:bigint>,
        device struct<serial:string, model:string, manufacturer:string, android_release:string,
                      android_sdk:int, android_build_fingerprint:string, abi:string>,
        target struct<package:string, pid:bigint, process_name:string>,
        cpu struct<selected_cpus:array<int>, selected_clusters:array<string>>,
        lanes struct<pmu:{_LANE}, spe:{_LANE}>,
        capture_options struct<sample_period:bigint, callchain_depth:int, pmu_buffer_pages:int,
                               requested_event_keys:array<string>, spe_aux_buffer_bytes:bigint,
                               duration_ms_requested:bigint>,
        inputs struct<debug_elf_hints:array<string>, source_root_hints:array<string>,
                      path_remaps:array<struct<`from`:string, `to`:string>>>,
        artifacts struct<files:array<struct<path:string, role:string, required:boolean, encoding:string>>,
                         report_paths:struct<html:string, xlsx:string, json:string, csv_dir:string>>,
        compatibility string""",
    "capability": f"""
        session_id string,
        cpus array<struct<cpu:int, cluster:string, summary:{_SUMMARY},
            details:array<struct<event_key:string, raw_event_name:string, event_source:string, `type`:string,
                config:string, supported:boolean, errno:int, failure_reason:string, kernel_path:string,
                sysfs_path:string>>,
            spe:struct<device_path:string, aux_supported:boolean, min_interval:bigint, raw_metadata:string>>>,
        clusters array<struct<cluster:string, cpus:array<int>, summary:{_SUMMARY}>>""",
    "maps": """
        session_id string,
        maps array<struct<mapping_id:bigint, start:bigint, `end`:bigint, permissions:string, offset:bigint,
                          device:string, inode:bigint, path:string, module_id:string, load_bias:bigint>>""",
    "threads": """
        session_id string,
        threads array<struct<pid:bigint, tid:bigint, tgid:bigint, thread_name:string, process_name:string,
                             first_seen_utc:string, last_seen_utc:string, cpu_affinity:array<int>>>""",
    "build_ids": """
        session_id string,
        modules array<struct<module_id:string, runtime_path:string, build_id:string, soname:string,
                             file_size:bigint, mtime_utc:string, debug_elf_candidate_path:string,
                             match_status:string>>""",
    "loss": f"""
        session_id string, totals {_LOSS},
        by_event_cpu array<struct<event_key:string, cpu:int, run_id:string, counts:{_LOSS}>>""",
    "event_catalog": """
        session_id string,
        events array<struct<event_key:string, display_name:string, source:string, `type`:string, config:string,
                            arm_arch_event_code:string, sample_period:bigint, unit:string,
                            semantic_tags:array<string>,
                            per_cpu_support:array<struct<cpu:int, supported:boolean, reason:string>>>>""",
    "metric_catalog": """
        session_id string,
        metrics array<struct<metric_key:string, display_name:string, formula:string, unit:string,
                             required_events:array<string>, fallback_events:array<string>,
                             missing_behavior:string, physical_meaning:string>>""",
    "event_runs": """
        session_id string,
        runs array<struct<run_id:string, event_key:string, cpu:int, pid_scope:bigint, tid_scope:bigint,
                          start_timestamp_ns:bigint, end_timestamp_ns:bigint, time_enabled_ns:bigint,
                          time_running_ns:bigint, raw_count:bigint, scaled_count:double, sample_count:bigint,
                          sample_weight_sum:bigint, lost_count:bigint>>""",
}

PMU_SAMPLE = ("path string, flags bigint, event_run_ref bigint, event_key_ref bigint, sample_kind int, pid bigint, "
              "tid bigint, cpu bigint, mapping_id bigint, timestamp_ns bigint, ip bigint, period bigint, "
              "callchain array<bigint>")
SPE_SAMPLE = ("path string, flags bigint, event_run_ref bigint, pid bigint, tid bigint, cpu bigint, mapping_id bigint, "
              "timestamp_ns bigint, ip bigint, latency bigint, operation_flags bigint, event_flags bigint, "
              "cache_level int, cache_result int, branch_result int, data_source int, decode_status int, "
              "raw_packet_offset bigint")

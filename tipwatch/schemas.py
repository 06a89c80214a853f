"""Explicit schemas of every source, as DDL text."""

MEASUREMENT_COLUMNS = ["metric", "unit", "value", "more_is_better", "kernel_version", "instance_id", "instance_type", "arch"]

LOG_EVENT = "stream STRING, ts TIMESTAMP, seq BIGINT, message STRING"

STAGE_STATS = (
    "run_prefix STRING, exit_code INT, runtime_seconds BIGINT, last_run_runtime_seconds BIGINT, start_time BIGINT,"
    " end_time BIGINT, success BOOLEAN, total_runs INT, completed_runs INT, failed_at_run INT"
)

MANIFEST = (
    "schema_version INT, generated_at STRING, run_prefix STRING, s3_bucket STRING, origin STRING,"
    " artifacts ARRAY<STRUCT<test: STRING, instance_id: STRING, kind: STRING, role: STRING, status: STRING, s3_uri: STRING,"
    " log_url: STRING, local_path: STRING, sha256: STRING, size_bytes: BIGINT, content_type: STRING>>"
)

JOB_EVENT = (
    "timestamp STRING, node STRUCT<id: STRING, kind: STRING, parent: STRING, state: STRING, result: STRING,"
    " data: STRUCT<runtime: STRING, platform: STRING, job_id: STRING, error_code: STRING, error_msg: STRING>,"
    " artifacts: MAP<STRING, STRING>>"
)

JOB_DEFINITION = (
    "environment STRUCT<arch: STRING, platform: STRING>,"
    " artifacts STRUCT<kernel: STRING, modules: STRING, rootfs: STRING, ramdisk: STRING>,"
    " tests ARRAY<STRUCT<id: STRING, type: STRING>>, timeout STRING"
)

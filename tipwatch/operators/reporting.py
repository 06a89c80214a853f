"""Artifact manifests, report rows and node outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipwatch.functions import report
from tipwatch.operators.chunks import ENTRY, documents

MANIFEST_VERSION = 1
CONSOLE_FILE = "console-output.log"
CONSOLE_TYPE = "text/plain; charset=utf-8"
INFRASTRUCTURE = "Infrastructure"
BAD_JOB = "invalid_job_params"
_KEYS = ["run_prefix", "test", "instance_id"]


def object_digest(objects: DataFrame) -> DataFrame:
    """sha256, size and type of binary contents."""
    return objects.withColumns(
        {
            "sha256": F.sha2("content", 256),
            "size_bytes": F.octet_length("content").cast("long"),
            "content_type": F.lit(CONSOLE_TYPE),
        }
    ).drop("content")


def manifest_entries(instances: DataFrame, consoles: DataFrame, bucket: str, region: str) -> DataFrame:
    """An entry per instance: ready with address and digest where its console landed, missing elsewhere.

    ``instances(run_prefix, test, instance_id)``; ``consoles`` adds sha256 and size_bytes.
    """
    key = F.concat("run_prefix", F.lit("/test_"), "test", F.lit("/output/"), "instance_id", F.lit("/" + CONSOLE_FILE))
    joined = instances.join(consoles.select(*_KEYS, "sha256", "size_bytes"), _KEYS, "left").withColumn("_key", key)
    ready = F.col("sha256").isNotNull()
    return joined.select(
        *_KEYS,
        F.lit(CONSOLE_FILE).alias("kind"),
        F.lit("log").alias("role"),
        F.when(ready, "ready").otherwise("missing").alias("status"),
        F.concat(F.lit(f"s3://{bucket}/"), "_key").alias("s3_uri"),
        F.when(ready, report.public_url(F.lit(bucket), F.lit(region), F.col("_key"))).alias("log_url"),
        F.when(ready, F.concat(F.lit("vms/"), "instance_id", F.lit("-console.log"))).alias("local_path"),
        "sha256",
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.lit(CONSOLE_TYPE).alias("content_type"),
    )


def manifest_documents(entries: DataFrame, bucket: str, origin: str | None = None, generated_at: Column | None = None) -> DataFrame:
    """The manifest as JSON documents ``(run_prefix, part, id, document)``: a header per run, one for each entry."""
    stamp = generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")
    body = F.struct(
        F.lit(MANIFEST_VERSION).alias("schema_version"),
        stamp.alias("generated_at"),
        "run_prefix",
        F.lit(bucket).alias("s3_bucket"),
        F.lit(origin).cast("string").alias("origin"),
    )
    heads = entries.select("run_prefix").distinct().select("run_prefix", body.alias("body"))
    each = entries.select("run_prefix", F.concat_ws("/", "test", "instance_id").alias("id"), F.struct(*entries.columns).alias("body"))
    return documents(heads, each, ["run_prefix"])


def join_log_urls(instances: DataFrame, urls: DataFrame) -> DataFrame:
    """Result rows ``(run_prefix, test, instance_id, status)`` with their console address, matched on the original
    test name before boot tests get their common path."""
    return instances.join(urls, _KEYS, "left").select(
        *_KEYS, report.test_path(F.col("test")).alias("name"), F.coalesce("status", F.lit("ERROR")).alias("status"), "log_url"
    )


def legacy_results(summaries: DataFrame) -> DataFrame:
    """Result rows of summaries without a per-instance list: ``(run_prefix, test_names, failed_by_test, failure_url)``."""
    rows = summaries.select("run_prefix", "failed_by_test", "failure_url", F.posexplode("test_names").alias("idx", "test"))
    failed = F.coalesce(F.size(F.try_element_at("failed_by_test", F.col("test"))) > 0, F.lit(False))
    return rows.select(
        "run_prefix",
        "idx",
        report.test_path(F.col("test")).alias("name"),
        F.when(failed, "FAIL").otherwise("PASS").alias("status"),
        F.col("failure_url").alias("log_url"),
    )


def row_ids(node_id: Column, instance_id: Column, idx: Column) -> Column:
    """Stable id: by instance where known, else by position in the job's result list."""
    return F.concat_ws(".", node_id, F.coalesce(F.nullif(instance_id, F.lit("")), idx.cast("string")))


def build_report_rows(rows: DataFrame, origin: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) report rows from ``(test_id, build_id, path, status, duration_ms, log_url, misc MAP)``.

    ``output_files ARRAY<STRUCT<name, url>>`` may be there too. Empty optionals become null, which the JSON sink leaves out. With ``strict`` a bad path or origin fails the job.
    """
    ok = report.valid_path(F.col("path")) & report.valid_origin(F.lit(origin))
    built = rows.select(
        F.concat(F.lit(origin + ":"), "test_id").alias("id"),
        "build_id",
        F.lit(origin).alias("origin"),
        "path",
        report.report_status(F.col("status")).alias("status"),
        (F.col("duration_ms").cast("double") / 1000.0).alias("duration"),
        F.nullif("log_url", F.lit("")).alias("log_url"),
        *([F.when(F.size("output_files") > 0, F.col("output_files")).alias("output_files")] if "output_files" in rows.columns else []),
        F.when(F.size("misc") > 0, F.col("misc")).alias("misc"),
    )
    if strict:
        message = F.concat(F.lit("invalid report path or origin: "), F.coalesce("path", F.lit("null")))
        checked = F.when(ok, F.col("path")).otherwise(F.raise_error(message))
        return built.withColumn("path", checked), built.limit(0)
    return built.filter(ok), built.filter(~ok)


def job_report_rows(jobs: DataFrame, results: DataFrame, node_key: str = "node_id", origin: str | None = None) -> DataFrame:
    """Rows for ``build_report_rows`` of claimed jobs, one for each result and one for a job that has none to show.

    ``jobs(node_id, build_id, log_url, fetch_error, translate_error, run_error)``, ``results(node_id, idx, name, status,
    duration_ms, log_url, instance_id)``. A job whose execution failed has an infrastructure row, one that gave no
    results a boot row with a note, one that never ran (bad or unreachable definition) none. A result without an address
    has the job's, one without a name its position as name; a job without a build gets a placeholder, of the ``origin``
    if that is given. ``node_key`` is what the receiver calls the node. ``output_files`` of results are passed on.
    """
    unknown = F.concat(F.lit(f"{origin}:unknown_" if origin else "unknown_"), "node_id")
    ran = jobs.filter("fetch_error is null and translate_error is null").withColumn(
        "build_id", F.coalesce(F.nullif("build_id", F.lit("")), unknown)
    )
    files = ["output_files"] if "output_files" in results.columns else []
    misc = lambda key, value: F.map_from_arrays(F.array(F.lit(node_key), F.lit(key)), F.array(F.col("node_id"), value))
    node_only = F.create_map(F.lit(node_key), F.col("node_id"))
    none = F.lit(None).cast("long")
    well, broken = ran.filter("run_error is null"), ran.filter("run_error is not null")
    named = results.select(
        "node_id", "idx", "name", "status", F.col("duration_ms").cast("long").alias("duration_ms"), F.col("log_url").alias("_own"), F.nullif("instance_id", F.lit("")).alias("instance_id"), *files
    )
    shown = well.select("node_id", "build_id", "log_url").join(named, "node_id").select(
        F.concat_ws(".", "node_id", F.coalesce("instance_id", F.col("idx").cast("string"))).alias("test_id"),
        "build_id",
        F.coalesce("name", F.concat(F.lit("test_"), F.col("idx").cast("string"))).alias("path"),
        F.coalesce("status", F.lit("error")).alias("status"),
        "duration_ms",
        F.coalesce(F.nullif("_own", F.lit("")), "log_url").alias("log_url"),
        F.when(F.col("instance_id").isNull(), node_only).otherwise(misc("instance_id", F.col("instance_id"))).alias("misc"),
        *files,
    )
    first = F.concat("node_id", F.lit(".0")).alias("test_id")
    # fixed names and note of rows about the infrastructure
    failed = broken.select(first, "build_id", F.lit("boot.infrastructure").alias("path"), F.lit("error").alias("status"), none.alias("duration_ms"), F.lit(None).cast("string").alias("log_url"), node_only.alias("misc"))
    empty = well.join(results.select("node_id"), "node_id", "left_anti").select(
        first, "build_id", F.lit("boot").alias("path"), F.lit("error").alias("status"), none.alias("duration_ms"), "log_url",
        misc("note", F.lit("executor returned no per-test results")).alias("misc"),
    )
    return shown.unionByName(failed, allowMissingColumns=True).unionByName(empty, allowMissingColumns=True)


def node_result(statuses: DataFrame) -> DataFrame:
    """Per node, from its result rows: any FAIL/ERROR/MISS fails it, else PASS/DONE passes, else SKIP, else fail."""
    seen = {n: F.bool_or(F.col("status").isin(*w)) for n, w in (("bad", ["FAIL", "ERROR", "MISS"]), ("good", ["PASS", "DONE"]), ("skipped", ["SKIP"]))}
    result = F.when(seen["bad"], "fail").when(seen["good"], "pass").when(seen["skipped"], "skip").otherwise("fail")
    return statuses.groupBy("node_id").agg(result.alias("result"), F.count("*").alias("rows"))


def node_outcome(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Result and error per claimed node.

    ``jobs(node_id, fetch_error, translate_error, run_error)``; an infrastructure trouble makes the node incomplete,
    a bad definition too; otherwise its test results decide, and none at all is an infrastructure trouble.
    """
    joined = jobs.join(node_result(results), "node_id", "left")
    fetch, translate, run = F.col("fetch_error"), F.col("translate_error"), F.col("run_error")
    empty = F.col("rows").isNull()
    bad = F.coalesce(fetch, translate, run).isNotNull() | empty
    return joined.select(
        "node_id",
        F.when(bad, "incomplete").otherwise(F.col("result")).alias("result"),
        F.when(fetch.isNotNull(), INFRASTRUCTURE)
        .when(translate.isNotNull(), BAD_JOB)
        .when(bad, INFRASTRUCTURE)
        .alias("error_code"),
        F.when(fetch.isNotNull(), F.concat(F.lit("failed to fetch job_definition: "), fetch))
        .when(translate.isNotNull(), F.concat(F.lit("job translation failed: "), translate))
        .when(run.isNotNull(), F.concat(F.lit("job execution failed: "), run))
        .when(empty, "executor returned no per-test results")
        .alias("error_msg"),
    )


def merge_artifacts(old: Column, urls: Column) -> Column:
    """Node artifacts plus ``test_log``, ``test_log_1``, ... for the addresses in order; new keys win, others stay."""
    names = F.transform(urls, lambda u, i: F.when(i == 0, F.lit("test_log")).otherwise(F.concat(F.lit("test_log_"), i.cast("string"))))
    current = F.coalesce(old, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(current, lambda k, _: ~F.array_contains(names, k))
    return F.map_concat(kept, F.map_from_arrays(names, urls))


def report_documents(rows: DataFrame, build_id: str | None = None, origin: str | None = None) -> DataFrame:
    """Tests-only report documents ``(build_id, part, id, document)``, a valid one for each row.

    A receiver takes any number of documents for a build, so none needs to hold all its tests. Rows lacking build or
    origin get the given ones; empty optionals are left out.
    """
    filled = rows.withColumns(
        {
            "build_id": F.coalesce("build_id", F.lit(build_id)),
            "origin": F.coalesce("origin", F.lit(origin)),
        }
    )
    row = F.to_json(F.struct(*rows.columns))
    major, minor = report.REPORT_VERSION
    head = F.lit('{"checkouts":[],"builds":[],"tests":[')
    tail = F.lit(f'],"version":{{"major":{major},"minor":{minor}}}}}')
    return filled.select("build_id", F.lit(ENTRY).alias("part"), "id", F.concat(head, row, tail).alias("document"))

"""Registered queries: manifests, report rows, node outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch import sinks
from tipwatch.functions import report
from tipwatch.operators import reporting
from tipwatch.plans import fixed
from tipwatch.plans.registry import query
from tipwatch.plans.views import table, view, view_sql
from tipwatch.session import materialise, scratch_path
from tipwatch.sources import objects

BUCKET, REGION, ORIGIN = "results", "us-west-2", "lab_1"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---------------------------------------------------------------- inventory and manifest

_PLACES = (
    view_sql("objects")
    + r""", placed AS (SELECT *, split_part(key, '/', 1) AS run_prefix, substr(split_part(key, '/', 2), 6) AS test, split_part(key, '/', 4) AS instance_id
         FROM objects WHERE key LIKE '%/output/%' AND o_orderkey % 19 <> 0)
"""
)


@query("scan_instances", _PLACES + "SELECT DISTINCT run_prefix, test, instance_id FROM placed")
def scan_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.discover_instances(view(spark, sf_dir, "objects"))


_BODY = "concat('boot log of ', cast(o_orderkey as string), case when o_orderkey % 2 = 0 then ' é' else '' end)"


@query("object_digest", f"SELECT o_orderkey, sha256({_BODY}) AS sha256, CAST(strlen({_BODY}) AS BIGINT) AS size_bytes, 'text/plain; charset=utf-8' AS content_type FROM orders")
def object_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    binary = table(spark, sf_dir, "orders").select("o_orderkey", F.encode(F.expr(_BODY), "UTF-8").alias("content"))
    return reporting.object_digest(binary)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = view(spark, sf_dir, "objects")
    consoles = keys.filter("key like '%/output/%/console-output.log'")
    digested = reporting.object_digest(consoles.select("key", F.encode(F.expr(_BODY), "UTF-8").alias("content")))
    place = objects.layout(F.col("key"))
    named = digested.select(*[place[n].alias(n) for n in ("run_prefix", "test", "instance_id")], "sha256", "size_bytes").filter("run_prefix is not null")
    return reporting.manifest_entries(objects.discover_instances(keys), named, BUCKET, REGION)


_ENTRIES = (
    _PLACES
    + f""", e AS (SELECT DISTINCT run_prefix, test, instance_id, 'console-output.log' AS kind, 'log' AS role,
  CASE WHEN key LIKE '%/console-output.log' THEN 'ready' ELSE 'missing' END AS status,
  concat('s3://{BUCKET}/', run_prefix, '/test_', test, '/output/', instance_id, '/console-output.log') AS s3_uri,
  CASE WHEN key LIKE '%/console-output.log' THEN concat('https://{BUCKET}.s3.{REGION}.amazonaws.com/', run_prefix, '/test_', test, '/output/', instance_id, '/console-output.log') END AS log_url,
  CASE WHEN key LIKE '%/console-output.log' THEN concat('vms/', instance_id, '-console.log') END AS local_path,
  CASE WHEN key LIKE '%/console-output.log' THEN sha256({_BODY}) END AS sha256,
  CASE WHEN key LIKE '%/console-output.log' THEN CAST(strlen({_BODY}) AS BIGINT) ELSE 0 END AS size_bytes,
  'text/plain; charset=utf-8' AS content_type FROM placed)
"""
)


@query("manifest_ready_missing", _ENTRIES + "SELECT * FROM e")
def manifest_ready_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)


@query(
    "write_manifest",
    _ENTRIES + "SELECT run_prefix, 1 AS schema_version, 'results' AS s3_bucket, 'lab_1' AS origin, test, instance_id, status, coalesce(log_url, '-') AS log_url, size_bytes FROM e",
)
def write_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest documents, written and read back into one row per entry."""
    out = scratch_path(spark, "manifest")
    entries = materialise(_entries(spark, sf_dir), "entries")  # headers and entries are two readers
    sinks.write_documents(reporting.manifest_documents(entries, BUCKET, ORIGIN, F.lit("2024-01-01T00:00:00+00:00")), out)
    shape = "run_prefix string, schema_version int, s3_bucket string, origin string, test string, instance_id string, status string, log_url string, size_bytes long"
    back = spark.read.schema(shape).json(out)
    each = back.filter("instance_id is not null").select("run_prefix", "test", "instance_id", "status", F.coalesce("log_url", F.lit("-")).alias("log_url"), "size_bytes")
    return each.join(back.filter("instance_id is null").select("run_prefix", "schema_version", "s3_bucket", "origin"), "run_prefix")


def _manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest files as the machines leave them, one entry in each, some of them cut off."""
    entries = _entries(spark, sf_dir)
    names = [c for c in entries.columns if c != "run_prefix"]
    whole = F.to_json(F.struct(F.lit(1).alias("schema_version"), "run_prefix", F.array(F.struct(*names)).alias("artifacts")), {"ignoreNullFields": "false"})
    broken = F.col("run_prefix").endswith("7")
    return entries.select("run_prefix", F.when(broken, F.substring(whole, 1, 40)).otherwise(whole).alias("content"))


_URLS = _ENTRIES + ", urls AS (SELECT run_prefix, test, instance_id, log_url FROM e WHERE log_url IS NOT NULL AND test <> '' AND run_prefix NOT LIKE '%7')\n"


@query("scan_manifest", _URLS + "SELECT * FROM urls")
def scan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses from manifest files, some of them cut off."""
    return objects.manifest_log_urls(objects.parse_manifest(_manifest_files(spark, sf_dir)))


_STATUS_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.STATUSES.items())
_STATUS = f"CASE lower(trim(raw_status)) {_STATUS_CASES} ELSE 'ERROR' END"
_PATH = "CASE WHEN lower(trim(test)) IN ('baseline', 'url-kernel-boot', 'boot') THEN 'boot' ELSE test END"


@query(
    "join_log_urls",
    _URLS
    + f""", {view_sql('results')[5:]}
SELECT r.run_prefix, r.test, r.instance_id, {_PATH.replace('test', 'r.test')} AS name, r.raw_status AS status, coalesce(u.log_url, '-') AS log_url
FROM results r LEFT JOIN urls u USING (run_prefix, test, instance_id)""",
)
def join_log_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = view(spark, sf_dir, "results").withColumnRenamed("raw_status", "status")
    urls = objects.manifest_log_urls(objects.parse_manifest(_manifest_files(spark, sf_dir)))
    return reporting.join_log_urls(results, urls).withColumn("log_url", F.coalesce("log_url", F.lit("-")))


# ---------------------------------------------------------------- report rows


@query("to_report_status", view_sql("results") + f"SELECT raw_status, {_STATUS} AS status, count(*) AS n FROM results GROUP BY ALL")
def to_report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "results").groupBy("raw_status").agg(F.count("*").alias("n"))
    return counts.select("raw_status", report.report_status(F.col("raw_status")).alias("status"), "n")


@query("test_path", view_sql("results") + f"SELECT test, {_PATH} AS path, count(*) AS n FROM results GROUP BY ALL")
def test_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "results").groupBy("test").agg(F.count("*").alias("n"))
    return counts.select("test", report.test_path(F.col("test")).alias("path"), "n")


_NAMES = "concat(case p_size % 5 when 0 then 'ltp.' when 1 then 'a b' when 2 then 'x-y_1.' when 3 then '' else 'fs/' end, case when p_partkey % 2 = 0 then p_type else '' end, case when p_size % 7 = 0 then chr(10) else '' end)"


@query(
    "valid_path",
    f"SELECT path, count(*) AS n, regexp_full_match(path, '([a-zA-Z0-9_-]+(\\.[a-zA-Z0-9_-]+)*)?') AS ok FROM (SELECT {_NAMES} AS path FROM part) GROUP BY path",
)
def valid_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.expr(_NAMES).alias("path")).agg(F.count("*").alias("n"))
    return counts.select("path", "n", report.valid_path(F.col("path")).alias("ok"))


_ORIGINS = "case p_size % 4 when 0 then lower(p_brand) when 1 then p_brand when 2 then concat('lab_', cast(p_size as string)) else '' end"


@query(
    "valid_origin",
    f"SELECT origin, count(*) AS n, regexp_full_match(origin, '[a-z0-9_]+') AS ok FROM (SELECT {_ORIGINS} AS origin FROM part) GROUP BY origin",
)
def valid_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.expr(_ORIGINS).alias("origin")).agg(F.count("*").alias("n"))
    return counts.select("origin", "n", report.valid_origin(F.col("origin")).alias("ok"))


def _raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = view(spark, sf_dir, "results")
    url = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://l/"), F.col("o_orderkey").cast("string"))).otherwise("")
    misc = F.when(
        F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("node"), "node_id", F.lit("instance"), "instance_id")
    )
    return results.select(
        reporting.row_ids(F.col("node_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("instance_id")), F.col("o_orderkey")).alias("test_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("b"), (F.col("o_custkey") % 30).cast("string"))).alias("build_id"),
        report.test_path(F.col("test")).alias("path"),
        F.col("raw_status").alias("status"),
        F.when(F.col("o_orderkey") % 4 != 0, F.floor("o_totalprice")).alias("duration_ms"),
        url.alias("log_url"),
        misc.alias("misc"),
    )


_ROWS = (
    view_sql("results")
    + f""", rows_ AS (SELECT concat('{ORIGIN}:', node_id, '.', CASE WHEN o_orderkey % 5 <> 0 THEN instance_id ELSE cast(o_orderkey as string) END) AS id,
  CASE WHEN o_orderkey % 11 <> 0 THEN concat('b', cast(o_custkey % 30 as string)) END AS build_id, '{ORIGIN}' AS origin, {_PATH} AS path, {_STATUS} AS status,
  CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice) / 1000 END AS duration, CASE WHEN o_orderkey % 2 = 0 THEN concat('https://l/', cast(o_orderkey as string)) END AS log_url,
  CASE WHEN o_orderkey % 3 = 0 THEN instance_id END AS misc_instance FROM results)
"""
)


@query(
    "build_report_row",
    _ROWS + "SELECT id, coalesce(build_id, '-') AS build_id, origin, path, status, coalesce(duration, -1) AS duration, coalesce(log_url, '-') AS log_url, coalesce(misc_instance, '-') AS misc_instance FROM rows_",
)
def build_report_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = reporting.build_report_rows(_raw_rows(spark, sf_dir), ORIGIN)
    dash = F.lit("-")
    return valid.select(
        "id",
        F.coalesce("build_id", dash).alias("build_id"),
        "origin",
        "path",
        "status",
        F.coalesce("duration", F.lit(-1.0)).alias("duration"),
        F.coalesce("log_url", dash).alias("log_url"),
        F.coalesce(F.try_element_at("misc", F.lit("instance")), dash).alias("misc_instance"),
    )


# jobs of all customers: some have no orders and so no results, some failed on the way
_JOB_ROWS = (
    view_sql("results")
    + f""", jobs AS (SELECT concat('n', cast(c_custkey as string)) AS node_id, CASE WHEN c_custkey % 7 <> 0 THEN concat('b', cast(c_custkey % 30 as string)) ELSE concat('{ORIGIN}:unknown_n', cast(c_custkey as string)) END AS build_id,
  CASE WHEN c_custkey % 3 = 0 THEN concat('https://job/', cast(c_custkey as string)) END AS job_url, c_custkey % 5 = 0 AS broken FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 19 <> 0),
shown AS (SELECT concat('{ORIGIN}:', node_id, '.', CASE WHEN o_orderkey % 5 <> 0 THEN instance_id ELSE cast(o_orderkey as string) END) AS id, build_id,
  CASE WHEN o_orderkey % 9 = 0 THEN concat('test_', cast(o_orderkey as string)) ELSE {_PATH} END AS path, CASE WHEN o_orderkey % 13 = 0 THEN 'ERROR' ELSE {_STATUS} END AS status,
  CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice) / 1000 END AS duration, CASE WHEN o_orderkey % 2 = 0 THEN concat('https://l/', cast(o_orderkey as string)) ELSE job_url END AS log_url,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('trace.txt=https://f/', cast(o_orderkey as string)) END AS output_files, CASE WHEN o_orderkey % 5 <> 0 THEN instance_id END AS instance, NULL AS note
  FROM results JOIN jobs USING (node_id) WHERE NOT broken),
failed AS (SELECT concat('{ORIGIN}:', node_id, '.0') AS id, build_id, 'boot.infrastructure' AS path, 'ERROR' AS status, NULL AS duration, NULL AS log_url, NULL AS output_files, NULL AS instance, NULL AS note FROM jobs WHERE broken),
empty AS (SELECT concat('{ORIGIN}:', node_id, '.0') AS id, build_id, 'boot' AS path, 'ERROR' AS status, NULL AS duration, job_url AS log_url, NULL AS output_files, NULL AS instance, 'executor returned no per-test results' AS note
  FROM jobs WHERE NOT broken AND node_id NOT IN (SELECT node_id FROM results)),
all_ AS (SELECT * FROM shown UNION ALL SELECT * FROM failed UNION ALL SELECT * FROM empty)
"""
)


def _job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of jobs that ran, that gave no results, that broke off, and that never began."""
    key = F.col("c_custkey")
    jobs = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("n"), key.cast("string")).alias("node_id"),
        F.when(key % 7 != 0, F.concat(F.lit("b"), (key % 30).cast("string"))).alias("build_id"),
        F.when(key % 3 == 0, F.concat(F.lit("https://job/"), key.cast("string"))).alias("log_url"),
        F.when(key % 17 == 0, "no answer").alias("fetch_error"),
        F.when(key % 19 == 0, "no kernel").alias("translate_error"),
        F.when(key % 5 == 0, "lost").alias("run_error"),
    )
    order = F.col("o_orderkey")
    file = F.struct(F.lit("trace.txt").alias("name"), F.concat(F.lit("https://f/"), order.cast("string")).alias("url"))
    results = view(spark, sf_dir, "results").select(
        "node_id",
        order.alias("idx"),
        F.when(order % 9 != 0, report.test_path(F.col("test"))).alias("name"),
        F.when(order % 13 != 0, F.col("raw_status")).alias("status"),
        F.when(order % 4 != 0, F.floor("o_totalprice")).alias("duration_ms"),
        F.when(order % 2 == 0, F.concat(F.lit("https://l/"), order.cast("string"))).alias("log_url"),
        F.when(order % 5 != 0, F.col("instance_id")).alias("instance_id"),
        F.when(order % 6 == 0, F.array(file)).otherwise(F.array().cast("array<struct<name:string,url:string>>")).alias("output_files"),
    )
    return reporting.job_report_rows(jobs, results, origin=ORIGIN)


@query(
    "job_report_rows",
    _JOB_ROWS + "SELECT id, build_id, path, status, coalesce(duration, -1) AS duration, coalesce(log_url, '-') AS log_url, coalesce(output_files, '-') AS output_files, coalesce(instance, '-') AS instance, coalesce(note, '-') AS note FROM all_",
)
def job_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid report rows with their addresses, output files and notes."""
    valid, _ = reporting.build_report_rows(_job_rows(spark, sf_dir), ORIGIN)
    dash = F.lit("-")
    files = F.array_join(F.transform("output_files", lambda f: F.concat_ws("=", f["name"], f["url"])), ",")
    return valid.select(
        "id",
        "build_id",
        "path",
        "status",
        F.coalesce("duration", F.lit(-1.0)).alias("duration"),
        F.coalesce("log_url", dash).alias("log_url"),
        F.coalesce(files, dash).alias("output_files"),
        F.coalesce(F.try_element_at("misc", F.lit("instance_id")), dash).alias("instance"),
        F.coalesce(F.try_element_at("misc", F.lit("note")), dash).alias("note"),
    )


@query(
    "stable_row_ids",
    view_sql("results") + "SELECT o_orderkey, concat(node_id, '.', CASE WHEN o_orderkey % 5 <> 0 THEN instance_id ELSE cast(o_orderkey as string) END) AS row_id FROM results",
)
def stable_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    row_id = reporting.row_ids(F.col("node_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("instance_id")), F.col("o_orderkey"))
    return view(spark, sf_dir, "results").select("o_orderkey", row_id.alias("row_id"))


@query(
    "write_report_doc",
    _ROWS + "SELECT id, coalesce(build_id, 'b_default') AS build_id, path, status, coalesce(duration, -1) AS duration, duration IS NOT NULL AS has_duration, 5 AS major, 3 AS minor FROM rows_",
)
def write_report_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report documents, written and read back into one row per test; an empty optional is left out, not null."""
    valid, _ = reporting.build_report_rows(_raw_rows(spark, sf_dir), ORIGIN)
    out = scratch_path(spark, "reports")
    sinks.write_documents(reporting.report_documents(valid, build_id="b_default", origin=ORIGIN), out)
    shape = "tests array<string>, version struct<major:int,minor:int>"
    rows = spark.read.text(out).select(F.from_json("value", shape).alias("d")).select("d.version", F.explode("d.tests").alias("row"))
    row = F.from_json("row", "id string, build_id string, path string, status string, duration double")
    back = rows.select("version.*", row.alias("t"), F.col("row").contains('"duration":').alias("has_duration"))
    return back.select("t.id", "t.build_id", "t.path", "t.status", F.coalesce("t.duration", F.lit(-1.0)).alias("duration"), "has_duration", "major", "minor")


# ---------------------------------------------------------------- node outcomes

_NODE_RESULT = (
    view_sql("results")
    + f""", st AS (SELECT node_id, {_STATUS} AS status FROM results),
nr AS (SELECT node_id, CASE WHEN bool_or(status IN ('FAIL', 'ERROR', 'MISS')) THEN 'fail' WHEN bool_or(status IN ('PASS', 'DONE')) THEN 'pass'
       WHEN bool_or(status = 'SKIP') THEN 'skip' ELSE 'fail' END AS result, count(*) AS rows FROM st GROUP BY node_id)
"""
)


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "results").select("node_id", report.report_status(F.col("raw_status")).alias("status"))


@query("node_result", _NODE_RESULT + "SELECT * FROM nr")
def node_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.node_result(_statuses(spark, sf_dir))


_JOBS = [
    "concat('n', cast(c_custkey as string)) as node_id",
    "case when c_custkey % 17 = 3 then concat('HTTP ', cast(c_nationkey as string)) end as fetch_error",
    "case when c_custkey % 13 = 5 then 'missing kernel' end as translate_error",
    "case when c_custkey % 11 = 7 then 'executor died' end as run_error",
]


@query(
    "node_outcome",
    _NODE_RESULT
    + f""", jobs AS (SELECT {', '.join(_JOBS)} FROM customer)
SELECT node_id, CASE WHEN fetch_error IS NOT NULL OR translate_error IS NOT NULL OR run_error IS NOT NULL OR rows IS NULL THEN 'incomplete' ELSE result END AS result,
  coalesce(CASE WHEN fetch_error IS NOT NULL THEN 'Infrastructure' WHEN translate_error IS NOT NULL THEN 'invalid_job_params' WHEN run_error IS NOT NULL OR rows IS NULL THEN 'Infrastructure' END, '-') AS error_code,
  coalesce(CASE WHEN fetch_error IS NOT NULL THEN concat('failed to fetch job_definition: ', fetch_error) WHEN translate_error IS NOT NULL THEN concat('job translation failed: ', translate_error)
       WHEN run_error IS NOT NULL THEN concat('job execution failed: ', run_error) WHEN rows IS NULL THEN 'executor returned no per-test results' END, '-') AS error_msg
FROM jobs LEFT JOIN nr USING (node_id)""",
)
def node_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "customer").selectExpr(*_JOBS)
    return reporting.node_outcome(jobs, _statuses(spark, sf_dir)).fillna("-")


@query(
    "legacy_results",
    """WITH s AS (SELECT c_custkey, unnest(['baseline', 'ltp', 'fs']) AS test, unnest([0, 1, 2]) AS idx, c_nationkey FROM customer)
    SELECT concat('run_', cast(c_custkey as string)) AS run_prefix, idx, CASE test WHEN 'baseline' THEN 'boot' ELSE test END AS name,
           CASE WHEN (test = 'ltp' AND c_custkey % 2 = 0) OR (test = 'baseline' AND c_custkey % 3 = 0) THEN 'FAIL' ELSE 'PASS' END AS status,
           CASE WHEN c_nationkey % 2 = 0 THEN 'https://c/log' ELSE '-' END AS log_url FROM s""",
)
def legacy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = table(spark, sf_dir, "customer").selectExpr(
        "concat('run_', cast(c_custkey as string)) as run_prefix",
        "array('baseline', 'ltp', 'fs') as test_names",
        "map('ltp', if(c_custkey % 2 = 0, array('i-1'), cast(array() as array<string>)), if(c_custkey % 3 = 0, 'baseline', 'none'), array('i-2', 'i-3')) as failed_by_test",
        "if(c_nationkey % 2 = 0, 'https://c/log', null) as failure_url",
    )
    return reporting.legacy_results(summaries).withColumn("log_url", F.coalesce("log_url", F.lit("-")))


@query(
    "merge_artifacts",
    """SELECT c_custkey, 'https://jobs/1' AS job_definition, CASE WHEN c_custkey % 3 > 0 THEN concat('u0-', c_name) WHEN c_custkey % 2 = 0 THEN 'old' ELSE '-' END AS test_log,
       CASE WHEN c_custkey % 3 = 2 THEN concat('u1-', c_name) ELSE '-' END AS test_log_1, CAST(1 + CASE c_custkey % 3 WHEN 0 THEN 1 - c_custkey % 2 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS n FROM customer""",
)
def merge_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "if(c_custkey % 2 = 0, map('job_definition', 'https://jobs/1', 'test_log', 'old'), map('job_definition', 'https://jobs/1')) as artifacts",
        "slice(array(concat('u0-', c_name), concat('u1-', c_name)), 1, cast(c_custkey % 3 as int)) as urls",
    )
    merged = nodes.select("c_custkey", reporting.merge_artifacts(F.col("artifacts"), F.col("urls")).alias("m"))

    def at(key: str):
        return F.coalesce(F.try_element_at("m", F.lit(key)), F.lit("-")).alias(key)

    return merged.select("c_custkey", at("job_definition"), at("test_log"), at("test_log_1"), F.size("m").alias("n"))


@query(
    "public_url",
    view_sql("objects") + f"SELECT key, concat('https://{BUCKET}.s3.{REGION}.amazonaws.com/', key) AS url FROM objects",
)
def public_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "objects").select("key", report.public_url(F.lit(BUCKET), F.lit(REGION), F.col("key")).alias("url"))

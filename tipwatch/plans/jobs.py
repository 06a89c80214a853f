"""Registered queries: job events, claims, build lookup, run plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch.operators import jobs
from tipwatch.plans.registry import query
from tipwatch.plans.views import table, view, view_sql

RUNTIME, PLATFORMS, ORIGIN = "cloud-1", ["qemu-arm64", "metal"], "lab_1"
CURSOR = "2024-01-03T00:00:00.000000"


def as_events(flat: DataFrame) -> DataFrame:
    """Job events in their nested shape from the flat view."""
    data = F.when(F.col("runtime").isNotNull(), F.struct("runtime", "platform", F.lit(None).cast("string").alias("job_id")))
    artifacts = F.when(F.col("definition").isNotNull(), F.create_map(F.lit("job_definition"), "definition"))
    node = F.struct(
        F.col("node_id").alias("id"), "kind", F.lit(None).cast("string").alias("parent"), "state", data.alias("data"), artifacts.alias("artifacts")
    )
    return flat.select(F.col("stamp").alias("timestamp"), node.alias("node"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(view(spark, sf_dir, "job_events"))


_AVAILABLE = f"state = 'available' AND kind = 'job' AND stamp >= '{CURSOR}'"
_MINE = f"runtime = '{RUNTIME}' AND platform IN ('qemu-arm64', 'metal')"
INTAKE_WHERE = f"state = 'available' AND kind = 'job' AND {_MINE} AND definition LIKE 'http%'"


@query("scan_job_events", view_sql("job_events") + f"SELECT stamp AS timestamp, node_id AS id FROM job_events WHERE {_AVAILABLE}")
def scan_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.available_jobs(_events(spark, sf_dir), CURSOR).select("timestamp", "node.id")


@query("filter_runtime_platform", view_sql("job_events") + f"SELECT stamp AS timestamp, node_id AS id, platform FROM job_events WHERE {_MINE}")
def filter_runtime_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.filter_runtime_platform(_events(spark, sf_dir), RUNTIME, PLATFORMS)
    return found.select("timestamp", "node.id", "node.data.platform")


@query("filter_has_jobdef", view_sql("job_events") + "SELECT stamp AS timestamp, definition FROM job_events WHERE definition LIKE 'http%'")
def filter_has_jobdef(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.filter_has_definition(_events(spark, sf_dir))
    return found.select("timestamp", F.col("node.artifacts")["job_definition"].alias("definition"))


_LIST = "concat(' ', p_name, ' ,, ', p_type, case when p_size % 2 = 0 then ', ' else '' end)"
_BLANK = "case when p_partkey % 9 = 0 then ' , ' else " + _LIST + " end"


@query(
    "parse_allowlist",
    f"""SELECT p_partkey, coalesce(array_to_string(nullif(list_filter(list_transform(string_split({_BLANK}, ','), lambda x: trim(x)), lambda x: x <> ''), []), '|'), '-') AS items
    FROM part""",
)
def parse_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_join(jobs.parse_allowlist(F.expr(_BLANK)), "|")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(items, F.lit("-")).alias("items"))


CLAIM_SQL = (
    view_sql("job_events", "nodes")
    + f"""SELECT node_id AS id, min(stamp) AS timestamp FROM job_events WHERE {_AVAILABLE}
AND node_id IN (SELECT id FROM nodes WHERE state = 'available' AND job_id = '') GROUP BY node_id"""
)


@query("claim_once", CLAIM_SQL)
def claim_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = jobs.available_jobs(_events(spark, sf_dir), CURSOR)
    return jobs.claim_once(events, view(spark, sf_dir, "nodes")).select("id", "timestamp")


_BUILDS = (
    view_sql("nodes").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, walk AS (
  SELECT id AS node, id, kind, parent, 1 AS seen FROM nodes
  UNION ALL SELECT w.node, n.id, n.kind, n.parent, w.seen + 1 FROM walk w JOIN nodes n ON n.id = w.parent WHERE w.kind <> 'kbuild' AND w.seen < 8),
found AS (SELECT node, id AS build FROM walk WHERE kind = 'kbuild')
"""
)


@query("resolve_build_id", _BUILDS + f"SELECT n.id, coalesce('{ORIGIN}:' || f.build, '-') AS build_id FROM nodes n LEFT JOIN found f ON f.node = n.id")
def resolve_build_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.resolve_build_ids(view(spark, sf_dir, "nodes"), ORIGIN)
    return found.select("id", F.coalesce("build_id", F.lit("-")).alias("build_id"))


@query(
    "job_build_id",
    _BUILDS + f"SELECT n.id AS node_id, coalesce('{ORIGIN}:' || f.build, '{ORIGIN}:unknown_' || n.id) AS build_id FROM nodes n LEFT JOIN found f ON f.node = n.id WHERE n.kind = 'job'",
)
def job_build_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "nodes")
    wanted = nodes.filter("kind = 'job'").select(F.col("id").alias("node_id"), "kind", "parent")
    return jobs.with_build_ids(wanted, nodes, ORIGIN).select("node_id", "build_id")


_ARCH = "CASE WHEN a IS NOT NULL THEN a WHEN platform LIKE '%aarch64%' THEN 'arm64' ELSE 'x86_64' END"
_DEFS = (
    view_sql("definitions")
    + f""", d AS (SELECT node_id, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'arm64' WHEN 1 THEN 'riscv' END AS a,
  CASE WHEN o_orderkey % 3 = 0 THEN 'qemu-aarch64' ELSE 'vm' END AS platform FROM definitions),
p AS (SELECT *, {_ARCH} AS arch FROM d)
"""
)


@query("normalise_arch", _DEFS + "SELECT node_id, arch FROM p")
def normalise_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipwatch.schemas import JOB_DEFINITION

    parsed = view(spark, sf_dir, "definitions").select("node_id", F.from_json("definition", JOB_DEFINITION).alias("d"))
    return parsed.select("node_id", jobs.normalise_arch(F.col("d.environment.arch"), F.col("d.environment.platform")).alias("arch"))


_MACHINE = "CASE WHEN arch IN ('arm64', 'aarch64') THEN 'c6g.4xlarge' ELSE 'c5a.4xlarge' END"
_IMAGE = "concat('resolve:ssm:/aws/service/ami-amazon-linux-latest/al2023-ami-kernel-default-', CASE WHEN arch IN ('arm64', 'aarch64') THEN 'arm64' ELSE 'x86_64' END)"


@query("platform_lookup", _DEFS + f"SELECT node_id, arch, {_MACHINE} AS instance_type, {_IMAGE} AS ami_id FROM p")
def platform_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a table of platforms, as a deployment with its own would give it."""
    wanted = normalise_arch(spark, sf_dir)
    return jobs.platform_join(wanted, jobs.platform_table(spark)).select("node_id", "arch", "instance_type", "ami_id")


@query(
    "test_dir_lookup",
    """SELECT p_type, count(*) AS n, CASE p_type WHEN 'ECONOMY' THEN 'eco-dir' WHEN 'PROMO' THEN 'promo-dir' ELSE 'else-dir' END AS dir, 'url-kernel-boot' AS plain
    FROM part GROUP BY ALL""",
)
def test_dir_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    own = {"ECONOMY": "eco-dir", "PROMO": "promo-dir", "_default": "else-dir"}
    return counts.select("p_type", "n", jobs.test_dir(F.col("p_type"), own).alias("dir"), jobs.test_dir(F.col("p_type")).alias("plain"))


@query(
    "dedup_ordered",
    """WITH d AS (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'eco-dir' WHEN 'PROMO' THEN 'promo-dir' ELSE 'else-dir' END AS dir FROM part)
    SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'else-dir' WHEN dir = 'else-dir' THEN dir WHEN p_size % 2 = 0 THEN concat(dir, ',else-dir')
    ELSE concat('else-dir,', dir) END AS dirs FROM d""",
)
def dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test folders of a job in order, each once; some jobs have no tests."""
    own = {"ECONOMY": "eco-dir", "PROMO": "promo-dir", "_default": "else-dir"}
    repeated = "case when p_size % 7 = 0 then array() when p_size % 2 = 0 then array(p_type, p_brand, p_type, p_brand) else array(p_brand, p_brand, p_type, p_brand) end"
    tests = F.transform(F.expr(repeated), lambda t: F.struct(F.lit("i").alias("id"), t.alias("type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(jobs.job_folders(tests, own), ",").alias("dirs"))


@query(
    "plan_runs",
    _DEFS
    + f"""SELECT node_id, concat('job-', arch, '-', left(node_id, 12)) AS test_id, arch, {_IMAGE} AS ami_id, {_MACHINE} AS instance_type, 40 AS root_volume_size,
  CAST(CASE k % 6 WHEN 0 THEN 3600 WHEN 1 THEN 3600 WHEN 2 THEN 900 ELSE 1800 END AS BIGINT) AS max_runtime, 'url-kernel-boot' AS test, 1 AS min_count,
  concat_ws(',', concat('ARCH=', arch), CASE k % 3 WHEN 1 THEN 'JOB_TESTS=a:ltp,custom:custom' WHEN 2 THEN 'JOB_TESTS=b:baseline' END, concat('KERNEL_URL=http://k/', cast(k as string)),
    'MODULES_URL=http://m/m.tar', concat('NODE_ID=', node_id), CASE k % 4 WHEN 0 THEN 'ROOTFS_URL=http://r/r.img' WHEN 1 THEN 'ROOTFS_URL=http://r/i.cpio' END) AS params
  FROM p WHERE k % 13 <> 0""",
)
def plan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, _ = jobs.plan_runs(view(spark, sf_dir, "definitions"))
    params = F.array_join(
        F.transform(F.array_sort(F.map_entries("test_params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
    shown = plans.withColumns({"test": F.array_join("test", ","), "params": params})
    return shown.drop("role_name", "test_params")


@query("rejected_jobs", _DEFS + "SELECT node_id, 'invalid_job_params' AS error_code FROM p WHERE k % 13 = 0")
def rejected_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.plan_runs(view(spark, sf_dir, "definitions"))[1]


@query(
    "editor_grants",
    """SELECT c_name AS username FROM customer WHERE c_acctbal > 9000 OR c_nationkey IN (1, 2, 3)""",
)
def editor_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").selectExpr(
        "c_name as username",
        "c_acctbal > 9000 as is_superuser",
        "case c_nationkey when 1 then array('staff', 'node:edit:any') when 2 then array('runtime:cloud-1:node-editor')"
        " when 3 then array('runtime:cloud-1:node-admin', 'x') when 4 then array('runtime:other:node-admin') when 5 then null else array('staff') end as groups",
    )
    return jobs.editor_grants(users, RUNTIME).select("username")


@query("strip_readonly_fields", view_sql("nodes") + "SELECT kind, parent, state, job_id FROM nodes")
def strip_readonly_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "nodes").withColumns({"owner": F.lit("o"), "created": F.lit("c"), "timeout": F.lit("t"), "bridge": F.lit(True)})
    return jobs.strip_readonly_fields(nodes, "bridge")

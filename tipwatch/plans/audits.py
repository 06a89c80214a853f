"""Registered queries: object and cloud inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch.operators import audit
from tipwatch.plans.registry import query
from tipwatch.plans.views import table, view, view_sql

_REMOTE_SUM = "CASE WHEN o_orderkey % 9 = 0 THEN 'stale' ELSE md5 END"


@query("changed_objects", view_sql("objects") + "SELECT key, md5 FROM objects WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0")
def changed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = view(spark, sf_dir, "objects")
    remote = local.filter("o_orderkey % 10 <> 0").select("key", F.concat(F.lit('"'), F.expr(_REMOTE_SUM), F.lit('"')).alias("etag"))
    return audit.changed_objects(local.select("key", "md5"), remote)


@query(
    "missing_shared",
    """WITH w AS (SELECT DISTINCT concat('run_', cast(o_custkey as string)) AS run_prefix, concat('f', cast(o_orderkey % 4 as string)) AS folder FROM orders WHERE o_orderkey % 3 <> 0),
    s AS (SELECT DISTINCT concat('run_', cast(o_custkey as string)) AS run_prefix, concat('f', cast(o_orderkey % 4 as string)) AS folder FROM orders WHERE o_orderkey % 7 = 0 AND o_custkey % 3 = 0)
    SELECT * FROM w EXCEPT SELECT * FROM s""",
)
def missing_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "concat('run_', cast(o_custkey as string)) as run_prefix", "concat('f', cast(o_orderkey % 4 as string)) as folder", "o_orderkey", "o_custkey"
    )
    wanted = orders.select("run_prefix", F.create_map("folder", F.col("o_orderkey") % 3 != 0, F.lit("off"), F.lit(False)).alias("requirements"))
    present = orders.filter("o_orderkey % 7 = 0 and o_custkey % 3 = 0")
    inventory = present.select(F.concat("run_prefix", F.lit("/shared/"), "folder", F.lit("/kernel.rpm")).alias("key"))
    return audit.missing_shared(wanted, inventory)


@query(
    "verify_sizes",
    view_sql("objects")
    + "SELECT key, size, CASE WHEN o_orderkey % 5 = 0 THEN true ELSE o_orderkey % 8 <> 1 END AS verified FROM objects",
)
def verify_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = view(spark, sf_dir, "objects")
    remote = local.filter("o_orderkey % 5 <> 0").selectExpr("key", "size + if(o_orderkey % 8 = 1, 1, 0) as size")
    return audit.verify_sizes(local.select("key", "size"), remote).select("key", "size", "verified")


@query(
    "filter_runs_by_state",
    "SELECT o_orderkey FROM orders WHERE o_custkey % 20 = 4 AND o_orderstatus IN ('P', 'F')",
)
def filter_runs_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "case o_orderstatus when 'P' then 'pending' when 'F' then 'running' else 'terminated' end as state",
        "if(o_custkey % 20 < 10, map('run_prefix', concat('run_', cast(o_custkey % 20 as string)), 'Name', 'vm'), map('Name', 'vm')) as tags",
    )
    return audit.runs_in_state(instances, "run_4").select("o_orderkey")


@query(
    "leak_audit",
    view_sql("inventory")
    + """SELECT kind, name, state FROM inventory WHERE
  (kind = 'vm' AND (name LIKE 'team%' OR name LIKE 'ci-test-%') AND state IN ('pending', 'running', 'stopping', 'stopped'))
  OR (kind = 'task' AND name LIKE 'team-cluster%' AND state = 'RUNNING') OR (kind = 'cluster' AND name = 'team-cluster' AND state = 'ACTIVE')
  OR (kind = 'task_definition' AND name LIKE 'team%' AND state = 'ACTIVE') OR (kind = 'role' AND name IN ('team-ecs-role', 'ecsTaskExecutionRole'))
  OR (kind = 'repo' AND name IN ('team-ecr', 'ci-test')) OR (kind = 'log_group' AND (name LIKE '/ecs/team%' OR name LIKE '/ec2/team%'))
  OR (kind = 'bucket' AND name LIKE 'team%')""",
)
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.leak_audit(view(spark, sf_dir, "inventory"), "team-").select("kind", "name", "state")


_POLICY = (
    "concat('{\"Statement\": [{\"Sid\": \"Other\", \"Effect\": \"Deny\"}, {\"Sid\": \"', if(s_suppkey % 7 = 0, 'Wrong', 'PublicReadKernelBootLogs'),"
    " '\", \"Effect\": \"Allow\", \"Principal\": \"*\", \"Action\": ', if(s_suppkey % 2 = 0, '\"s3:GetObject\"', '[\"s3:GetObject\"]'),"
    " ', \"Resource\": [\"arn:aws:s3:::', bucket, if(s_suppkey % 5 = 0, '/*', '/*/test_*/output/*/console-output.log'), '\"], \"Extra\": 1}]}')"
)
_BLOCK = "case s_suppkey % 3 when 0 then '{\"BlockPublicPolicy\": false, \"RestrictPublicBuckets\": false}' when 1 then '{\"BlockPublicPolicy\": false}' end"


@query(
    "policy_audit",
    """SELECT lower(s_name) AS bucket, s_suppkey % 3 = 0 AS policies_allowed, s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AS statement_ok,
       s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AS ok FROM supplier""",
)
def policy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = table(spark, sf_dir, "supplier").withColumn("bucket", F.lower("s_name"))
    return audit.policy_audit(buckets.selectExpr("bucket", f"{_POLICY} as policy", f"{_BLOCK} as public_access_block"))


@query(
    "validation_rollup",
    "SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > -500) AS passed, count(*) AS total, bool_and(c_acctbal > -500) AS ok FROM customer GROUP BY ALL",
)
def validation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "customer").selectExpr("c_nationkey", "c_name as name", "c_acctbal > -500 as ok")
    return audit.validation_rollup(checks, ["c_nationkey"])


_FILES = "concat(replace(p_name, ' ', '-'), case p_size % 6 when 0 then '.src.rpm' when 1 then '.x86_64.rpm' when 2 then '.aarch64.rpm' when 3 then '.noarch.rpm' else '.txt' end)"


@query(
    "rpm_counts",
    """SELECT CASE p_size % 6 WHEN 0 THEN 'source' WHEN 1 THEN 'x86_64' WHEN 2 THEN 'aarch64' ELSE 'skipped' END AS class, count(*) AS files
    FROM part WHERE p_size % 6 <= 3 GROUP BY 1""",
)
def rpm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rpm_counts(table(spark, sf_dir, "part").selectExpr(f"{_FILES} as name"))


@query(
    "test_catalog",
    """SELECT concat(CASE WHEN p_size % 10 = 0 THEN '.' ELSE '' END, replace(p_name, ' ', '-')) AS test, count(*) AS stages FROM part
    WHERE p_size % 10 <> 0 AND p_partkey % 3 = 0 GROUP BY ALL""",
)
def test_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").selectExpr(
        "concat(if(p_size % 10 = 0, '.', ''), replace(p_name, ' ', '-'), case p_partkey % 3 when 0 then concat('/run-', cast(p_partkey as string), '.sh')"
        " when 1 then '/lib/run.sh' else '/README' end) as path"
    )
    return audit.test_catalog(files)

"""Inventory audits: changed and missing objects, leaks, policies, package and test catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: states in which a machine still costs money, the role left behind under default settings ----
LIVE_STATES = ["pending", "running", "stopping", "stopped"]
DEFAULT_ROLE = "ecsTaskExecutionRole"
# ---- Fixed values: the public-read statement expected on a results bucket ----
LOGS_SID = "PublicReadKernelBootLogs"
LOGS_PATTERN = "*/test_*/output/*/console-output.log"
RUNNING_STATES = ["pending", "running"]


def changed_objects(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local ``(key, md5)`` that the store lacks or holds with another checksum."""
    same = remote.select("key", F.replace("etag", F.lit('"'), F.lit("")).alias("md5"))
    return local.join(same, ["key", "md5"], "left_anti")


def missing_shared(requirements: DataFrame, inventory: DataFrame) -> DataFrame:
    """Enabled ``(run_prefix, requirements MAP<folder, enabled>)`` folders with nothing under ``shared/`` yet."""
    wanted = requirements.select("run_prefix", F.explode("requirements").alias("folder", "enabled")).filter("enabled")
    shape = r"^(.*?)/shared/([^/]+)/."
    present = inventory.select(F.regexp_extract("key", shape, 1).alias("run_prefix"), F.regexp_extract("key", shape, 2).alias("folder"))
    return wanted.select("run_prefix", "folder").distinct().join(present, ["run_prefix", "folder"], "left_anti")


def verify_sizes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Upload check per local ``(key, size)``: true if the sizes agree or the store cannot tell."""
    joined = local.join(remote.select("key", F.col("size").alias("remote_size")), "key", "left")
    return joined.withColumn("verified", F.coalesce(F.col("size") == F.col("remote_size"), F.lit(True)))


def runs_in_state(instances: DataFrame, run_prefix: str) -> DataFrame:
    """Pending or running instances ``(id, state, tags MAP)`` tagged with the run."""
    return instances.filter((F.try_element_at("tags", F.lit("run_prefix")) == run_prefix) & F.col("state").isin(RUNNING_STATES))


def leak_audit(inventory: DataFrame, prefix: str, default_name: str = "ci-test") -> DataFrame:
    """Resources ``(kind, name, state)`` left by deployments with ``prefix``; a listing, nothing is deleted.

    ``default_name`` is what machines and the image repository are called under default settings. One pass: the rule
    that applies depends on the kind only.
    """
    base = prefix.rstrip("-")
    name, state, kind = F.col("name"), F.col("state"), F.col("kind")
    rules: dict[str, Column] = {
        "vm": (name.startswith(base) | name.startswith(f"{default_name}-")) & state.isin(LIVE_STATES),
        "task": (name.startswith(f"{base}-cluster")) & (state == "RUNNING"),
        "cluster": (name == f"{base}-cluster") & (state == "ACTIVE"),
        "task_definition": name.startswith(base) & (state == "ACTIVE"),
        "role": (name == f"{base}-ecs-role") | (name == DEFAULT_ROLE),
        "repo": (name == f"{base}-ecr") | (name == default_name),
        "log_group": name.startswith(f"/ecs/{base}") | name.startswith(f"/ec2/{base}"),
        "bucket": name.startswith(base),
    }
    leaked = F.lit(False)
    for rule_kind, rule in rules.items():
        leaked = F.when(kind == rule_kind, rule).otherwise(leaked)
    return inventory.filter(leaked)


def _as_set(document: Column, field: str) -> Column:
    """Members of a field that holds a string or a list of strings."""
    raw = F.get_json_object(document, f"$.{field}")
    listed = F.from_json(raw, "array<string>")
    members = F.when(raw.startswith("["), listed).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(members))


def policy_audit(buckets: DataFrame) -> DataFrame:
    """Per ``(bucket, policy JSON, public_access_block JSON)``: are public reads of boot logs possible and granted?

    The statement with the expected id must agree in effect, principal, and in action and resource as sets.
    Missing block settings count as blocking.
    """
    statements = F.from_json(F.get_json_object("policy", "$.Statement"), "array<string>")
    mine = F.get(F.filter(statements, lambda s: F.get_json_object(s, "$.Sid") == LOGS_SID), F.lit(0))
    resource = F.concat(F.lit("arn:aws:s3:::"), "bucket", F.lit("/" + LOGS_PATTERN))
    matches = (
        (F.get_json_object(mine, "$.Effect") == "Allow")
        & (F.get_json_object(mine, "$.Principal") == "*")
        & (_as_set(mine, "Action") == F.array(F.lit("s3:GetObject")))
        & (_as_set(mine, "Resource") == F.array(resource))
    )

    def off(setting: str) -> Column:
        return F.coalesce(F.get_json_object("public_access_block", f"$.{setting}"), F.lit("true")) == "false"

    allowed = off("BlockPublicPolicy") & off("RestrictPublicBuckets")
    granted = F.coalesce(matches, F.lit(False))
    return buckets.select("bucket", allowed.alias("policies_allowed"), granted.alias("statement_ok"), (allowed & granted).alias("ok"))


def validation_rollup(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Checks passed of all per group ``(keys, name, ok)``, and whether all did."""
    return checks.groupBy(*keys).agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"), F.bool_and("ok").alias("ok"))


def package_class(name: Column) -> Column:
    return (
        F.when(name.endswith(".src.rpm"), "source")
        .when(name.endswith(".x86_64.rpm"), "x86_64")
        .when(name.endswith(".aarch64.rpm"), "aarch64")
        .when(name.endswith(".rpm"), "skipped")
    )


def rpm_counts(files: DataFrame) -> DataFrame:
    """Packages per class from ``(name)``; names that are no packages are left out."""
    return files.select(package_class(F.col("name")).alias("class")).filter("class is not null").groupBy("class").agg(F.count("*").alias("files"))


def test_catalog(files: DataFrame) -> DataFrame:
    """Test folders with at least one ``run*.sh`` directly inside, and how many, from paths ``dir/.../file``."""
    parts = F.split("path", "/")
    stage = (F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike(r"^run.*\.sh$")
    dirs = files.select(F.get(parts, F.lit(0)).alias("test"), stage.alias("stage")).filter("stage and not startswith(test, '.')")
    return dirs.groupBy("test").agg(F.count("*").alias("stages"))

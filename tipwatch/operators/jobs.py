"""Job events: filters, claims, build lookup, and the translation of job definitions into run plans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipwatch.schemas import JOB_DEFINITION
from tipwatch.session import materialise

# ---- Fixed values: machine and image per architecture, the last resort, and the test folder per test type ----
PLATFORMS = {
    "x86_64": ("c5a.4xlarge", "resolve:ssm:/aws/service/ami-amazon-linux-latest/al2023-ami-kernel-default-x86_64"),
    "arm64": ("c6g.4xlarge", "resolve:ssm:/aws/service/ami-amazon-linux-latest/al2023-ami-kernel-default-arm64"),
    "aarch64": ("c6g.4xlarge", "resolve:ssm:/aws/service/ami-amazon-linux-latest/al2023-ami-kernel-default-arm64"),
}
FALLBACK_ARCH = "x86_64"
TEST_DIRS = {"baseline": "url-kernel-boot", "ltp": "url-kernel-boot", "unixbench": "url-kernel-boot"}
FALLBACK_DIR = "url-kernel-boot"
ROOT_VOLUME_GB = 40
DEFAULT_TIMEOUT = 3600
# ---- Fixed values: node fields the job service manages itself; they are dropped before a write-back ----
READ_ONLY_FIELDS = [
    "id",
    "_id",
    "created",
    "updated",
    "user",
    "user_groups",
    "owner",
    "submitter",
    "treeid",
    "retry_counter",
    "timeout",
]
EPOCH_CURSOR = "1970-01-01T00:00:00.000000"


def parse_allowlist(raw: Column) -> Column:
    """Trimmed non-empty items of a comma-separated text; null if none is left."""
    items = F.filter(F.transform(F.split(raw, ","), lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def allowlist(raw: str | Iterable[str] | None) -> list[str] | None:
    """The same for a setting: a comma-separated text or a list; None accepts everything."""
    if raw is None:
        return None
    items = raw.split(",") if isinstance(raw, str) else [str(x) for x in raw]
    return [x.strip() for x in items if x.strip()] or None


def available_jobs(events: DataFrame, cursor: str | None = EPOCH_CURSOR) -> DataFrame:
    """Events of available job nodes from the cursor on; without one (None) all, whatever their stamps. Batch or stream."""
    found = events.filter((F.col("node.state") == "available") & (F.col("node.kind") == "job"))
    return found if cursor is None else found.filter(F.col("timestamp") >= cursor)


def filter_runtime_platform(events: DataFrame, runtime: str, platforms: list[str] | None = None) -> DataFrame:
    kept = events.filter(F.col("node.data.runtime") == runtime)
    return kept.filter(F.col("node.data.platform").isin(platforms)) if platforms else kept


def filter_has_definition(events: DataFrame) -> DataFrame:
    """Events whose node points to a job definition over http(s)."""
    return events.filter(F.col("node.artifacts")["job_definition"].startswith("http"))


def claim_once(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """One claim per node that is still available and carries no job id in the current ``nodes(id, state, job_id)``.

    Of several events for a node the earliest stands; they meet only after a map-side minimum.
    """
    first = events.filter(F.col("node.id") != "").groupBy(F.col("node.id").alias("id")).agg(F.min("timestamp").alias("timestamp"))
    open_nodes = nodes.filter("state = 'available' and coalesce(job_id, '') = ''").select("id")
    return first.join(open_nodes, "id", "left_semi")


def job_id(runtime: str, token: Column) -> Column:
    return F.concat(F.lit(runtime + ":"), token)


def strip_readonly_fields(nodes: DataFrame, *service_fields: str) -> DataFrame:
    """Drops the read-only fields and any bookkeeping fields that other services keep on nodes."""
    return nodes.drop(*READ_ONLY_FIELDS, *service_fields)


def _seen_further(chains: DataFrame, seen: int) -> DataFrame:
    """Chains ``(id, build, hops, next)`` that looked at ``seen`` nodes each, now at twice as many: where a chain is open it
    goes on with what its next node has seen. Only open chains are joined, and only with nodes that have more to say."""
    is_open = F.col("build").isNull() & F.col("next").isNotNull()
    ahead = chains.filter("build is not null or next is not null")
    ahead = ahead.select(F.col("id").alias("next"), F.col("build").alias("_build"), F.col("hops").alias("_hops"), F.col("next").alias("_next"))
    further = chains.filter(is_open).select("id", "next").join(ahead, "next", "left")
    further = further.select("id", F.col("_build").alias("build"), (F.col("_hops") + seen).alias("hops"), F.col("_next").alias("next"))
    return chains.filter(~is_open).unionByName(further)


def resolve_build_ids(nodes: DataFrame, origin: str, asked: DataFrame | None = None, inspect: int = 8) -> DataFrame:
    """``build_id`` per node: origin and id of the nearest build among the node and its ancestors, else null.

    ``nodes(id, kind, parent)``; ``asked(id)`` limits the answer to these ids, each once. At most ``inspect`` nodes of
    a chain are looked at. Every join doubles how far all chains have seen (three joins for eight nodes); each but the
    last is written, since the next one reads it on both sides. Chains that have ended take no part in a join, so ends
    do not pile up on a key; many chains that meet in one node are a skewed left side, which adaptive execution splits.
    """
    is_build = F.col("kind") == "kbuild"
    build = F.when(is_build, F.col("id")).alias("build")
    parent = F.when(~F.coalesce(is_build, F.lit(False)), F.nullif("parent", F.lit(""))).alias("next")
    chains, seen = nodes.select("id", build, F.when(is_build, F.lit(0)).alias("hops"), parent), 1
    while seen < inspect:
        chains = _seen_further(chains if seen == 1 else materialise(chains, "chains"), seen)
        seen *= 2
    found = chains.select("id", F.when(F.col("hops") < inspect, F.concat(F.lit(origin + ":"), "build")).alias("build_id"))
    return found if asked is None else asked.select("id").join(found, "id", "left")


def with_build_ids(jobs: DataFrame, nodes: DataFrame, origin: str) -> DataFrame:
    """Jobs ``(node_id, kind, parent, ...)`` with their build, or a stand-in id where no ancestor is a build."""
    builds = resolve_build_ids(nodes, origin, inspect=7).filter("build_id is not null").withColumnRenamed("id", "parent")
    own = F.when(F.col("kind") == "kbuild", F.concat(F.lit(origin + ":"), "node_id"))
    unknown = F.concat(F.lit(f"{origin}:unknown_"), "node_id")
    joined = jobs.join(builds, "parent", "left")
    return joined.withColumn("build_id", F.coalesce(own, "build_id", unknown))


def normalise_arch(arch: Column, platform: Column) -> Column:
    guessed = F.when(platform.contains("arm64") | platform.contains("aarch64"), "arm64").otherwise("x86_64")
    return F.coalesce(F.nullif(arch, F.lit("")), guessed)


def platform_table(spark, platforms: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    rows = [(a, t, i) for a, (t, i) in (platforms or PLATFORMS).items()]
    return spark.createDataFrame(rows, "arch string, instance_type string, ami_id string")


def platform_lookup(arch: Column, platforms: dict[str, tuple[str, str]] | None = None) -> tuple[Column, Column]:
    """(instance type, image) of an architecture; unknown ones get the fallback. The table is a handful of literals."""
    table = platforms or PLATFORMS

    def pick(index: int) -> Column:
        entries = F.create_map(*[F.lit(x) for a, v in table.items() for x in (a, v[index])])
        return F.coalesce(F.try_element_at(entries, arch), F.lit(table[FALLBACK_ARCH][index]))

    return pick(0), pick(1)


def platform_join(jobs: DataFrame, platforms: DataFrame) -> DataFrame:
    """The same against a table of any size, with its fallback row: left join, then the default."""
    default = platforms.filter(F.col("arch") == FALLBACK_ARCH)
    kind, image = default.select("instance_type").scalar(), default.select("ami_id").scalar()
    joined = jobs.join(platforms, "arch", "left")
    return joined.withColumns({"instance_type": F.coalesce("instance_type", kind), "ami_id": F.coalesce("ami_id", image)})


def test_dir(kind: Column, dirs: dict[str, str] | None = None) -> Column:
    table = TEST_DIRS if dirs is None else dirs
    default = F.lit(table.get("_default", FALLBACK_DIR))
    if not table:
        return default
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, F.coalesce(kind, F.lit(""))), default)


def timeout_seconds(raw: Column) -> Column:
    """Whole seconds, fractions cut off; a missing, zero or unreadable timeout is an hour."""
    number = F.trim(raw).try_cast("double")
    whole = F.when(F.abs(number) < 2**53, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    return F.coalesce(F.nullif(whole.cast("long"), F.lit(0).cast("long")), F.lit(DEFAULT_TIMEOUT).cast("long"))


def job_folders(tests: Column, dirs: dict[str, str] | None = None) -> Column:
    """Test folders of a job's tests ``ARRAY<STRUCT<id, type>>`` in order, each once; the fallback without tests."""
    found = F.array_distinct(F.transform(tests, lambda t: test_dir(t["type"], dirs)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit((dirs or {}).get("_default", FALLBACK_DIR))))


def plan_runs(
    jobs: DataFrame,
    *,
    platforms: dict[str, tuple[str, str]] | None = None,
    dirs: dict[str, str] | None = None,
    role_name: str | None = None,
    id_prefix: str = "job",
    node_key: str = "NODE_ID",
    tests_key: str = "JOB_TESTS",
) -> tuple[DataFrame, DataFrame]:
    """(plans, rejected) from ``jobs(node_id, definition)`` with the definition as JSON text.

    A plan is one VM entry per job. A definition without kernel or modules is rejected as invalid. ``id_prefix`` and
    the two parameter names are what the deployment's test scripts expect.
    """
    # the explode keeps the filters below from being moved under the parsed text, which would parse twice
    parsed = jobs.withColumn("d", F.explode_outer(F.array(F.from_json("definition", JOB_DEFINITION))))
    # where the node is unknown the definition names the job, so that a repeated task names it alike
    parsed = parsed.withColumn("token", F.sha2(F.coalesce("definition", F.lit("")), 256))
    env, art = "d.environment.", "d.artifacts."
    present = {n: F.nullif(F.col(art + n), F.lit("")) for n in ("kernel", "modules", "rootfs", "ramdisk")}
    fields = parsed.withColumns(
        {
            "arch": normalise_arch(F.col(env + "arch"), F.col(env + "platform")),
            **present,
            "tests": F.coalesce("d.tests", F.array().cast("array<struct<id:string,type:string>>")),
            "node": F.nullif("node_id", F.lit("")),
        }
    )
    complete = F.col("kernel").isNotNull() & F.col("modules").isNotNull()
    instance_type, ami_id = platform_lookup(F.col("arch"), platforms)
    folders = job_folders(F.col("tests"), dirs)
    label = F.array_join(
        F.transform(
            "tests",
            lambda t: F.concat(F.coalesce(t["id"], t["type"], F.lit("unknown")), F.lit(":"), F.coalesce(t["type"], F.lit("unknown"))),
        ),
        ",",
    )
    optional = [
        ("KERNEL_URL", F.col("kernel")),
        ("MODULES_URL", F.col("modules")),
        ("ARCH", F.col("arch")),
        ("ROOTFS_URL", F.coalesce("rootfs", "ramdisk")),
        (node_key, F.col("node")),
        (tests_key, F.when(F.size("tests") > 0, label)),
    ]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in optional])
    params = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    short = F.substring(F.coalesce("node", "token"), 1, 12)
    plans = fields.filter(complete).select(
        "node_id",
        F.concat_ws("-", F.lit(id_prefix), "arch", short).alias("test_id"),
        F.lit(role_name).cast("string").alias("role_name"),
        "arch",
        ami_id.alias("ami_id"),
        instance_type.alias("instance_type"),
        F.lit(ROOT_VOLUME_GB).alias("root_volume_size"),
        timeout_seconds(F.col("d.timeout")).alias("max_runtime"),
        folders.alias("test"),
        F.lit(1).alias("min_count"),
        params.alias("test_params"),
    )
    rejected = fields.filter(~complete).select("node_id", F.lit("invalid_job_params").alias("error_code"))
    return plans, rejected


def editor_grants(users: DataFrame, runtime: str) -> DataFrame:
    """Users ``(username, is_superuser, groups)`` allowed to edit the job nodes of a runtime."""
    names = ["node:edit:any", f"runtime:{runtime}:node-editor", f"runtime:{runtime}:node-admin"]
    member = F.coalesce(F.arrays_overlap("groups", F.lit(names)), F.lit(False))
    return users.filter(F.col("is_superuser") | member)

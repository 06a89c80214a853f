import json
import random

import pytest
from pyspark.sql import functions as F

from tipwatch.operators import audit, jobs, logs
from tipwatch.schemas import JOB_EVENT


def event(ts="2024-01-01T00:00:00", **over):
    node = {"id": "n1", "kind": "job", "parent": None, "state": "available", "result": None, "data": {"runtime": "lab", "platform": "vm"}, "artifacts": {"job_definition": "https://j"}}
    return {"timestamp": ts, "node": {**node, **over}}


def test_event_filters(spark):
    rows = [
        event(), event(id="n2", data=None), event(id="n3", data={"runtime": "other"}), event(id="n4", data={"runtime": "lab", "platform": "metal"}),
        event(id="n5", artifacts={"job_definition": "file:///x"}), event(id="n6", artifacts=None), event(id="n7", state="running"), event(id="n8", kind="kbuild"), event("2023-01-01", id="n9"),
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.from_json("v", JOB_EVENT).alias("e")).select("e.*")

    def ids(found):
        return {r.id for r in found.select("node.id").collect()}

    assert ids(jobs.available_jobs(df, "2024")) == {"n1", "n2", "n3", "n4", "n5", "n6"}
    assert ids(jobs.filter_runtime_platform(df, "lab")) == {"n1", "n4", "n5", "n6", "n7", "n8", "n9"}
    assert ids(jobs.filter_runtime_platform(df, "lab", ["vm"])) == {"n1", "n5", "n6", "n7", "n8", "n9"}
    assert ids(jobs.filter_has_definition(df)) == {"n1", "n2", "n3", "n4", "n7", "n8", "n9"}
    again = df.unionByName(df.withColumn("timestamp", F.lit("2025")))
    nodes = spark.createDataFrame([("n1", "available", None), ("n2", "done", None), ("n3", "available", "lab:1")], "id string, state string, job_id string")
    assert [tuple(r) for r in jobs.claim_once(again, nodes).collect()] == [("n1", "2024-01-01T00:00:00")]


def test_allowlist(spark):
    assert jobs.allowlist(None) is None and jobs.allowlist(" , ") is None and jobs.allowlist(["a ", ""]) == ["a"] and jobs.allowlist("a, b") == ["a", "b"]
    df = spark.createDataFrame([(" a, ,b ",), (" ,",), (None,)], "s string")
    assert [r.x for r in df.select(jobs.parse_allowlist(F.col("s")).alias("x")).collect()] == [["a", "b"], None, None]


def test_build_lookup(spark):
    rng = random.Random(1)
    nodes = {f"n{i}": (rng.choice(["job", "job", "checkout", "kbuild"]) if i % 3 else "job", f"n{i - rng.randint(1, 2)}" if i > 1 else rng.choice([None, "gone"])) for i in range(200)}
    for i in range(200, 212):  # a chain too long to be searched
        nodes[f"n{i}"] = ("kbuild" if i == 200 else "job", f"n{i - 1}")

    def walk(node):
        for _ in range(8):
            if node not in nodes:
                return None
            kind, parent = nodes[node]
            if kind == "kbuild":
                return "o:" + node
            if not parent:
                return None
            node = parent
        return None

    df = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "id string, kind string, parent string")
    found = jobs.resolve_build_ids(df, "o")
    assert {r.id: r.build_id for r in found.collect()} == {n: walk(n) for n in nodes}
    asked = df.filter("kind <> 'checkout'").withColumnRenamed("id", "node_id")
    wanted = {n: walk(n) or f"o:unknown_{n}" for n, (kind, _) in nodes.items() if kind != "checkout"}
    assert {r.node_id: r.build_id for r in jobs.with_build_ids(asked, df, "o").collect()} == wanted


def test_build_lookup_doubles_its_reach(spark):
    """Nine chains in ten meet in one root that is no build; three joins see eight nodes, each join in a plan of its own."""
    rows = [("root", "checkout", None), ("built", "kbuild", "root")]
    rows += [(f"n{i}", "job", "root" if i % 10 else "built") for i in range(2000)] + [("l0", "kbuild", None), ("l1", "job", "l0")]
    rows += [(f"l{i}", "job", f"l{i - 1}") for i in range(2, 11)] + [("loop", "job", "loop"), ("blank", "job", "")]
    df = spark.createDataFrame(rows, "id string, kind string, parent string")
    found = {r.id: r.build_id for r in jobs.resolve_build_ids(df, "o").collect()}
    want = {f"n{i}": None if i % 10 else "o:built" for i in range(2000)}
    want |= {"root": None, "built": "o:built", "loop": None, "blank": None, **{f"l{i}": "o:l0" if i < 8 else None for i in range(11)}}
    assert found == want
    steps, real = [], jobs.materialise

    def seen(chains, name):
        steps.append(chains)
        return real(chains, name)

    jobs.materialise = seen
    try:
        steps.append(jobs.resolve_build_ids(df, "o"))
    finally:
        jobs.materialise = real
    plans = [s._jdf.queryExecution().optimizedPlan().toString() for s in steps]
    assert [p.count("Join LeftOuter") for p in plans] == [1, 1, 1]


JOB = {"environment": {"arch": "arm64", "platform": "vm"}, "artifacts": {"kernel": "k", "modules": "m", "rootfs": "r"}, "tests": [{"id": "a", "type": "baseline"}, {"type": "ltp"}], "timeout": 900}


def plan(spark, definition, node="node-1234567890", **options):
    df = spark.createDataFrame([(node, json.dumps(definition))], "node_id string, definition string")
    good, bad = jobs.plan_runs(df, **options)
    return good.first(), bad.first()


def test_plan(spark):
    row, bad = plan(spark, JOB, role_name="role")
    assert bad is None
    assert (row.test_id, row.role_name, row.instance_type, row.max_runtime, row.root_volume_size, row.min_count) == ("job-arm64-node-1234567", "role", "c6g.4xlarge", 900, 40, 1)
    assert row.ami_id.endswith("kernel-default-arm64") and row.test == ["url-kernel-boot"]
    assert row.test_params == {"KERNEL_URL": "k", "MODULES_URL": "m", "ARCH": "arm64", "ROOTFS_URL": "r", "NODE_ID": "node-1234567890", "JOB_TESTS": "a:baseline,ltp:ltp"}


def test_plan_fallbacks(spark):
    row, _ = plan(spark, {"environment": {"platform": "qemu-aarch64"}, "artifacts": {"kernel": "k", "modules": "m", "ramdisk": "i"}, "timeout": "soon"}, node=None)
    assert (row.arch, row.max_runtime, row.test, row.test_params.get("ROOTFS_URL")) == ("arm64", 3600, ["url-kernel-boot"], "i")
    assert "NODE_ID" not in row.test_params and "JOB_TESTS" not in row.test_params
    assert len(row.test_id) == len("job-arm64-") + 12
    row, _ = plan(spark, {**JOB, "environment": {"arch": "riscv"}, "timeout": 0})
    assert (row.arch, row.instance_type, row.max_runtime) == ("riscv", "c5a.4xlarge", 3600)
    own = {"x86_64": ("big", "img"), "arm64": ("small", "img2")}
    row, _ = plan(spark, JOB, platforms=own, dirs={"baseline": "b", "_default": "d"})
    assert (row.instance_type, row.test) == ("small", ["b", "d"])
    row, _ = plan(spark, {**JOB, "tests": []}, dirs={"_default": "d"})
    assert row.test == ["d"]


@pytest.mark.parametrize("lacking", ["kernel", "modules"])
def test_plan_needs_kernel_and_modules(spark, lacking):
    artifacts = {k: v for k, v in JOB["artifacts"].items() if k != lacking}
    row, bad = plan(spark, {**JOB, "artifacts": artifacts})
    assert row is None and bad.error_code == "invalid_job_params"


def test_unreadable_definition_is_rejected(spark):
    df = spark.createDataFrame([("n", "{oops")], "node_id string, definition string")
    assert jobs.plan_runs(df)[1].count() == 1


def test_editors(spark):
    rows = [("su", True, None), ("any", False, ["node:edit:any"]), ("ed", False, ["runtime:lab:node-editor"]), ("no", False, ["runtime:x:node-admin"]), ("none", False, None)]
    df = spark.createDataFrame(rows, "username string, is_superuser boolean, groups array<string>")
    assert {r.username for r in jobs.editor_grants(df, "lab").collect()} == {"su", "any", "ed"}


def messages(spark, rows):
    df = spark.createDataFrame([(s, float(at), m) for s, at, m in rows], "stream string, at double, message string")
    return df.selectExpr("stream", "timestamp_millis(cast(at * 1000 as bigint)) as ts", "monotonically_increasing_id() as seq", "message")


def test_log_events(spark):
    df = messages(spark, [("c/i-1/stdout", 1, "a"), ("c/i-1/stderr", 2, None), ("i-2", 3, "c"), ("c/i-1/stdout", 0.5, "z")])
    assert logs.log_events(df, "c/", 1000).count() == 2
    assert [r.message for r in logs.head_log_events(df, "c/i-1/stdout", 1).collect()] == ["z"]
    assert [r.stream for r in logs.recent_streams(df, 2).collect()] == ["i-2", "c/i-1/stderr"]
    grouped = logs.group_streams(df)
    assert {tuple(r) for r in logs.instance_counts(grouped).collect()} == {("i-1", 2, 1), ("i-2", 0, 0)}
    assert "[1970-01-01 00:00:02] " in {r.line for r in grouped.collect()}


def test_silent_gaps_against_lag(spark):
    rng = random.Random(2)
    rows = [(f"s{i % 3}", round(rng.random() * 3000, 3), "x") for i in range(400)] + [("hot", i / 10, "x") for i in range(3000)]
    df = messages(spark, rows)
    for threshold in (7, 20):
        wanted = set()
        for s in {r[0] for r in rows}:
            at = sorted(int(r[1] * 1000) * 1000 for r in rows if r[0] == s)
            wanted |= {(s, a, b) for a, b in zip(at, at[1:]) if b - a > threshold * 1_000_000}
        found = logs.silent_gaps(df, threshold).select("stream", "before_us", "after_us").collect()
        assert {tuple(r) for r in found} == wanted


def test_retention(spark):
    df = messages(spark, [("s", 0, "old"), ("s", 86400 * 5, "new")]).withColumn("log_group", F.lit("g"))
    now = F.expr("timestamp_seconds(86400 * 8)")
    none = spark.createDataFrame([], "log_group string, retention_days int")
    short = spark.createDataFrame([("g", 2)], "log_group string, retention_days int")
    assert [r.message for r in logs.retention_filter(df, none, now).collect()] == ["new"]
    assert logs.retention_filter(df, short, now).count() == 0


def test_audits(spark):
    files = ["a.src.rpm", "b.x86_64.rpm", "c.aarch64.rpm", "d.noarch.rpm", "e.txt"]
    assert {tuple(r) for r in audit.rpm_counts(spark.createDataFrame([(f,) for f in files], "name string")).collect()} == {("source", 1), ("x86_64", 1), ("aarch64", 1), ("skipped", 1)}
    paths = ["a/run-1.sh", "a/run-2.sh", "b/lib/run.sh", ".git/run.sh", "c/README"]
    assert [tuple(r) for r in audit.test_catalog(spark.createDataFrame([(p,) for p in paths], "path string")).collect()] == [("a", 2)]
    local = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "c")], "key string, md5 string")
    remote = spark.createDataFrame([("k1", '"a"'), ("k2", '"x"')], "key string, etag string")
    assert {r.key for r in audit.changed_objects(local, remote).collect()} == {"k2", "k3"}
    policy = json.dumps({"Statement": {"Sid": audit.LOGS_SID}})
    buckets = spark.createDataFrame([("b", policy, None), ("c", None, "{}")], "bucket string, policy string, public_access_block string")
    assert [(r.policies_allowed, r.statement_ok) for r in audit.policy_audit(buckets).collect()] == [(False, False), (False, False)]

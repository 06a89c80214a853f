import json

from pyspark.sql import functions as F

from tipwatch import sinks
from tipwatch.operators import outcomes, reporting

GOOD = "+ cp s3://b/run_1/test_boot/input/x\nTest execution completed: SUCCESS\n"
BAD = "+ cp s3://b/run_1/test_boot/input/x\nTest execution completed: FAILED\n"


def logs(spark):
    rows = [("r", "i-1", GOOD), ("r", "i-3", BAD), ("r", "i-2", BAD), ("r", "i-4", "no marks"), ("r", "i-5", None), ("q", "i-6", GOOD)]
    return spark.createDataFrame(rows, "run string, instance_id string, content string")


def runs(spark):
    rows = [("r", 5, 0, 125, "c"), ("q", None, 0, 59, None), ("p", 2, 0, 1, None)]
    df = spark.createDataFrame(rows, "run string, expected long, a long, b long, container_failure_log_url string")
    return df.selectExpr("run", "expected", "timestamp_seconds(a) as start_time", "timestamp_seconds(b) as end_time", "'task' as task_arn", "container_failure_log_url")


def test_summary(spark):
    found = outcomes.vm_outcomes(logs(spark))
    by = {r.instance_id: (r.test, r.status) for r in found.collect()}
    assert by["i-1"] == ("boot", "PASS") and by["i-4"] == ("unknown", "FAIL") and by["i-5"] == (None, None)
    rows = {r.run: r for r in outcomes.run_summary(found, runs(spark)).collect()}
    r, q, p = rows["r"], rows["q"], rows["p"]
    assert (r.actual, r.successful, r.failed, r.missing, r.status, r.total_runtime_formatted) == (5, 1, 3, 0, "partial_failure", "2m 5s")
    assert (q.expected, q.missing, q.status) == (None, 0, "success")
    assert (p.actual, p.missing, p.status) == (0, 2, "partial_failure")
    tests = {(t.run, t.test): t for t in outcomes.run_tests(found).collect()}
    assert tests["r", "boot"].first_failed == "i-2" and tests["r", "boot"].failed == 2
    failed = {(t.test, t.instance_id) for t in outcomes.failed_by_test(found).collect()}
    assert failed == {("boot", "i-2"), ("boot", "i-3"), ("unknown", "i-4")}


def read_summary(spark, docs, path):
    sinks.write_documents(docs, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    heads = {d["run_directory"]: d for d in lines if "kind" not in d}
    return heads, [d for d in lines if d.get("kind") == "test"], [d for d in lines if d.get("kind") == "instance"]


def test_summary_documents(spark, tmp_path):
    found = outcomes.vm_outcomes(logs(spark))
    docs = outcomes.summary_documents(outcomes.run_summary(found, runs(spark)), found)
    heads, tests, each = read_summary(spark, docs, str(tmp_path / "out"))
    assert {(d["test"], d["failed"]) for d in tests if d["run_directory"] == "r"} == {("boot", 2), ("unknown", 1)}
    assert {d["instance_id"] for d in each if d["run_directory"] == "r" and d["status"] == "FAIL"} == {"i-2", "i-3", "i-4"}
    assert heads["q"]["vms"]["expected"] is None and heads["q"]["container_failure_log_url"] is None
    assert not [d for d in each if d["run_directory"] == "p"]


def test_summary_is_whole_in_any_size(spark, tmp_path):
    many = spark.range(500).selectExpr("'r' as run", "concat('i-', id) as instance_id", "concat('t', id % 40) as test", "if(id % 5 = 0, 'FAIL', 'PASS') as status")
    summary = outcomes.run_summary(many, runs(spark).filter("run = 'r'"))
    heads, tests, each = read_summary(spark, outcomes.summary_documents(summary, many), str(tmp_path / "out"))
    assert list(heads) == ["r"] and heads["r"]["vms"]["actual"] == 500
    assert {d["test"] for d in tests} == {f"t{i}" for i in range(40)} and sum(d["vms"] for d in tests) == 500
    assert len({d["instance_id"] for d in each}) == len(each) == 500


def test_configurations(spark):
    schema = "run string, instance_type string, test array<string>, min_count int"
    df = spark.createDataFrame([("r", "c5", ["a", "b"], 2), ("r", None, ["a"], None), ("s", "c5", None, 3), ("s", "c5", ["z"], 0)], schema)
    assert {r.run: (r.expected, r.tests) for r in outcomes.expected_vms(df).collect()} == {"r": (5, 2), "s": (0, 1)}
    names = sorted(r.vm_name for r in outcomes.expand_tests(df).collect())
    assert names == ["c5-a-1", "c5-a-2", "c5-b-1", "c5-b-2", "vm-a-1"]
    assert outcomes.filter_vms_by_test(df, "z").count() == 1
    assert outcomes.filter_vms_by_test(df, "nowhere").count() == 4


def test_console_capture(spark):
    def run(*attempts):
        df = spark.createDataFrame([("i", n, r, c) for n, (r, c) in enumerate(attempts)], "instance_id string, attempt int, reason string, content string")
        row = outcomes.pick_console_capture(df, ["instance_id"]).first()
        return row and (row.reason, row.content)

    assert run(("cleanup", "a"), ("post-terminate", "b")) == ("post-terminate", "b")
    assert run(("ssm-failure", "a"), ("cleanup", "b"), ("post-terminate", "")) == ("ssm-failure", "a")
    assert run(("cleanup", "a"), ("cleanup", "b")) == ("cleanup", "a")
    assert run(("ssm-failure", ""), ("cleanup", "b")) == ("cleanup", "b")
    assert run(("cleanup", "")) is None


def stages(spark, rows):
    schema = "instance_id string, run_id int, exit_code int, runtime_s int, total_runs int, ord long"
    return spark.createDataFrame(rows, schema).selectExpr("'r' as run", "'t' as test", "*")


def test_stages(spark):
    df = stages(
        spark,
        [
            ("ok", 1, 194, 5, 2, 1), ("ok", 2, 0, 7, 2, 2),
            ("bad", 1, 0, 5, 3, 1), ("bad", 2, 250, 7, 3, 2), ("bad", 3, 0, 9, 3, 3),
            ("three", 1, 3, 5, 1, 1), ("boot", 1, 194, 5, 1, 1), ("busy", 1, 0, 5, 2, 1),
            ("again", 1, 1, 5, 1, 1), ("again", 1, 0, 6, 1, 2), ("over", 2, 0, 1, 1, 1),
        ],
    )
    progress = outcomes.stage_progress(df)
    stats = {r.instance_id: r for r in outcomes.stage_stats(progress).collect()}
    assert (stats["ok"].result, stats["ok"].runtime_seconds, stats["ok"].success, stats["ok"].failed_at_run) == ("SUCCESS", 12, True, None)
    assert (stats["bad"].result, stats["bad"].runtime_seconds, stats["bad"].last_run_runtime_seconds) == ("FAILED: Exit code 100 at run 2", 12, 7)
    assert (stats["bad"].completed_runs, stats["bad"].failed_at_run) == (1, 2)
    assert stats["three"].result == "FAILED: Exit code 3 at run 1"
    assert (stats["boot"].result, stats["boot"].success) == ("FAILED: Exit code 194", False)
    assert stats["again"].result == "SUCCESS"
    assert set(stats) == {"ok", "bad", "three", "boot", "again"}
    assert progress.filter("instance_id = 'bad'").count() == 2


def test_kernel_changed(spark):
    rows = [("i", 1, "6.1", "a", None), ("i", 2, "6.1", "a", ""), ("i", 3, "6.1", "b", "")]
    df = spark.createDataFrame(rows, "instance_id string, run_id int, release string, build string, image_hash string")
    found = outcomes.kernel_changed(df.selectExpr("'r' as run", "'t' as test", "*", "1L as ord")).orderBy("run_id").collect()
    assert [(r.run_id, r.changed) for r in found] == [(2, False), (3, True)]


def test_last_log(spark):
    keys = [f"run_1/test_boot/output/i-2/run-{n}-output.log" for n in (1, 2, 10)] + ["run_1/test_boot/output/i-3/run-99-output.log"]
    tests = spark.createDataFrame([("run_1", "boot", 2, 2, "i-2")], "run string, test string, vms long, failed long, first_failed string")
    row = outcomes.last_run_log(tests, spark.createDataFrame([(k,) for k in keys], "key string")).first()
    assert (row.key, row.run_number, row.more_failed) == (keys[2], 10, 1)


def test_small_rules(spark):
    df = spark.createDataFrame([(1, [(None,), (0,)]), (2, [(0,), (137,)]), (3, [])], "id int, c array<struct<exit_code:int>>")
    assert [r.f for r in df.orderBy("id").select(outcomes.container_failed(F.col("c")).alias("f")).collect()] == [False, True, False]
    fleet = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False)], "run string, success boolean")
    assert {r.run: r.success for r in outcomes.fleet_success(fleet).collect()} == {"a": True, "b": False}
    keys = "run_prefix string, test string, instance_id string, "
    launches = spark.createDataFrame([("r", "t", "i", False), ("r", "t", "j", True)], keys + "command_ok boolean")
    results = spark.createDataFrame([("r", "t", "i", True)], keys + "passed boolean")
    assert {r.instance_id: (r.success, r.overruled) for r in outcomes.result_source_of_truth(launches, results).collect()} == {"i": (True, True), "j": (False, False)}


KEYS = "run_prefix string, test string, instance_id string"


def test_manifest(spark):
    instances = spark.createDataFrame([("r", "baseline", "i-1"), ("r", "ub", "i-2")], KEYS)
    consoles = reporting.object_digest(spark.createDataFrame([("r", "baseline", "i-1", b"log")], KEYS + ", content binary"))
    entries = reporting.manifest_entries(instances, consoles, "bkt", "eu-west-1")
    docs = reporting.manifest_documents(entries, "bkt", None).orderBy("part", "id").collect()
    manifest, ready, missing = (json.loads(d.document) for d in docs)
    assert (manifest["schema_version"], manifest["s3_bucket"], manifest["origin"]) == (1, "bkt", None)
    assert ready["log_url"] == "https://bkt.s3.eu-west-1.amazonaws.com/r/test_baseline/output/i-1/console-output.log"
    assert (ready["status"], ready["size_bytes"], len(ready["sha256"]), ready["local_path"]) == ("ready", 3, 64, "vms/i-1-console.log")
    assert (missing["status"], missing["log_url"], missing["size_bytes"]) == ("missing", None, 0)
    assert reporting.manifest_documents(entries.limit(0), "bkt").count() == 0


def test_join_log_urls(spark):
    results = spark.createDataFrame([("r", "baseline", "i-1", "FAIL"), ("r", "ub", "i-2", None)], KEYS + ", status string")
    urls = spark.createDataFrame([("r", "baseline", "i-1", "u")], KEYS + ", log_url string")
    rows = {r.instance_id: (r.name, r.status, r.log_url) for r in reporting.join_log_urls(results, urls).collect()}
    assert rows == {"i-1": ("boot", "FAIL", "u"), "i-2": ("ub", "ERROR", None)}


RAW = "test_id string, build_id string, path string, status string, duration_ms long, log_url string, misc map<string,string>"


def test_report_rows(spark):
    raw = spark.createDataFrame([("n.i", "b", "boot", "pass", 2500, "u", {"k": "v"}), ("n.0", None, "a.b", None, None, "", {}), ("n.1", "b", "a b", "x", 1, "u", None)], RAW)
    good, rejected = reporting.build_report_rows(raw, "lab_1")
    assert [r.id for r in rejected.collect()] == ["lab_1:n.1"]
    doc = json.loads(reporting.report_documents(good, "b0", "lab_1").filter("build_id = 'b0'").first().document)
    assert doc == {"checkouts": [], "builds": [], "tests": [{"id": "lab_1:n.0", "build_id": "b0", "origin": "lab_1", "path": "a.b", "status": "ERROR"}], "version": {"major": 5, "minor": 3}}
    full = json.loads(reporting.report_documents(good).filter("build_id = 'b'").first().document)["tests"][0]
    assert full["duration"] == 2.5 and full["misc"] == {"k": "v"} and full["log_url"] == "u"
    try:
        reporting.build_report_rows(raw, "lab_1", strict=True)[0].collect()
        raise AssertionError("a bad path must fail")
    except Exception as error:
        assert "invalid report path" in str(error)


def test_node_results(spark):
    cases = {"a": ["PASS"], "b": ["DONE"], "c": ["PASS", "FAIL"], "d": ["PASS", "ERROR"], "e": ["MISS"], "f": ["SKIP"], "g": ["SKIP", "PASS"]}
    rows = [(n, s) for n, statuses in cases.items() for s in statuses]
    results = spark.createDataFrame(rows, "node_id string, status string")
    wanted = {"a": "pass", "b": "pass", "c": "fail", "d": "fail", "e": "fail", "f": "skip", "g": "pass"}
    assert {r.node_id: r.result for r in reporting.node_result(results).collect()} == wanted
    jobs = [("a", None, None, None), ("none", None, None, None), ("b", None, None, "boom"), ("c", None, "no kernel", None), ("d", "404", "x", "y")]
    out = reporting.node_outcome(spark.createDataFrame(jobs, "node_id string, fetch_error string, translate_error string, run_error string"), results)
    by = {r.node_id: (r.result, r.error_code) for r in out.collect()}
    assert by == {
        "a": ("pass", None), "none": ("incomplete", "Infrastructure"), "b": ("incomplete", "Infrastructure"),
        "c": ("incomplete", "invalid_job_params"), "d": ("incomplete", "Infrastructure"),
    }


def test_artifacts_and_ids(spark):
    df = spark.createDataFrame([({"job_definition": "j", "test_log": "old"}, ["u1", "u2"]), (None, ["u"]), ({"a": "b"}, [])], "old map<string,string>, urls array<string>")
    merged = [r.m for r in df.select(reporting.merge_artifacts(F.col("old"), F.col("urls")).alias("m")).collect()]
    assert merged == [{"job_definition": "j", "test_log": "u1", "test_log_1": "u2"}, {"test_log": "u"}, {"a": "b"}]
    ids = spark.createDataFrame([("n", "i", 3), ("n", None, 3), ("n", "", 4)], "n string, i string, x int")
    assert [r.r for r in ids.select(reporting.row_ids(F.col("n"), F.col("i"), F.col("x")).alias("r")).collect()] == ["n.i", "n.3", "n.4"]


def test_rows_of_jobs(spark):
    """Crashed, empty, mixed and never started jobs."""
    jobs = spark.createDataFrame(
        [("crash", "b", "u", None, None, "boom"), ("empty", "b", "u", None, None, None), ("mixed", None, "job", None, None, None), ("lost", "b", "u", "404", None, None), ("bad", "b", "u", None, "no kernel", None)],
        "node_id string, build_id string, log_url string, fetch_error string, translate_error string, run_error string",
    )
    results = spark.createDataFrame(
        [("mixed", 0, "boot", "pass", 1500, "own", "i-1"), ("mixed", 1, None, None, None, "", ""), ("mixed", 2, "ltp", "fail", 10, None, None), ("crash", 0, "boot", "pass", 1, None, None), ("lost", 0, "x", "pass", 1, None, None)],
        "node_id string, idx int, name string, status string, duration_ms long, log_url string, instance_id string",
    )
    good, rejected = reporting.build_report_rows(reporting.job_report_rows(jobs, results), "lab_1")
    rows = {r.id: r for r in good.collect()}
    assert rejected.count() == 0
    assert {k: (r.path, r.status, r.log_url) for k, r in rows.items()} == {
        "lab_1:crash.0": ("boot.infrastructure", "ERROR", None), "lab_1:empty.0": ("boot", "ERROR", "u"), "lab_1:mixed.i-1": ("boot", "PASS", "own"),
        "lab_1:mixed.1": ("test_1", "ERROR", "job"), "lab_1:mixed.2": ("ltp", "FAIL", "job"),
    }
    assert rows["lab_1:empty.0"].misc == {"node_id": "empty", "note": "executor returned no per-test results"}
    assert rows["lab_1:mixed.i-1"].misc["instance_id"] == "i-1" and rows["lab_1:mixed.1"].build_id == "unknown_mixed"


def test_output_files(spark):
    raw = spark.createDataFrame(
        [("a", "b", "boot", "pass", None, None, None, [("log", "u")]), ("c", "b", "boot", "pass", None, None, None, [])], RAW + ", output_files array<struct<name:string,url:string>>"
    )
    good, _ = reporting.build_report_rows(raw, "lab_1")
    docs = {t["id"]: t for r in reporting.report_documents(good).collect() for t in json.loads(r.document)["tests"]}
    assert docs["lab_1:a"]["output_files"] == [{"name": "log", "url": "u"}] and "output_files" not in docs["lab_1:c"]

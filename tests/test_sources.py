import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tipwatch import sinks
from tipwatch.functions import text
from tipwatch.operators import logs, offline, outcomes, rejects, verdicts
from tipwatch.sources import cut, groups, objects

HEADER = "metric,unit,value,more_is_better,kernel_version,instance_id,instance_type,arch\n"


def put(root, path, body):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.fixture
def run(tmp_path):
    out = "run_a_20240101_000000/test_ub/output"
    k = "6.1.141.x86_64"
    put(tmp_path, f"{out}/i-a/benchmark-base-6.1.csv", HEADER + "".join(f'm,"lps, all",{v},TRUE,{k},i-a,vm,x86_64\n' for v in (10, 11, 12)) + "m,lps,bad,true\n\n,lps,1,true\nm3\n")
    put(tmp_path, f"{out}/i-a/benchmark-tip-6.2.csv", "value,metric,note\n" + "1,m,x\n2,m,y\n3,m\n")
    put(tmp_path, f"{out}/i-b/benchmark-6.1.csv", HEADER + "m,lps,7,true,6.10.x86_64,i-b,vm,ARM64\n")
    put(tmp_path, f"{out}/i-b/other.csv", HEADER + "m,lps,9,true,6.9.aarch64,i-b,vm,x86_64\n")
    put(tmp_path, "run_a_20240101_000000/test_ub/input/benchmark-base-0.csv", HEADER + "m,lps,9,true\n")
    put(tmp_path, f"{out}/i-a/stats.json", json.dumps({"exit_code": 3, "success": False, "failed_at_run": 2}, indent=1))
    put(tmp_path, f"{out}/i-a/result.txt", "FAILED: Exit code 3 at run 2\n")
    put(tmp_path, f"{out}/i-b/result.txt", "SUCCESS\n")
    put(tmp_path, "vms/i-a.log", "one\ntwo\n")
    put(tmp_path, "vms/i-a-console.log", "boot\n")
    put(tmp_path, "artifacts.json", json.dumps({"run_prefix": "r", "artifacts": [{"test": "t", "instance_id": "i", "log_url": "u1"}, {"test": "t", "instance_id": "i", "log_url": "u2"}, {"test": "t", "log_url": "u"}, {"test": "t", "instance_id": "j", "log_url": None}]}))
    put(tmp_path, "broken/artifacts.json", "{not json")
    return tmp_path


def test_benchmark_files(spark, run):
    rows = objects.scan_benchmark_csv(spark, str(run))
    sides = {r["side"]: r["count"] for r in rows.groupBy("side").count().collect()}
    assert sides == {"base": 6, "tip": 3, "none": 1}
    clean = verdicts.clean_measurements(rows)
    base = clean.filter("side = 'base'").collect()
    assert {(r.unit, r.more_is_better) for r in base} == {("lps, all", True)} and sorted(r.value for r in base) == [10, 11, 12]
    tip = clean.filter("side = 'tip'").first()
    assert (tip.metric, tip.more_is_better, tip.kernel_version, tip.instance_id) == ("m", True, "unknown", "i-a")
    row = verdicts.compare(clean).first()
    assert (row.test, row.metric, row.unit, row.n_base, row.n_tip, row.is_regression) == ("ub", "m", "lps, all", 3, 3, True)
    rollup = verdicts.test_rollup(verdicts.compare(clean), rows).first()
    assert (rollup.base_kernel, rollup.tip_kernel) == ("6.1.141.x86_64", "unknown")


def test_missing_value_column_is_zero(spark):
    files = spark.createDataFrame([("run_a/test_t/output/i/benchmark-base-1.csv", "metric,unit\nm,s\n")], "path string, content string")
    row = verdicts.clean_measurements(objects.benchmark_rows(files)).first()
    assert (row.value, row.more_is_better, row.flag_defaulted) == (0.0, True, False)


def test_repeated_header_and_quotes(spark):
    body = 'metric,value,metric\r\nfirst,1,"la""st, one"\r\n"multi\nline",2,x\r\n,,\r\n'
    files = spark.createDataFrame([("p", body)], "path string, content string")
    rows = objects.parse_csv(files, ["metric", "value"]).orderBy("pos").collect()
    assert [(r.metric, r.value) for r in rows] == [('la"st, one', "1"), ("x", "2"), ("", "")]


def test_long_quoted_field(spark):
    files = spark.createDataFrame([("p", 'a,b\n"' + "x" * 200000 + '",2\n' + "y" * 200000 + ",3\n")], "path string, content string")
    rows = objects.parse_csv(files, ["a", "b"]).orderBy("pos").collect()
    assert [(len(r.a), r.b) for r in rows] == [(200000, "2"), (200000, "3")]


def test_offline_files(spark, run):
    rows = objects.scan_offline_csv(spark, str(run))
    assert {r.source_file for r in rows.collect()} == {
        "ub_i-a_benchmark-base-6.1.csv", "ub_i-a_benchmark-tip-6.2.csv", "ub_i-b_benchmark-6.1.csv", "ub_i-b_other.csv"
    }
    extras = rows.filter("source_file like '%tip%'").orderBy("pos").collect()
    assert [r.extras["note"] for r in extras] == ["x", "y", None]
    assert {r.source_file for r in objects.scan_offline_csv(spark, str(run), "benchmark-*.csv").collect()} == {
        "ub_i-a_benchmark-base-6.1.csv", "ub_i-a_benchmark-tip-6.2.csv", "ub_i-b_benchmark-6.1.csv"
    }
    with pytest.raises(ValueError):
        objects.scan_offline_csv(spark, str(run), "*.txt")


def test_other_files(spark, run):
    assert [tuple(r) for r in objects.scan_vm_logs(spark, str(run)).select("instance_id", "content").collect()] == [("i-a", "one\ntwo\n")]
    results = {r.instance_id: r.passed for r in objects.scan_result_files(spark, str(run)).collect()}
    assert results == {"i-a": False, "i-b": True}
    stats = objects.scan_stage_stats(spark, str(run)).first()
    assert (stats.instance_id, stats.exit_code, stats.success, stats.failed_at_run, stats.total_runs) == ("i-a", 3, False, 2, None)
    urls = objects.manifest_log_urls(objects.scan_manifest(spark, str(run))).collect()
    assert [(r.test, r.instance_id, r.log_url) for r in urls] == [("t", "i", "u2")]


def test_instances(spark):
    keys = ["run_a/test_x/output/i-1/f", "run_a/test_x/output/i-1/g", "run_a/_config/output/i-2/f", "run_a/test_x/input/i-3/f", "run_a/test_y/output/i-4/d/e"]
    found = objects.discover_instances(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {tuple(r) for r in found.collect()} == {("run_a", "x", "i-1"), ("run_a", "y", "i-4")}


def test_unixbench_log(spark):
    log = """Dhrystone 2 using register variables 1.0 lps (10.0 s, 7 samples)
Arithmetic Test (double)          5.5 lps   (10.0 s, 7 samples)
short line
System Call Overhead   7 lps (10.0 s, 7 samples)

System Benchmarks Index Values  BASELINE RESULT INDEX
Late Test 9 lps (10.0 s, 7 samples)
"""
    rows = objects.unixbench_rows(spark.createDataFrame([(1, log)], "id int, content string")).orderBy("pos").collect()
    assert [(r.metric, r.unit, r.value) for r in rows] == [
        ("byte-unixbench-6.0.0.Arithmetic_Test_(double)", "lps", "5.5"),
        ("byte-unixbench-6.0.0.System_Call_Overhead", "lps", "7"),
    ]


OFFLINE = "metric string, unit string, value double, more_is_better boolean, kernel_version string, arch string, ord long"


def offline_rows(spark, rows):
    return spark.createDataFrame([(m, "u", v, b, k, a, i) for i, (m, v, b, k, a) in enumerate(rows)], OFFLINE)


def test_two_kernels(spark):
    rows = offline_rows(
        spark,
        [
            ("up", 100.0, True, "6.10.x86_64", "x86_64"), ("up", 101.0, True, "6.9.x86_64", "x86_64"),
            ("down", 100.0, True, "6.10.x86_64", "x86_64"), ("down", 90.0, True, "6.9.aarch64", "ARM64"),
            ("less", 10.0, False, "6.10.aarch64", "aarch64"), ("less", 12.0, False, "6.9", "arm64"),
            ("zero", 0.0, True, "6.10", "x86_64"), ("zero", 5.0, True, "6.9", "x86_64"),
            ("alone", 5.0, True, "6.10", "x86_64"), ("nan", float("nan"), True, "6.10", "x86_64"), ("nan", 1.0, True, "6.9", "x86_64"),
            ("up", 900.0, True, "7.0", "x86_64"),
        ],
    )
    result = offline.compare_kernels(rows)
    found = {(r.metric, r.arch): r for r in result.collect()}
    assert (found["up", "all"].kernel_a, found["up", "all"].kernel_b) == ("6.10", "6.9")  # text order
    assert set(found) == {("up", "all"), ("up", "x86_64"), ("down", "all"), ("less", "all"), ("less", "aarch64"), ("zero", "all"), ("zero", "x86_64")}
    assert found["up", "all"].percent_change == pytest.approx(1.0) and not found["up", "all"].is_regression
    assert found["down", "all"].is_regression and found["less", "aarch64"].is_regression
    assert found["zero", "all"].percent_change == 0 and not found["zero", "all"].is_regression
    assert {r.metric for r in offline.significant_change(result).collect()} == {"down", "less"}
    counts = {r.arch: (r.total, r.regressions, r.improvements) for r in offline.offline_counts(result).collect()}
    assert counts["all"] == (4, 2, 2)
    assert offline.sort_regressions(result).first().metric == "down"
    assert "6.10_mean" in offline.with_kernel_columns(result, "6.10", "6.9").columns
    own = spark.createDataFrame([("6.9", "7.0")], "kernel_a string, kernel_b string")
    assert {r.metric for r in offline.compare_kernels(rows, own).collect()} == {"up"}


def test_one_kernel_gives_nothing(spark):
    rows = offline_rows(spark, [("m", 1.0, True, "6.1", "x86_64")])
    assert offline.two_lowest_kernels(rows).first().kernel_b is None
    assert offline.compare_kernels(rows).count() == 0
    with pytest.raises(Exception, match="two kernel versions"):
        offline.compare_kernels(rows, strict=True).count()


def test_suite_prefix(spark):
    rows = [("f", 1, "Byte-UnixBench-6.0.0.Pipe"), ("f", 2, "byte-unixbench-6.0.0. Execl"), ("f", 3, "plain"), ("g", 1, "plain"), ("g", 2, "byte-unixbench-5.1.Pipe")]
    df = spark.createDataFrame(rows, "source_file string, pos int, metric string")
    got = offline.strip_suite_prefix(df)
    found = {(r.source_file, r.pos): (r.metric, r.unixbench_version) for r in got.collect()}
    assert found["f", 1] == ("Pipe", "Byte-UnixBench-6.0.0.") and found["f", 2][0] == "Execl" and found["f", 3][0] == "plain"
    assert found["g", 2] == ("byte-unixbench-5.1.Pipe", None)
    assert offline.suite_label(got).first().label == "Byte-UnixBench-6.0.0."
    assert offline.suite_label(got.filter("source_file = 'g'")).first().label == ""


def test_instance_logs_keep_order(spark, tmp_path):
    rows = [(f"i-{i % 3}", ("stdout", "stderr")[i % 2], i * 7919 % 1000, i) for i in range(600)] + [("i-9", None, 1, 1)]
    rows += [(f"small-{i}", "stdout", 0, i) for i in range(40)]
    df = spark.createDataFrame(rows, "instance_id string, channel string, at int, seq int")
    grouped = df.selectExpr("instance_id", "channel", "timestamp_seconds(at) as ts", "seq", "concat(channel, ' ', lpad(cast(at as string), 4, '0'), ' ', lpad(cast(seq as string), 4, '0')) as line")
    out = str(tmp_path / "out")
    sinks.write_instance_logs(grouped, out, 4000)
    index = spark.read.parquet(f"{out}/index").collect()
    assert {r.instance_id for r in index} == {"i-0", "i-1", "i-2", *(f"small-{i}" for i in range(40))}
    files = {r.file for r in index}
    assert 3 <= len(files) <= 8 and any(sum(r.file == f for r in index) > 10 for f in files)  # files follow bytes
    assert any(len({r.file for r in index if r.instance_id == i}) > 1 for i in ("i-0", "i-1", "i-2"))
    for i in range(3):
        found = sinks.read_instance_log(spark, out, f"i-{i}")
        assert len(found.inputFiles()) == sum(r.instance_id == f"i-{i}" for r in index)
        lines = [r.line for r in found.orderBy("place").collect()]
        assert len(lines) == 200 and lines == sorted(x for x in lines if x.startswith("stdout")) + sorted(x for x in lines if x.startswith("stderr"))
        sinks.export_instance_log(spark, out, f"i-{i}", str(tmp_path / f"text{i}"))
        assert [x for f in sorted((tmp_path / f"text{i}").glob("part-*")) for x in f.read_text().splitlines()] == lines
    assert sinks.read_instance_log(spark, out, "i-9").count() == 0


def test_container_log(spark, tmp_path):
    rows = [(5, 2, "b"), (5, 1, "a"), (None, 3, "never"), (70, 4, None)]
    events = spark.createDataFrame(rows, "at int, seq int, message string").selectExpr("timestamp_seconds(at) as ts", "seq", "message")
    sinks.write_container_log(logs.container_lines(events), str(tmp_path / "out"))
    text = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split("\n")[:-1]]
    stamp = "[1970-01-01 00:0{}] [CONTAINER] "
    assert text == [stamp.format("0:00") + "never", stamp.format("0:05") + "a", stamp.format("0:05") + "b", stamp.format("1:10")]


@pytest.fixture
def small_cuts(spark):
    """Tasks read 64 bytes of a file."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_file_over_many_tasks_has_the_same_rows(spark, tmp_path, small_cuts):
    draw = random.Random(6)
    cells = ["a", "", "b c", '"q,r"', '"two\nlines"', '"say ""x"""', '"\n\n"', '"cr\r\nlf"', "x" * 90, '"' + "y\n" * 60 + '"', "é", 'in"ner"']
    bodies = []
    for i in range(12):
        head = draw.choice(["m,v,m", "v,w,m", '"m",v', "v"])
        rows = [",".join(draw.choices(cells, k=draw.randrange(1, 5))) for _ in range(draw.randrange(0, 60))]
        bodies.append("\n" * (i % 3) + draw.choice(["\n", "\r\n"]).join([head, *rows]) + draw.choice(["", "\n"]))
    bodies += ["", "\n\n", "m,v", "m,v\n1,2\n" * 40, "m\rv\r" * 20, 'm,v\n1,"open\n2,3\n']
    for i, body in enumerate(bodies):
        put(tmp_path, f"run/{i:02}.csv", body)
    found = objects.read_headed(spark, str(tmp_path / "run"), ["m", "v"], "*.csv", whole_bytes=0)
    whole = objects.parse_csv(spark.createDataFrame([(f"{i:02}.csv", b) for i, b in enumerate(bodies)], "path string, content string"), ["m", "v"])

    def rows(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.path[-6:], []).append((r.pos, r.m, r.v, sorted(r.present), r.extras))
        return {k: [x[1:] for x in sorted(v, key=lambda x: x[0])] for k, v in out.items()}

    assert rows(found) == rows(whole)
    big = cut.read_lines(spark, str(tmp_path / "run"), "15.csv")
    assert big.select("block").distinct().count() >= 4
    mixed = objects.read_headed(spark, str(tmp_path / "run"), ["m", "v"], "*.csv", whole_bytes=200)
    assert rows(mixed) == rows(whole)


def test_large_benchmark_files_scan_alike(spark, run, small_cuts):
    def told(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)

    root = str(run)
    texts = objects.read_texts(spark, root, "*benchmark-*.csv")
    columns = ("run_prefix", "test", "side", "metric", "unit", "value", "more_is_better", "kernel_version", "instance_id", "arch")
    assert told(objects.scan_benchmark_csv(spark, root), *columns) == told(objects.benchmark_rows(texts), *columns)
    columns = ("test", "instance", "source_file", "metric", "value", "extras")
    assert told(objects.scan_offline_csv(spark, root), *columns) == told(objects.offline_rows(objects.read_texts(spark, root, "*.csv")), *columns)
    kept = verdicts.clean_measurements(objects.scan_benchmark_csv(spark, root))
    assert verdicts.kernel_of_side(objects.scan_benchmark_csv(spark, root)).count() == 2 and kept.count() == 7


def test_excerpts_of_lines_are_those_of_whole_logs(spark, tmp_path, small_cuts):
    draw = random.Random(9)
    parts = ["Warning: a", "warn", "+ error x", "ERROR one", "it failed", "ok", "", "  error  two  ", "a\x0bfailed b", "warning\u2028error", "x" * 150 + " error", "test_a/input/ y", "no test_b, /input/", "test_/input/"]
    bodies = ["\n".join(draw.choices(parts, k=draw.randrange(0, 40))) for _ in range(25)]
    for i, body in enumerate(bodies):
        put(tmp_path, f"logs/{i:02}.log", body)
    lines, files = cut.read_lines(spark, str(tmp_path / "logs")), cut.read_files(spark, str(tmp_path / "logs"))
    got = {r.path[-6:]: (r.warnings, r.errors) for r in outcomes.excerpts_of_lines(lines, files).collect()}
    whole = spark.createDataFrame([(f"{i:02}.log", b) for i, b in enumerate(bodies)], "path string, content string")
    assert got == {r.path: (r.warnings, r.errors) for r in outcomes.failure_excerpts(whole).collect()}
    tests = {r.path[-6:]: r.test for r in outcomes.tests_of_lines(lines, files).collect()}
    assert tests == {r.path: "unknown" if r.t is None else r.t for r in whole.select("path", text.test_of_log(F.col("content")).alias("t")).collect()}
    failures = {}
    for r in outcomes.failures_of_lines(lines).orderBy("path", "block", "line", "part").collect():
        failures.setdefault(r.path[-6:], []).append(r.text)
    found = whole.select("path", text.failure_lines(text.split_lines(F.col("content"))).alias("l")).collect()
    assert failures == {r.path: r.l for r in found if r.l}


def test_redaction_over_cuts_is_that_of_whole_texts(spark, tmp_path, small_cuts):
    draw = random.Random(12)
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join("M" * 60 for _ in range(8)) + "\n-----END RSA PRIVATE KEY-----"
    parts = [key, "before " + key + " after", "plain line", "", " ", "\r", "password", ":", "=", "'", "hunter2-secret", "x password =", "Authorization: Bearer", "tok12345678", "ssh-rsa", "A" * 50,
             "api_key=AKIA" + "0" * 16, "-----END RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN A PRIVATE KEY----- x -----END A PRIVATE KEY----- y", "session_token: \"abc-def-1234\""]
    bodies = ["\n".join(draw.choices(parts, k=draw.randrange(1, 30))) for _ in range(30)] + [key, "a\n" + key, "-----BEGIN RSA PRIVATE KEY-----\nopen\n" + "line\n" * 50 + "password=opensecret"]
    for i, body in enumerate(bodies):
        put(tmp_path, f"texts/{i:02}.log", body)
    lines = cut.read_lines(spark, str(tmp_path / "texts"))
    assert lines.filter("path like '%/30.log'").select("block").distinct().count() >= 3  # a key over three ranges and more
    got, hits = {}, {}
    for r in text.scrub_lines(lines).orderBy("path", "block", "line").collect():
        got.setdefault(r.path[-6:], []).append(r.value)
        for kind, n in r.redactions.items():
            hits.setdefault(r.path[-6:], Counter())[kind] += n
    whole = text.scrub(spark.createDataFrame([(f"{i:02}.log", b) for i, b in enumerate(bodies)], "path string, text string")).collect()
    for r in whole:
        # a line feed at the very end of a file begins no further line
        assert "\n".join(got.get(r.path, [])) in (r.text, r.text.removesuffix("\n")), r.path
        assert dict(hits.get(r.path, {})) == r.redactions, r.path
    assert sum(r.redactions.get("pem-private-key", 0) for r in whole) > 10 and sum(r.redactions.get("bearer-token", 0) for r in whole) > 2


def test_the_number_of_cuts_does_not_grow_with_the_files(spark, tmp_path):
    """Six megabytes of logs: their files are cut, but into no more ranges than a fixed number and one a file."""
    from tipwatch.plans import logs as plans

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    docs = spark.range(2400).selectExpr("id as doc_id", "concat('line ', id, repeat(concat(chr(10), 'some words of a line'), 120)) as text", "'en' as lang", "'s' as source", "id as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for lines, files, share in ((plans._cut_texts(spark, str(tmp_path)), 8, 1), (plans._cut_lines(spark, str(tmp_path))[0], 40, 28 / 29)):
        ranges = lines.select("path", "block").distinct().count()
        assert 2 * files < ranges <= 256 + files + 2 and len(lines.inputFiles()) <= 256 + files + 2
        assert lines.filter("value = 'some words of a line'").count() == pytest.approx(2400 * 120 * share, rel=0.01)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_log_groups(spark, tmp_path):
    root = str(tmp_path / "groups")
    assert groups.read_log_group(spark, root, "/ec2/t", "r1").count() == 0
    rows = [("/ec2/t", "r1", None, "cmd1/i-1/stdout", 5, 1, "a"), ("/ec2/t", "r1", "console", "s", 6, 2, "b"), ("/ec2/t", None, None, "s", 7, 3, "c"), ("/ec2/u", "r1", None, "s", 8, 4, "d")]
    events = spark.createDataFrame(rows, "base string, run string, suffix string, stream string, at int, seq long, message string")
    events = events.selectExpr("base", "run", "suffix", "stream", "timestamp_seconds(at) as ts", "seq", "message")
    groups.write_log_events(events, root)
    groups.write_log_events(events.limit(0), root)

    def seqs(*name, **more):
        return [r.seq for r in groups.read_log_group(spark, root, *name, **more).collect()]

    assert seqs("/ec2/t", "r1") == [1] and seqs("/ec2/t", "r1", "console") == [2] and seqs("/ec2/t") == [3] and seqs("/ec2/u", "r1") == [4]
    assert seqs("/ec2/t", "r2") == [] and seqs("/ec2/none") == []
    assert seqs("/ec2/t", "r1", stream_prefix="cmd2") == [] and seqs("/ec2/t", "r1", start_ms=5000) == [1] and seqs("/ec2/t", "r1", start_ms=5001) == []
    one = groups.read_log_group(spark, root, "/ec2/t", "r1")
    assert "PartitionFilters: [isnotnull(base" in one._jdf.queryExecution().executedPlan().toString()
    named = groups.read_log_groups(spark, root, [("/ec2/t", "r1", "console"), ("/ec2/x",), ("/ec2/t",)])
    assert sorted((r.log_group, r.seq) for r in named.collect()) == [("/ec2/t", 3), ("/ec2/t/r1/console", 2)]


def test_bad_records_are_set_aside_and_counted(spark, run, tmp_path):
    rows = objects.scan_benchmark_csv(spark, str(run))
    bad = verdicts.rejected_measurements(rows).collect()
    assert sorted((r.metric or "", r.value or "", r.reason) for r in bad) == [("", "1", "no metric"), ("m", "bad", "no number")] or len(bad) == 3
    watched, seen = rejects.counted(verdicts.judged_measurements(rows), ["no metric", "no number"])
    watched.write.format("noop").mode("overwrite").save()
    got = seen.get
    assert got["read"] == rows.count() == got["kept"] + got["no metric"] + got["no number"]
    assert got["kept"] == verdicts.clean_measurements(rows).count() and len(bad) == got["read"] - got["kept"]
    place = "run_a/test_t/output/i-1/stats.json"
    files = [(place, json.dumps({"exit_code": 3, "success": False})), (place, '{"exit_code": 3'), (place, " "), (place, None), ("stats.json", "{}"), ("other.json", "x")]
    stats = rejects.judged_stage_stats(spark.createDataFrame(files, "path string, content string")).collect()
    assert [(r.exit_code, r.reason) for r in stats][:1] == [(3, None)] and [r.reason for r in stats] == [None, "unreadable", "empty", "empty", "outside the layout"]
    assert [r.content for r in stats][:2] == [None, '{"exit_code": 3']
    entry = {"test": "t", "instance_id": "i", "log_url": "u"}
    docs = [json.dumps({"run_prefix": "r", "artifacts": [entry, {"test": "t"}]}), json.dumps({"run_prefix": "r", "artifacts": []}), "{cut", None]
    found = rejects.judged_manifests(spark.createDataFrame([(d,) for d in docs], "content string")).collect()
    assert [(r.run_prefix, r.pos, r.reason) for r in found][:3] == [("r", 0, None), ("r", 1, "no test or instance"), ("r", None, "no entries")]
    assert [r.reason for r in found][3:] == ["unreadable", "empty"]
    keys = [("run_a/test_t/output/i-1/x.log",), ("run_a/test_t/input/i-1/x",), ("elsewhere/x",)]
    assert [r.reason for r in rejects.judged_keys(spark.createDataFrame(keys, "key string")).collect()] == [None, "no output", "outside the layout"]


def test_a_landed_folder_is_cut_by_its_bytes(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        rows = spark.range(60000).selectExpr("'run_a_20240101_000000' as run", "case when id % 100 = 0 then 'small' else 'hot' end as test", "cast(rand(3) * id as string) as value").repartition(16)
        sinks.land_measurements(rows, str(tmp_path / "landed"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {t: len(list((tmp_path / "landed").rglob(f"test={t}/part-*"))) for t in ("hot", "small")}
    assert files["hot"] > 8 and files["small"] <= 8
    assert spark.read.parquet(str(tmp_path / "landed")).count() == 60000

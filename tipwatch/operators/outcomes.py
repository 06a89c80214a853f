"""From VM logs, stages and configurations to outcomes and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipwatch.functions import report, text
from tipwatch.operators.chunks import documents

UNKNOWN = "unknown"
REBOOT_CODE = 194
MAX_CODE = 100


def vm_outcomes(logs: DataFrame) -> DataFrame:
    """One row per VM log ``(run, instance_id, content)``: test name, PASS or FAIL. Null content means unreadable."""
    status = F.when(F.col("content").contains(text.SUCCESS_LINE), "PASS").otherwise("FAIL")
    readable = F.col("content").isNotNull()
    test = F.coalesce(text.test_of_log(F.col("content")), F.lit(UNKNOWN))
    return logs.select("run", "instance_id", F.when(readable, test).alias("test"), F.when(readable, status).alias("status"))


def run_summary(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run in ``runs(run, start_time, end_time, task_arn, expected, container_failure_log_url)``.

    ``expected`` may be null (not known). Names and failing instances are in ``run_tests``.
    """
    counts = outcomes.groupBy("run").agg(
        F.count("*").alias("actual"),
        F.count_if(F.col("status") == "PASS").alias("successful"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    )
    joined = runs.join(counts, "run", "left").fillna(0, ["actual", "successful", "failed"])
    short = F.coalesce(F.col("expected") != F.col("actual"), F.lit(False))
    seconds = F.unix_micros("end_time") / 1000000 - F.unix_micros("start_time") / 1000000
    stamp = "yyyy-MM-dd HH:mm:ss"
    return joined.select(
        "run",
        F.date_format("start_time", stamp).alias("start_time"),
        F.date_format("end_time", stamp).alias("end_time"),
        F.floor(seconds).alias("total_runtime_seconds"),
        report.runtime_text(seconds).alias("total_runtime_formatted"),
        "task_arn",
        F.when(short | (F.col("failed") > 0), "partial_failure").otherwise("success").alias("status"),
        "expected",
        "actual",
        "successful",
        "failed",
        F.coalesce(F.col("expected") - F.col("actual"), F.lit(0)).alias("missing"),
        "container_failure_log_url",
    )


def run_tests(outcomes: DataFrame) -> DataFrame:
    """Per (run, test): VMs, failures and the first failing instance, from which excerpts are taken."""
    failed = F.col("status") == "FAIL"
    return outcomes.filter("status is not null").groupBy("run", "test").agg(
        F.count("*").alias("vms"),
        F.count_if(failed).alias("failed"),
        F.min(F.when(failed, F.col("instance_id"))).alias("first_failed"),
    )


def failed_by_test(outcomes: DataFrame) -> DataFrame:
    """The failing instances of each (run, test), a row each."""
    return outcomes.filter("status = 'FAIL'").select("run", "test", "instance_id")


def summary_documents(summary: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The run summary as JSON documents ``(run, part, id, document)``.

    The header of a run has its counts; a document of kind ``test`` for each test name its VMs and failures, one of
    kind ``instance`` for each instance its test and status. Together they hold the whole run, in any size.
    """
    vms = F.struct("expected", "actual", "successful", "failed", "missing")
    head = ["start_time", "end_time", "total_runtime_seconds", "total_runtime_formatted", "task_arn", "status"]
    heads = summary.select("run", F.struct(F.col("run").alias("run_directory"), *head, vms.alias("vms"), "container_failure_log_url").alias("body"))
    kind = lambda name, *fields: F.struct(F.col("run").alias("run_directory"), F.lit(name).alias("kind"), *fields)
    none = F.lit(None)
    tests = run_tests(outcomes).select(
        "run", F.concat(F.lit("test/"), "test").alias("id"),
        kind("test", "test", none.cast("string").alias("instance_id"), none.cast("string").alias("status"), "vms", "failed").alias("body"),
    )
    each = outcomes.filter("status is not null").select(
        "run", F.concat_ws("/", F.lit("vm"), "instance_id", "test").alias("id"),
        kind("instance", "test", "instance_id", "status", none.cast("long").alias("vms"), none.cast("long").alias("failed")).alias("body"),
    )
    return documents(heads, tests.unionByName(each), ["run"])


def expected_vms(configs: DataFrame) -> DataFrame:
    """Per run: VMs to expect and distinct tests, from ``(run, test ARRAY<STRING>, min_count)``."""
    copies = F.coalesce("min_count", F.lit(1)) * F.coalesce(F.size(F.coalesce("test", F.array().cast("array<string>"))), F.lit(0))
    totals = configs.groupBy("run").agg(F.sum(copies).cast("long").alias("expected"))
    tests = configs.select("run", F.explode("test").alias("test")).distinct().groupBy("run").agg(F.count("*").alias("tests"))
    return totals.join(tests, "run", "left").fillna(0, ["tests"])


def expand_tests(configs: DataFrame) -> DataFrame:
    """One row per VM to launch: every test of a configuration, as many copies as asked, numbered from 1."""
    per_test = configs.withColumn("test", F.explode("test"))
    copies = F.coalesce("min_count", F.lit(1))
    numbers = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    named = F.concat_ws("-", F.coalesce("instance_type", F.lit("vm")), "test", "copy")
    return per_test.withColumn("copy", F.explode(numbers)).withColumn("vm_name", named)


def filter_vms_by_test(configs: DataFrame, wanted: str) -> DataFrame:
    """Configurations with a test whose name contains ``wanted``; all of them if there is no such."""
    matches = F.exists("test", lambda t: t.contains(wanted))
    found = configs.agg(F.coalesce(F.bool_or(matches), F.lit(False)).alias("any")).scalar()
    return configs.filter(F.coalesce(matches, F.lit(False)) | ~found)


def fleet_success(results: DataFrame) -> DataFrame:
    """Per run: true if it has results and all succeeded. Runs without results are those missing here."""
    total = F.count("*")
    good = F.count_if("success")
    return results.groupBy("run").agg(
        total.alias("total"), good.alias("successful"), (total - good).alias("failed"), (good == total).alias("success")
    )


def container_failed(containers: Column) -> Column:
    return F.exists(containers, lambda c: F.coalesce(c["exit_code"], F.lit(0)) != 0)


def result_source_of_truth(launches: DataFrame, results: DataFrame) -> DataFrame:
    """A VM passed iff its result file says so, whatever the launcher's command status was."""
    keys = ["run_prefix", "test", "instance_id"]
    passed = F.coalesce("passed", F.lit(False))
    joined = launches.join(results, keys, "left")
    return joined.select(*keys, "command_ok", passed.alias("success"), (passed & ~F.col("command_ok")).alias("overruled"))


def pick_console_capture(captures: DataFrame, keys: list[str]) -> DataFrame:
    """The console kept per instance, from attempts ``(keys, attempt, reason, content)``.

    A non-empty attempt replaces an earlier one, except that ``cleanup`` does nothing once one was kept. So the last
    non-empty attempt of another kind wins; without one, the first non-empty ``cleanup``.
    """
    usable = captures.filter("content <> ''")
    cleanup = F.col("reason") == "cleanup"
    picked = usable.groupBy(*keys).agg(
        F.max_by(F.when(~cleanup, F.struct("attempt", "reason", "content")), F.when(~cleanup, F.col("attempt"))).alias("late"),
        F.min_by(F.when(cleanup, F.struct("attempt", "reason", "content")), F.when(cleanup, F.col("attempt"))).alias("spare"),
    )
    return picked.select(*keys, F.coalesce("late", "spare").alias("c")).select(*keys, "c.*")


def stage_progress(stages: DataFrame) -> DataFrame:
    """Chain of stages per instance, up to the first failure or the last stage.

    Stages: ``run, test, instance_id, run_id, exit_code, runtime_s, total_runs, ord``. A stage uploaded twice counts
    once, with its last upload; run_id cannot exceed total_runs. That bounds each group by the number of scripts.
    """
    keys = ["run", "test", "instance_id"]
    fields = ["exit_code", "runtime_s", "total_runs"]  # numbers, so that Spark can aggregate them by hash
    valid = stages.filter("run_id between 1 and total_runs")
    once = valid.groupBy(*keys, "run_id").agg(*[F.max_by(c, "ord").alias(c) for c in fields])
    code = F.when(F.col("exit_code").isin(0, REBOOT_CODE), F.col("exit_code")).otherwise(F.least("exit_code", F.lit(MAX_CODE)))
    bad = ~F.col("code").isin(0, REBOOT_CODE)
    chain = Window.partitionBy(*keys).orderBy("run_id")
    so_far = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = once.withColumn("code", code).withColumns(
        {
            "runtime_seconds": F.sum("runtime_s").over(so_far).cast("long"),
            "earlier_failures": F.coalesce(
                F.count(F.when(bad, 1)).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        }
    )
    step = F.when(F.col("code") == 0, "ok").when(F.col("code") == REBOOT_CODE, "reboot").otherwise("failed")
    return scored.filter("earlier_failures = 0").select(
        *keys, "run_id", "code", F.col("runtime_s").alias("last_run_runtime_seconds"), "runtime_seconds", "total_runs", step.alias("step")
    )


def stage_stats(progress: DataFrame) -> DataFrame:
    """Final ``stats`` and result line of instances that failed or reached their last stage."""
    ended = progress.filter("step = 'failed' or run_id = total_runs")
    failed = F.col("step") == "failed"
    code = F.col("code").cast("string")
    result = (
        F.when(failed, F.concat(F.lit("FAILED: Exit code "), code, F.lit(" at run "), F.col("run_id").cast("string")))
        .when(F.col("code") == 0, "SUCCESS")
        .otherwise(F.concat(F.lit("FAILED: Exit code "), code))
    )
    return ended.select(
        "run",
        "test",
        "instance_id",
        F.col("code").alias("exit_code"),
        "runtime_seconds",
        "last_run_runtime_seconds",
        (F.col("code") == 0).alias("success"),
        "total_runs",
        F.when(failed, F.col("run_id") - 1).alias("completed_runs"),
        F.when(failed, F.col("run_id")).alias("failed_at_run"),
        result.alias("result"),
    )


def kernel_changed(stages: DataFrame) -> DataFrame:
    """Stage pairs of an instance with the kernel identity before and after; equal identities are a failure.

    Stages: ``run, test, instance_id, run_id, release, build, image_hash, ord``; repeats count once, as above.
    """
    keys = ["run", "test", "instance_id"]
    identity = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("release", "build", "image_hash")])
    once = stages.groupBy(*keys, "run_id").agg(F.max(F.struct("ord", identity.alias("id"))).alias("s"))
    before = F.lag("s.id").over(Window.partitionBy(*keys).orderBy("run_id"))
    pairs = once.select(*keys, "run_id", before.alias("kernel_before"), F.col("s.id").alias("kernel_after"))
    changed = F.col("kernel_before") != F.col("kernel_after")
    return pairs.filter("kernel_before is not null").withColumn("changed", changed)


def last_run_log(tests: DataFrame, inventory: DataFrame) -> DataFrame:
    """Key of the highest numbered run log of the first failing instance per (run, test).

    ``tests`` comes from ``run_tests``; ``inventory(key)`` lists the objects.
    """
    shape = r"(run_[^/]+)/test_([^/]+)/output/([^/]+)/run-(\d+)-output\.log$"
    parts = {n: F.regexp_extract("key", shape, i + 1) for i, n in enumerate(["run", "test", "instance_id", "n"])}
    logs = inventory.withColumns(parts).filter("n <> ''").withColumn("n", F.col("n").cast("long"))
    wanted = tests.filter("first_failed is not null").select("run", "test", F.col("first_failed").alias("instance_id"), "failed")
    found = logs.join(wanted, ["run", "test", "instance_id"]).groupBy("run", "test", "instance_id")
    return found.agg(F.max_by("key", "n").alias("key"), F.max("n").alias("run_number"), (F.max("failed") - 1).alias("more_failed"))


def failure_excerpts(logs: DataFrame) -> DataFrame:
    """First warnings and errors of each log; no row leaves its place for it."""
    others = [c for c in logs.columns if c != "content"]
    lined = logs.withColumn("_lines", text.split_lines(F.col("content")))
    lines = F.col("_lines")
    return lined.select(*others, text.warning_lines(lines).alias("warnings"), text.error_lines(lines).alias("errors"))


def excerpts_of_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``failure_excerpts`` from ``(path, block, line, value)`` as ``sources.cut`` reads it, for all ``files(path)``.

    Only lines that match are looked at further, and each task passes on no more of a file than its first few of a kind;
    no file has to fit into a row.
    """
    each = lines.select("path", "block", "line", F.posexplode(text.lines_within(F.col("value"))).alias("part", "value"))
    kinds = F.array(F.when(text.is_warning(F.col("value")), F.lit("warnings")), F.when(text.is_error(F.col("value")), F.lit("errors")))
    hits = each.withColumn("_kind", F.explode(F.array_compact(kinds)))
    order = ["block", "line", "part"]
    nth = F.row_number().over(Window.partitionBy("path", "_kind").orderBy(*order))
    first = hits.withColumn("_nth", nth).filter(F.col("_nth") <= text.EXCERPT_LINES)

    def shown(kind: str) -> Column:
        ones = F.collect_list(F.when(F.col("_kind") == kind, F.struct("_nth", text.excerpt(F.col("value")).alias("value"))))
        return F.transform(F.array_sort(ones), lambda x: x["value"]).alias(kind)

    found = first.groupBy("path").agg(shown("warnings"), shown("errors"))
    none = F.array().cast("array<string>")
    out = files.select("path").join(found, "path", "left")
    return out.select("path", F.coalesce("warnings", none).alias("warnings"), F.coalesce("errors", none).alias("errors"))


def failures_of_lines(lines: DataFrame) -> DataFrame:
    """Lines of container logs that report a failure, a row each, in the order of ``(path, block, line, part)``."""
    each = lines.select("path", "block", "line", F.posexplode(text.lines_within(F.col("value"))).alias("part", "value"))
    hits = each.filter(text.is_failure(F.col("value")))
    return hits.select("path", "block", "line", "part", text.failure_text(F.col("value")).alias("text"))


def tests_of_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, test)``: the test that the first line of a log with an input folder names, else unknown."""
    named = lines.filter(F.col("value").contains("/input/")).withColumn("test", text.test_of_log(F.col("value")))
    first = named.filter("test is not null").groupBy("path").agg(F.min_by("test", F.struct("block", "line")).alias("test"))
    return files.select("path").join(first, "path", "left").select("path", F.coalesce("test", F.lit(UNKNOWN)).alias("test"))

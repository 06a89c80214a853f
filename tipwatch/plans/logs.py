"""Registered queries: log text, log events, VM outcomes, run summaries, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch import sinks
from tipwatch.functions import report, text
from tipwatch.operators import logs, outcomes
from tipwatch.plans import fixed
from tipwatch.plans.registry import query
from tipwatch.plans.views import table, view, view_sql
from tipwatch.session import materialise, scratch_path, small_cuts
from tipwatch.sources import cut, objects


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---------------------------------------------------------------- redaction and crash markers


def _scrub_sql(source: str = "secrets", before: str | None = None) -> str:
    """The rules as a chain of CTEs; the checking engine writes groups as \\1 and has no flag for Unicode classes."""
    steps, previous = [], source
    for i, (kind, plain, keep) in enumerate(fixed.REDACTIONS):
        marker = keep + fixed.MARKER.format(kind=kind)
        hits = f"len(regexp_extract_all(text, {_quoted(plain)}))"
        earlier = "".join(f", h{j}" for j in range(i))
        steps.append(
            f"s{i} AS (SELECT doc_id{earlier}, {hits} AS h{i}, regexp_replace(text, {_quoted(plain)}, {_quoted(marker)}, 'g') AS text FROM {previous})"
        )
        previous = f"s{i}"
    return (before or view_sql("secrets")) + ",\n" + ",\n".join(steps) + "\n"


_SCRUB = _scrub_sql()
_LAST = len(fixed.REDACTIONS) - 1
_HITS_TEXT = "concat_ws(',', " + ", ".join(
    f"CASE WHEN h{i} > 0 THEN concat('{k}=', cast(h{i} as string)) END" for i, (k, _, _) in enumerate(fixed.REDACTIONS)
) + ")"


@query("scrub_text", _SCRUB + f"SELECT doc_id, md5(text) AS digest, length(text) AS chars, {_HITS_TEXT} AS hits FROM s{_LAST}")
def scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = text.scrub(view(spark, sf_dir, "secrets"))
    hits = F.array_join(F.transform(F.map_entries("redactions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return done.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"), hits.alias("hits"))


_FILE_TEXTS = view_sql("secrets") + ", files AS (SELECT doc_id % 8 AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM secrets GROUP BY 1)"


@query(
    "scrub_cut_text",
    _scrub_sql("files", _FILE_TEXTS)
    + f", l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS x FROM s{_LAST}) SELECT file, md5(x) AS digest, count(*) AS n FROM l GROUP BY ALL",
)
def scrub_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight files, each cut over many tasks, redacted line by line; keys of three lines lie across cuts."""
    done = text.scrub_lines(_cut_texts(spark, sf_dir)).selectExpr(_FILE, "explode(split(value, '\\n')) as x")
    return done.groupBy("file", F.md5("x").alias("digest")).agg(F.count("*").alias("n"))


def _write_files(rows: DataFrame, files: int, root: str) -> None:
    """Lines (file, doc_id, nth, value) as one text file for each number below ``files``, a task each."""
    dealt = rows.repartitionById(files, F.col("file").cast("int")).sortWithinPartitions("file", "doc_id", "nth")
    dealt.select("file", "value").write.partitionBy("file").text(root)


def _cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the eight files of texts."""
    root = scratch_path(spark, "texts")
    rows = view(spark, sf_dir, "secrets").select((F.col("doc_id") % 8).alias("file"), "doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "value"))
    _write_files(rows, 8, root)
    with small_cuts(spark, root, 4 << 10):
        return materialise(cut.read_lines(spark, root, "*.txt"), "lines")


@query("scrub_bytes", _SCRUB + f"SELECT doc_id, md5(text) AS digest, strlen(text) AS bytes FROM s{_LAST}")
def scrub_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "secrets").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    done = text.scrub_bytes(raw, "data")
    return done.select("doc_id", F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("bytes"))


_RULE_TOTALS = " UNION ALL ".join(
    f"SELECT '{k}' AS rule, CAST(sum(h{i}) AS BIGINT) AS hits FROM s{_LAST}" for i, (k, _, _) in enumerate(fixed.REDACTIONS)
)


@query("redaction_totals", _SCRUB + f"SELECT * FROM ({_RULE_TOTALS}) WHERE hits > 0")
def redaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.redaction_totals(text.scrub(view(spark, sf_dir, "secrets")))


_MARKER_CASES = " ".join(f"WHEN contains(text, {_quoted(m)}) THEN {_quoted(m)}" for m in fixed.PANICS)


@query("panic_marker", view_sql("consoles") + f"SELECT doc_id, CASE {_MARKER_CASES} END AS marker FROM consoles")
def panic_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the scrubbed console, as it is published."""
    scrubbed = text.scrub(view(spark, sf_dir, "consoles"))
    return scrubbed.select("doc_id", text.panic_marker(F.col("text")).alias("marker"))


_CRASH = "coalesce(regexp_matches(message, " + _quoted("|".join(fixed.CRASHES)) + "), false)"


@query("crash_match", view_sql("messages") + f"SELECT seq, run, message FROM messages WHERE {_CRASH}")
def crash_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "messages").filter(text.is_crash(F.col("message")))
    return found.select("seq", "run", "message")


CRASH_HITS = f""",
hits AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, seq) AS k FROM messages WHERE {_CRASH})
"""


@query("first_crash", view_sql("messages") + CRASH_HITS + "SELECT run, seq, left(trim(message), 300) AS message FROM hits WHERE k = 1")
def first_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first_crash(view(spark, sf_dir, "messages")).select("run", "seq", "message")


# ---------------------------------------------------------------- log events


@query("scan_log_events", view_sql("messages") + "SELECT stream, seq, message FROM messages WHERE stream LIKE 'cmd3/%' AND ts_ms >= 1705276800000")
def scan_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_events(view(spark, sf_dir, "messages"), "cmd3/", 1705276800000).select("stream", "seq", "message")


@query(
    "head_log_events",
    view_sql("messages") + "SELECT stream, seq, message FROM messages WHERE stream = 'cmd3/i-3/stdout' ORDER BY ts, seq LIMIT 5",
)
def head_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.head_log_events(view(spark, sf_dir, "messages"), "cmd3/i-3/stdout", 5).select("stream", "seq", "message")


@query(
    "recent_streams",
    view_sql("messages") + "SELECT stream, max(ts_ms) AS last_ms FROM messages GROUP BY stream ORDER BY max(ts) DESC, stream LIMIT 10",
)
def recent_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.recent_streams(view(spark, sf_dir, "messages")).select("stream", F.unix_millis("last_ts").alias("last_ms"))


_GROUPED = """, g AS (SELECT *, CASE WHEN len(string_split(stream, '/')) >= 3 THEN string_split(stream, '/')[2] ELSE string_split(stream, '/')[1] END AS instance_id,
  CASE WHEN contains(stream, '/stdout') THEN 'stdout' WHEN contains(stream, '/stderr') THEN 'stderr' END AS channel,
  concat('[', strftime(ts, '%Y-%m-%d %H:%M:%S'), '] ', coalesce(message, '')) AS line FROM messages)
"""


@query(
    "group_streams",
    view_sql("messages")
    + _GROUPED
    + """SELECT instance_id, count(*) FILTER (WHERE channel = 'stdout') AS stdout_lines, count(*) FILTER (WHERE channel = 'stderr') AS stderr_lines
       FROM g GROUP BY instance_id""",
)
def group_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.instance_counts(logs.group_streams(view(spark, sf_dir, "messages")))


@query("render_lines", view_sql("messages") + _GROUPED + "SELECT instance_id, channel, seq, line FROM g")
def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.group_streams(view(spark, sf_dir, "messages")).select("instance_id", "channel", "seq", "line")


_NOW = "timestamp '2024-01-31 00:00:00'"


@query(
    "retention_filter",
    view_sql("messages")
    + f""", p AS (SELECT concat('run', cast(c_custkey as string)) AS run, c_nationkey AS days FROM customer WHERE c_custkey % 2 = 0)
SELECT seq, run FROM messages LEFT JOIN p USING (run) WHERE ts >= {_NOW} - to_days(CAST(coalesce(days, 7) AS INTEGER))""",
)
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "messages").withColumnRenamed("run", "log_group")
    policies = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    policies = policies.select(F.expr("concat('run', cast(c_custkey as string))").alias("log_group"), F.col("c_nationkey").alias("retention_days"))
    kept = logs.retention_filter(events, policies, F.expr(_NOW))
    return kept.select("seq", F.col("log_group").alias("run"))


@query(
    "silent_gaps",
    view_sql("messages")
    + """, g AS (SELECT stream, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY stream ORDER BY ts) AS before FROM messages)
SELECT stream, before AS before_us, us AS after_us FROM g WHERE us - before > 1200000000""",
)
def silent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.silent_gaps(view(spark, sf_dir, "messages")).select("stream", "before_us", "after_us")


# ---------------------------------------------------------------- VM logs and runs

_TEST = "coalesce(nullif(regexp_extract(content, 'test_([^/\\n]+)/input/', 1), ''), 'unknown')"
_OUTCOMES = (
    view_sql("vmlog")
    + f""", o AS (SELECT run, instance_id, doc_id, CASE WHEN content IS NULL THEN NULL ELSE {_TEST} END AS test,
  CASE WHEN content IS NULL THEN NULL WHEN contains(content, 'Test execution completed: SUCCESS') THEN 'PASS' ELSE 'FAIL' END AS status FROM vmlog)
"""
)


def _log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VM logs as files, a boot console beside every fourth."""
    source = view(spark, sf_dir, "vmlog")
    name = F.concat("run", F.lit("/vms/"), "instance_id", F.when(F.col("doc_id") % 4 == 0, "-console.log").otherwise(".log"))
    return source.select(name.alias("path"), "content")


@query("scan_vm_logs", view_sql("vmlog") + "SELECT instance_id, length(content) AS chars FROM vmlog WHERE doc_id % 4 <> 0")
def scan_vm_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.vm_logs(_log_files(spark, sf_dir)).select("instance_id", F.length("content").cast("long").alias("chars"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.vm_outcomes(view(spark, sf_dir, "vmlog"))


@query("vm_outcomes", _OUTCOMES + "SELECT run, instance_id, test, status FROM o")
def vm_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@query("first_test_line", view_sql("vmlog") + f"SELECT instance_id, {_TEST} AS test FROM vmlog WHERE content IS NOT NULL")
def first_test_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(text.test_of_log(F.col("content")), F.lit("unknown"))
    return view(spark, sf_dir, "vmlog").filter("content is not null").select("instance_id", name.alias("test"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with times and expectations that follow from their logs: some expect one VM more, some do not know."""
    counted = view(spark, sf_dir, "vmlog").groupBy("run").agg(F.count("*").alias("logs"), F.min("doc_id").alias("low"))
    expected = F.when(F.col("low") % 3 == 0, F.col("logs")).when(F.col("low") % 3 == 1, F.col("logs") + 1)
    end = F.timestamp_add("SECOND", (F.col("low") * 37 + 125).cast("int"), F.expr("timestamp '2024-01-01 00:00:00'"))
    return counted.select(
        "run",
        F.expr("timestamp '2024-01-01 00:00:00'").alias("start_time"),
        end.alias("end_time"),
        F.concat(F.lit("task/"), "run").alias("task_arn"),
        expected.alias("expected"),
        F.when(F.col("low") % 2 == 0, "https://log.example/c").alias("container_failure_log_url"),
    )


_SUMMARY = (
    _OUTCOMES
    + """, c AS (SELECT run, count(*) AS actual, count(*) FILTER (WHERE status = 'PASS') AS successful,
       count(*) FILTER (WHERE status = 'FAIL') AS failed, min(doc_id) AS low FROM o GROUP BY run),
e AS (SELECT *, CASE low % 3 WHEN 0 THEN actual WHEN 1 THEN actual + 1 END AS expected, low * 37 + 125 AS seconds FROM c)
"""
)


@query(
    "run_summary",
    _SUMMARY
    + """SELECT run, '2024-01-01 00:00:00' AS start_time, seconds AS total_runtime_seconds,
       concat(cast(seconds // 60 as string), 'm ', cast(seconds % 60 as string), 's') AS total_runtime_formatted, concat('task/', run) AS task_arn,
       CASE WHEN coalesce(expected <> actual, false) OR failed > 0 THEN 'partial_failure' ELSE 'success' END AS status,
       coalesce(expected, -1) AS expected, actual, successful, failed, coalesce(expected - actual, 0) AS missing FROM e""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes.run_summary(_outcomes(spark, sf_dir), _runs(spark, sf_dir))
    shown = found.drop("end_time", "container_failure_log_url")
    return shown.withColumn("expected", F.coalesce("expected", F.lit(-1).cast("long")))


@query(
    "run_tests",
    _OUTCOMES
    + """SELECT run, test, count(*) AS vms, count(*) FILTER (WHERE status = 'FAIL') AS failed,
       min(CASE WHEN status = 'FAIL' THEN instance_id END) AS first_failed FROM o WHERE status IS NOT NULL GROUP BY run, test""",
)
def run_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.run_tests(_outcomes(spark, sf_dir))


@query(
    "failed_by_test",
    _OUTCOMES + "SELECT run, test, instance_id FROM o WHERE status = 'FAIL'",
)
def failed_by_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.failed_by_test(_outcomes(spark, sf_dir))


@query(
    "write_summary",
    _SUMMARY
    + """SELECT o.run, o.instance_id, o.test, o.status, e.actual, e.failed, count(*) OVER (PARTITION BY o.run, o.test) AS test_vms,
       count(*) FILTER (WHERE o.status = 'FAIL') OVER (PARTITION BY o.run, o.test) AS test_failed FROM o JOIN e USING (run) WHERE o.status IS NOT NULL""",
)
def write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary documents, written and read back: a row per instance with what the documents of its run and test say."""
    found = _outcomes(spark, sf_dir)
    out = scratch_path(spark, "summary")
    sinks.write_documents(outcomes.summary_documents(outcomes.run_summary(found, _runs(spark, sf_dir)), found), out)
    lines = spark.read.text(out)
    parsed = lambda shape: lines.select(F.from_json("value", "run_directory string, kind string, " + shape).alias("d")).select("d.*").withColumnRenamed("run_directory", "run")
    heads = parsed("vms struct<actual:bigint,failed:bigint>").filter("kind is null").select("run", "vms.actual", "vms.failed")
    tests = parsed("test string, vms bigint, failed bigint").filter("kind = 'test'")
    tests = tests.select("run", "test", F.col("vms").alias("test_vms"), F.col("failed").alias("test_failed"))
    each = parsed("test string, instance_id string, status string").filter("kind = 'instance'").drop("kind")
    return each.join(heads, "run").join(tests, ["run", "test"])


_LINES = "string_split(content, chr(10))"


def _excerpt_sql(pattern: str) -> str:
    hits = f"list_filter({_LINES}, lambda x: regexp_matches(x, '{pattern}') AND NOT starts_with(x, '+'))"
    cut = f"list_transform(list_slice({hits}, 1, 3), lambda x: left(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), 200))"
    return f"array_to_string({cut}, '|')"


@query(
    "failure_excerpts",
    view_sql("vmlog")
    + f"SELECT instance_id, {_excerpt_sql('(?i)warning|warn\\b')} AS warnings, {_excerpt_sql('(?i)error|failed')} AS errors FROM vmlog WHERE content IS NOT NULL",
)
def failure_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes.failure_excerpts(view(spark, sf_dir, "vmlog").filter("content is not null"))
    return found.select("instance_id", F.array_join("warnings", "|").alias("warnings"), F.array_join("errors", "|").alias("errors"))


def _log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The VM logs as lines of forty text files, one log after the other; two files more hold a blank."""
    root = scratch_path(spark, "logs")
    logs_ = view(spark, sf_dir, "vmlog").filter("content is not null")
    rows = logs_.select((F.col("doc_id") % 40).alias("file"), "doc_id", F.posexplode(F.split("content", "\n")).alias("nth", "value"))
    _write_files(rows, 40, root)
    spark.range(40, 42).select(F.col("id").alias("file"), F.lit("").alias("value")).repartition("file").write.mode("append").partitionBy("file").text(root)
    return root


def _cut_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines and files of those logs, each file cut over several tasks."""
    root = _log_folder(spark, sf_dir)
    with small_cuts(spark, root, 16 << 10):
        return materialise(cut.read_lines(spark, root, "*.txt"), "lines"), cut.read_files(spark, root, "*.txt")


_FILE = "cast(regexp_extract(path, 'file=([0-9]+)/', 1) as bigint) as file"
_FILED = (
    view_sql("vmlog")
    + """, l AS (SELECT doc_id % 40 AS file, doc_id, unnest(string_split(content, chr(10))) AS x, unnest(range(len(string_split(content, chr(10))))) AS nth FROM vmlog WHERE content IS NOT NULL),
f AS (SELECT DISTINCT file FROM l UNION ALL VALUES (40), (41))
"""
)


def _first_lines_sql(kind: str, pattern: str) -> str:
    hits = f"SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, nth) AS k FROM l WHERE regexp_matches(x, '{pattern}') AND NOT starts_with(x, '+')"
    shown = r"left(regexp_replace(x, '^\s+|\s+$', '', 'g'), 200)"
    return f"{kind} AS (SELECT file, string_agg({shown}, '|' ORDER BY k) AS {kind} FROM ({hits}) WHERE k <= 3 GROUP BY file)"


@query(
    "line_excerpts",
    _FILED
    + f", {_first_lines_sql('warnings', '(?i)warning|warn\b')}, {_first_lines_sql('errors', '(?i)error|failed')}"
    + " SELECT file, coalesce(warnings, '') AS warnings, coalesce(errors, '') AS errors FROM f LEFT JOIN warnings USING (file) LEFT JOIN errors USING (file)",
)
def line_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First warnings and errors of files whose lines many tasks read."""
    found = outcomes.excerpts_of_lines(*_cut_lines(spark, sf_dir))
    return found.selectExpr(_FILE, "array_join(warnings, '|') as warnings", "array_join(errors, '|') as errors")


@query(
    "line_tests",
    _FILED
    + f""", t AS (SELECT file, doc_id, nth, {_TEST.replace('content', 'x')} AS test FROM l WHERE contains(x, '/input/') AND contains(x, 'test_'))
SELECT file, coalesce(arg_min(test, (doc_id, nth)), 'unknown') AS test FROM f LEFT JOIN t USING (file) GROUP BY file""",
)
def line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.tests_of_lines(*_cut_lines(spark, sf_dir)).selectExpr(_FILE, "test")


@query(
    "line_failures",
    _FILED + r"SELECT file, regexp_replace(x, '^\s+|\s+$', '', 'g') AS text, count(*) AS n FROM l WHERE contains(x, 'FAILED') OR contains(x, '✗ Test result') GROUP BY ALL",
)
def line_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes.failures_of_lines(_cut_lines(spark, sf_dir)[0])
    return found.selectExpr(_FILE, "text").groupBy("file", "text").agg(F.count("*").alias("n"))


_CONTAINER = "concat('[2024-01-01 00:00:00] [CONTAINER] ', replace(content, chr(10), concat(chr(10), '[2024-01-01 00:00:00] [CONTAINER] ')), chr(10), '✗ Test result: ', lang)"


@query(
    "failure_lines",
    view_sql("vmlog")
    + f""", c AS (SELECT vmlog.doc_id, {_CONTAINER} AS content FROM vmlog JOIN documents USING (doc_id) WHERE content IS NOT NULL),
l AS (SELECT doc_id, list_filter({_LINES}, lambda x: contains(x, 'FAILED') OR contains(x, '✗ Test result')) AS lines FROM c)
SELECT doc_id, array_to_string(list_transform(lines, lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^.*?\\[CONTAINER\\] ', '')), '|') AS lines FROM l""",
)
def failure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    containers = view(spark, sf_dir, "vmlog").filter("content is not null").join(langs, "doc_id").select("doc_id", F.expr(_CONTAINER).alias("content"))
    return containers.select("doc_id", F.array_join(text.failure_lines(text.split_lines(F.col("content"))), "|").alias("lines"))


@query(
    "last_run_log",
    view_sql("objects")
    + r""", k AS (SELECT key, regexp_extract(key, '(run_[^/]+)/test_([^/]+)/output/([^/]+)/run-(\d+)-output\.log$', ['run', 'test', 'instance_id', 'n']) AS p FROM objects)
SELECT p.run AS run, p.test AS test, min(p.instance_id) AS instance_id, arg_min(key, p.instance_id) AS key FROM k WHERE p.n <> '' GROUP BY ALL""",
)
def last_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every instance that has a run log counted as failed."""
    inventory = view(spark, sf_dir, "objects").select("key")
    shape = r"(run_[^/]+)/test_([^/]+)/output/([^/]+)/run-\d+-output\.log$"
    parts = {n: F.regexp_extract("key", shape, i + 1) for i, n in enumerate(["run", "test", "instance_id"])}
    failed = inventory.withColumns(parts).filter("run <> ''").withColumn("status", F.lit("FAIL"))
    return outcomes.last_run_log(outcomes.run_tests(failed), inventory).select("run", "test", "instance_id", "key")


# ---------------------------------------------------------------- configurations and launches


@query(
    "expected_vms",
    view_sql("configs")
    + """, t AS (SELECT run, count(DISTINCT x) AS tests FROM (SELECT run, unnest(test) AS x FROM configs) GROUP BY run)
SELECT run, CAST(sum(coalesce(min_count, 1) * len(test)) AS BIGINT) AS expected, any_value(tests) AS tests FROM configs JOIN t USING (run) GROUP BY run""",
)
def expected_vms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.expected_vms(view(spark, sf_dir, "configs"))


@query(
    "expand_tests",
    view_sql("configs")
    + """, x AS (SELECT p_partkey, run, instance_type, coalesce(min_count, 1) AS copies, unnest(test) AS test FROM configs),
y AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM x)
SELECT p_partkey, run, test, CAST(copy AS BIGINT) AS copy, concat(instance_type, '-', test, '-', cast(copy as string)) AS vm_name FROM y""",
)
def expand_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes.expand_tests(view(spark, sf_dir, "configs"))
    return found.select("p_partkey", "run", "test", F.col("copy").cast("long").alias("copy"), "vm_name")


@query(
    "filter_vms_by_test",
    view_sql("configs") + "SELECT p_partkey, run FROM configs WHERE len(list_filter(test, lambda t: contains(t, 'CON'))) > 0",
)
def filter_vms_by_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.filter_vms_by_test(view(spark, sf_dir, "configs"), "CON").select("p_partkey", "run")


@query(
    "fleet_success",
    view_sql("results")
    + """SELECT run_prefix AS run, count(*) AS total, count(*) FILTER (WHERE raw_status <> 'FAILED') AS successful,
       count(*) FILTER (WHERE raw_status = 'FAILED') AS failed, bool_and(raw_status <> 'FAILED') AS success FROM results GROUP BY ALL""",
)
def fleet_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = view(spark, sf_dir, "results").selectExpr("run_prefix as run", "raw_status <> 'FAILED' as success")
    return outcomes.fleet_success(results)


@query(
    "container_failed",
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 END, 0) <> 0 OR o_custkey % 4 = 1 AS failed FROM orders",
)
def container_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "array(named_struct('name', 'runner', 'exit_code', case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 3 as int) end),"
        " named_struct('name', 'side', 'exit_code', cast(if(o_custkey % 4 = 1, 1, 0) as int))) as containers",
    )
    return tasks.select("o_orderkey", outcomes.container_failed(F.col("containers")).alias("failed"))


_RESULT_TEXT = "case when o_orderkey % 3 = 2 then case when o_orderpriority = '1-URGENT' then 'FAILED: Exit code 1' else 'SUCCESS' end end"


def _result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RESULT_TEXT).alias("content"))
    return view(spark, sf_dir, "objects").join(contents, "o_orderkey").select(F.col("key").alias("path"), "content")


_RESULT_SQL = (
    view_sql("objects")
    + f""", files AS (SELECT split_part(key, '/', 1) AS run_prefix, substr(split_part(key, '/', 2), 6) AS test, split_part(key, '/', 4) AS instance_id, o_orderkey,
       contains({_RESULT_TEXT}, 'SUCCESS') AS passed FROM objects JOIN orders USING (o_orderkey) WHERE key LIKE '%/result.txt' AND o_orderkey % 19 <> 0)
"""
)


@query("scan_result_files", _RESULT_SQL + "SELECT run_prefix, test, instance_id, passed FROM files")
def scan_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.result_files(_result_texts(spark, sf_dir)).filter("run_prefix is not null")


@query(
    "result_source_of_truth",
    view_sql("results", "objects")
    + f""", files AS (SELECT o_orderkey, contains({_RESULT_TEXT}, 'SUCCESS') AS passed FROM objects JOIN orders USING (o_orderkey)
       WHERE key LIKE '%/result.txt' AND o_orderkey % 19 <> 0)
SELECT run_prefix, test, instance_id, o_orderkey % 2 = 0 AS command_ok, coalesce(passed, false) AS success,
       coalesce(passed, false) AND o_orderkey % 2 <> 0 AS overruled FROM results LEFT JOIN files USING (o_orderkey)""",
)
def result_source_of_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    launches = view(spark, sf_dir, "results").selectExpr("run_prefix", "test", "instance_id", "o_orderkey % 2 = 0 as command_ok")
    return outcomes.result_source_of_truth(launches, objects.result_files(_result_texts(spark, sf_dir)))


_CAPTURES = [
    "l_orderkey",
    "((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(l_quantity as bigint) as attempt",
    "case when l_quantity < 25 then 'cleanup' when l_quantity < 35 then 'ssm-failure' else 'post-terminate' end as reason",
    "case when l_suppkey % 5 = 0 then '' else concat('console ', cast(l_partkey as string)) end as content",
]


@query(
    "pick_console_capture",
    f"""WITH c AS (SELECT DISTINCT {', '.join(_CAPTURES)} FROM lineitem), u AS (SELECT * FROM c WHERE content <> ''),
late AS (SELECT l_orderkey, max(attempt) AS attempt FROM u WHERE reason <> 'cleanup' GROUP BY ALL),
early AS (SELECT l_orderkey, min(attempt) AS attempt FROM u WHERE l_orderkey NOT IN (SELECT l_orderkey FROM late) GROUP BY ALL)
SELECT l_orderkey, attempt, min(reason) AS reason, min(content) AS content FROM u JOIN (SELECT * FROM late UNION ALL SELECT * FROM early) USING (l_orderkey, attempt)
GROUP BY ALL""",
)
def pick_console_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "lineitem").selectExpr(*_CAPTURES).distinct()
    return outcomes.pick_console_capture(captures, ["l_orderkey"])


# ---------------------------------------------------------------- stages

_STAGES = (
    view_sql("stages")
    + """, once AS (SELECT run, test, instance_id, run_id, max({'ord': ord, 'exit_code': exit_code, 'runtime_s': runtime_s, 'total_runs': total_runs}) AS s
         FROM stages WHERE run_id BETWEEN 1 AND total_runs GROUP BY ALL),
p AS (SELECT run, test, instance_id, run_id, s.runtime_s AS last_run, s.total_runs AS total_runs,
         CASE WHEN s.exit_code IN (0, 194) THEN s.exit_code ELSE least(s.exit_code, 100) END AS code FROM once),
q AS (SELECT *, CAST(sum(last_run) OVER w AS BIGINT) AS runtime_seconds,
         coalesce(sum(CASE WHEN code NOT IN (0, 194) THEN 1 ELSE 0 END) OVER (PARTITION BY run, test, instance_id ORDER BY run_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM p WINDOW w AS (PARTITION BY run, test, instance_id ORDER BY run_id)),
chain AS (SELECT *, CASE WHEN code = 0 THEN 'ok' WHEN code = 194 THEN 'reboot' ELSE 'failed' END AS step FROM q WHERE earlier = 0)
"""
)


@query(
    "stage_progress",
    _STAGES + "SELECT run, test, instance_id, run_id, code, last_run AS last_run_runtime_seconds, runtime_seconds, total_runs, step FROM chain",
)
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.stage_progress(view(spark, sf_dir, "stages"))


_STATS_SQL = (
    _STAGES
    + """SELECT run, test, instance_id, code AS exit_code, runtime_seconds, last_run AS last_run_runtime_seconds, code = 0 AS success, total_runs,
  CASE WHEN step = 'failed' THEN run_id - 1 ELSE -1 END AS completed_runs, CASE WHEN step = 'failed' THEN run_id ELSE -1 END AS failed_at_run,
  CASE WHEN step = 'failed' THEN concat('FAILED: Exit code ', code, ' at run ', run_id) WHEN code = 0 THEN 'SUCCESS' ELSE concat('FAILED: Exit code ', code) END AS result
  FROM chain WHERE step = 'failed' OR run_id = total_runs"""
)


@query("stage_stats", _STATS_SQL)
def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.stage_stats(outcomes.stage_progress(view(spark, sf_dir, "stages"))).fillna(-1, ["completed_runs", "failed_at_run"])


@query(
    "scan_stage_stats",
    """SELECT concat('t', cast(o_orderkey % 5 as string)) AS test, concat('i-', cast(o_orderkey as string)) AS instance_id, o_custkey AS runtime_seconds,
       o_orderkey % 3 = 0 AS success, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE CAST(o_orderkey % 7 AS INTEGER) END AS failed_at_run
       FROM orders WHERE o_orderkey % 31 <> 0
       UNION ALL SELECT concat('t', cast(o_orderkey % 5 as string)), concat('i-', cast(o_orderkey as string)), NULL, NULL, -1 FROM orders WHERE o_orderkey % 31 = 0""",
)
def scan_stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files are cut off; their fields come out null."""
    body = (
        "concat('{\"runtime_seconds\": ', cast(o_custkey as string), ', \"success\": ', cast(o_orderkey % 3 = 0 as string),"
        " case when o_orderkey % 3 = 0 then '' else concat(', \"failed_at_run\": ', cast(o_orderkey % 7 as string)) end,"
        " case when o_orderkey % 31 = 0 then '' else '}' end)"
    )
    path = "concat('run_a/test_t', cast(o_orderkey % 5 as string), '/output/i-', cast(o_orderkey as string), '/stats.json')"
    files = table(spark, sf_dir, "orders").selectExpr(f"{path} as path", f"{body} as content")
    found = objects.parse_stage_stats(files).select("test", "instance_id", "runtime_seconds", "success", "failed_at_run")
    return found.fillna(-1, ["failed_at_run"])


@query(
    "kernel_changed",
    view_sql("stages")
    + """, once AS (SELECT run, test, instance_id, run_id, max({'ord': ord, 'id': concat(release, '|', build, '|', coalesce(image_hash, ''))}) AS s FROM stages GROUP BY ALL),
p AS (SELECT run, test, instance_id, run_id, lag(s.id) OVER (PARTITION BY run, test, instance_id ORDER BY run_id) AS kernel_before, s.id AS kernel_after FROM once)
SELECT *, kernel_before <> kernel_after AS changed FROM p WHERE kernel_before IS NOT NULL""",
)
def kernel_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.kernel_changed(view(spark, sf_dir, "stages"))


@query(
    "runtime_format",
    "SELECT o_custkey, count(*) AS n, concat(cast(o_custkey // 60 as string), 'm ', cast(o_custkey % 60 as string), 's') AS runtime FROM orders GROUP BY ALL",
)
def runtime_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return seconds.select("o_custkey", "n", report.runtime_text(F.col("o_custkey") + 0.5).alias("runtime"))

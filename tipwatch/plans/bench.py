"""Registered queries: benchmark verdicts, two-kernel comparison, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch import sinks
from tipwatch.functions import report, stats, text
from tipwatch.operators import offline, ranking, rejects, verdicts
from tipwatch.plans import simpson
from tipwatch.plans.registry import query
from tipwatch.plans.views import csv_objects, kernel_objects, table, unixbench_objects, view, view_sql
from tipwatch.session import materialise, scratch_path, small_cuts
from tipwatch.sources import objects

R = 6
# both sides are moved off rounding ties, which exact decimals over small counts do hit
OFF_TIES = 1e-9


def _r(*names: str) -> list:
    return [F.round(F.col(n) + OFF_TIES, R).alias(n) for n in names]


# ---------------------------------------------------------------- statistics per metric

MOMENTS = (
    view_sql("bench")
    + """,
side_stats AS (
  SELECT test, metric, side, count(*) AS n, avg(value) AS mean, median(value) AS med,
         coalesce(stddev_samp(value), 0) AS sd, coalesce(var_samp(value), 0) AS var,
         arg_min(unit, ord) AS unit, arg_min(more_is_better, ord) AS more_is_better
  FROM bench GROUP BY ALL),
paired AS (
  SELECT b.test, b.metric, b.unit, b.more_is_better, b.n AS n_base, b.mean AS mean_base, b.med AS median_base,
         b.sd AS stddev_base, b.var AS var_base, t.n AS n_tip, t.mean AS mean_tip, t.med AS median_tip,
         t.sd AS stddev_tip, t.var AS var_tip
  FROM side_stats b JOIN side_stats t ON b.test = t.test AND b.metric = t.metric AND b.side = 'base' AND t.side = 'tip'),
ranks AS (
  SELECT test, metric, side,
         rank() OVER (PARTITION BY test, metric ORDER BY value)
         + (count(*) OVER (PARTITION BY test, metric, value) - 1) / 2.0 AS rk
  FROM bench),
rank_sums AS (SELECT test, metric, sum(rk) AS r_base FROM ranks WHERE side = 'base' GROUP BY ALL),
tested AS (
  SELECT p.*,
         CASE WHEN mean_base = 0 THEN 0 ELSE (mean_tip - mean_base) / abs(mean_base) * 100 END AS pct_change,
         (mean_base - mean_tip) / sqrt(var_base / n_base + var_tip / n_tip) AS t_statistic,
         pow(var_base / n_base + var_tip / n_tip, 2)
           / (pow(var_base / n_base, 2) / (n_base - 1) + pow(var_tip / n_tip, 2) / (n_tip - 1)) AS df,
         (mean_base - mean_tip)
           / sqrt(((n_base - 1) * var_base + (n_tip - 1) * var_tip) / (n_base + n_tip - 2)) AS cohens_d,
         least(r_base - n_base * (n_base + 1) / 2.0, n_base * n_tip - (r_base - n_base * (n_base + 1) / 2.0)) AS u_statistic
  FROM paired p JOIN rank_sums USING (test, metric)),
scored AS (
  SELECT *, (u_statistic - n_base * n_tip / 2.0) / sqrt(n_base * n_tip * (n_base + n_tip + 1) / 12.0) AS z,
"""
    + f"         {simpson.t_two_tailed('t_statistic', 'df')} AS t_pvalue, {simpson.normal_two_tailed('z')} AS u_pvalue\n"
    + """  FROM tested),
verdict AS (
  SELECT *, (t_pvalue < 0.05 OR u_pvalue < 0.05) AND abs(cohens_d) >= 0.5
            AND (CASE WHEN more_is_better THEN pct_change < 0 ELSE pct_change > 0 END) AS is_regression
  FROM scored)
"""
)


@query(
    "metric_stats",
    MOMENTS
    + """SELECT test, metric, side, n, round(mean + 1e-9, 6) AS mean, round(med + 1e-9, 6) AS median, round(sd + 1e-9, 6) AS stddev,
         round(CASE WHEN mean = 0 THEN 0 ELSE sd / abs(mean) END + 1e-9, 6) AS cv FROM side_stats""",
)
def metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts.metric_stats(view(spark, sf_dir, "bench"))
    return found.select("test", "metric", "side", "n", *_r("mean", "median", "stddev", "cv"))


@query(
    "metric_stats_split",
    MOMENTS
    + """SELECT test, metric, side, n, round(mean + 1e-9, 6) AS mean, round(med + 1e-9, 6) AS median, round(sd + 1e-9, 6) AS stddev,
         round(CASE WHEN mean = 0 THEN 0 ELSE sd / abs(mean) END + 1e-9, 6) AS cv FROM side_stats""",
)
def metric_stats_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its former name: there is one plan."""
    found = verdicts.metric_stats(view(spark, sf_dir, "bench"))
    return found.select("test", "metric", "side", "n", *_r("mean", "median", "stddev", "cv"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.compare(view(spark, sf_dir, "bench"))


@query(
    "compare_base_tip",
    MOMENTS
    + """SELECT test, metric, unit, more_is_better, n_base, n_tip, round(mean_base + 1e-9, 6) AS mean_base,
         round(mean_tip + 1e-9, 6) AS mean_tip, round(stddev_base + 1e-9, 6) AS stddev_base, round(stddev_tip + 1e-9, 6) AS stddev_tip
         FROM paired""",
)
def compare_base_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["test", "metric", "unit", "more_is_better", "n_base", "n_tip"]
    return _compared(spark, sf_dir).select(*columns, *_r("mean_base", "mean_tip", "stddev_base", "stddev_tip"))


@query("pct_change", MOMENTS + "SELECT test, metric, round(pct_change + 1e-9, 6) AS pct_change FROM tested")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("test", "metric", *_r("pct_change"))


@query(
    "welch_t",
    MOMENTS + "SELECT test, metric, round(t_statistic + 1e-9, 6) AS t_statistic, round(t_pvalue, 5) AS t_pvalue FROM scored",
)
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("test", "metric", *_r("t_statistic"), F.round("t_pvalue", 5).alias("t_pvalue"))


_U_SQL = MOMENTS + "SELECT test, metric, CAST(u_statistic AS DOUBLE) AS u_statistic, round(u_pvalue, 5) AS u_pvalue FROM scored"


@query("mann_whitney_u", _U_SQL)
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("test", "metric", "u_statistic", F.round("u_pvalue", 5).alias("u_pvalue"))


@query("mann_whitney_u_split", _U_SQL)
def mann_whitney_u_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts.compare(view(spark, sf_dir, "bench"))
    return found.select("test", "metric", "u_statistic", F.round("u_pvalue", 5).alias("u_pvalue"))


@query("cohens_d", MOMENTS + "SELECT test, metric, round(cohens_d + 1e-9, 6) AS cohens_d FROM tested")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("test", "metric", *_r("cohens_d"))


VERDICT_SQL = (
    MOMENTS
    + """SELECT test, metric, unit, more_is_better, n_base, n_tip, round(mean_base + 1e-9, 6) AS mean_base,
    round(mean_tip + 1e-9, 6) AS mean_tip, round(pct_change + 1e-9, 6) AS pct_change, round(t_statistic + 1e-9, 6) AS t_statistic,
    round(t_pvalue, 5) AS t_pvalue, CAST(u_statistic AS DOUBLE) AS u_statistic, round(u_pvalue, 5) AS u_pvalue,
    round(cohens_d + 1e-9, 6) AS cohens_d, is_regression FROM verdict"""
)


@query("regression_verdict", VERDICT_SQL)
def regression_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["test", "metric", "unit", "more_is_better", "n_base", "n_tip"]
    return _compared(spark, sf_dir).select(
        *labels,
        *_r("mean_base", "mean_tip", "pct_change", "t_statistic"),
        F.round("t_pvalue", 5).alias("t_pvalue"),
        "u_statistic",
        F.round("u_pvalue", 5).alias("u_pvalue"),
        *_r("cohens_d"),
        "is_regression",
    )


@query(
    "group_by_metric",
    view_sql("bench") + "SELECT test, metric, side, arg_min(unit, ord) AS unit, arg_min(more_is_better, ord) AS more_is_better FROM bench GROUP BY ALL",
)
def group_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.metric_labels(view(spark, sf_dir, "bench"))


@query("kernel_of_side", view_sql("bench") + "SELECT test, side, arg_min(kernel_version, ord) AS kernel FROM bench GROUP BY ALL")
def kernel_of_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.kernel_of_side(view(spark, sf_dir, "bench"))


@query(
    "average_ranks",
    MOMENTS
    + """SELECT test, metric, value, count(*) FILTER (WHERE side = 'base') AS n_base, count(*) FILTER (WHERE side = 'tip') AS n_tip, any_value(rk) AS avg_rank
         FROM (SELECT test, metric, value, side, rank() OVER (PARTITION BY test, metric ORDER BY value)
               + (count(*) OVER (PARTITION BY test, metric, value) - 1) / 2.0::DOUBLE AS rk FROM bench)
         GROUP BY test, metric, value""",
)
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.average_ranks(view(spark, sf_dir, "bench"), verdicts.GROUP)


_KERNELS = ", max(CASE WHEN side = 'base' THEN kernel_version END) AS base_kernel, max(CASE WHEN side = 'tip' THEN kernel_version END) AS tip_kernel"
_ROLLUP_SQL = (
    MOMENTS
    + f""", kernels AS (SELECT test{_KERNELS} FROM bench GROUP BY test),
rollup_t AS (SELECT test, base_kernel, tip_kernel, count(*) AS metrics_compared, count(*) FILTER (WHERE is_regression) AS regressions,
       bool_or(is_regression) AS has_regression
FROM kernels JOIN verdict USING (test) GROUP BY ALL)
"""
)


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "bench")
    return verdicts.test_rollup(verdicts.compare(rows), rows)


@query("test_rollup", _ROLLUP_SQL + "SELECT * FROM rollup_t")
def test_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir)


_PLANNED = "concat('t', cast(c_custkey % 25 as string))"


@query(
    "pipeline_rollup",
    _ROLLUP_SQL
    + f""", planned AS (SELECT {_PLANNED} AS test, bool_and(c_acctbal > -900) AS success FROM customer GROUP BY 1)
SELECT count(*) AS total_tests, count(*) FILTER (WHERE success) AS successful_tests, count(*) FILTER (WHERE NOT success) AS failed_tests,
       count(r.test) AS tests_with_benchmarks, count(*) FILTER (WHERE r.has_regression) AS tests_with_regression
FROM planned LEFT JOIN rollup_t r USING (test)""",
)
def pipeline_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = table(spark, sf_dir, "customer").groupBy(F.expr(_PLANNED).alias("test")).agg(F.expr("bool_and(c_acctbal > -900)").alias("success"))
    return verdicts.pipeline_rollup(planned.select("test"), _rollup(spark, sf_dir), planned)


@query(
    "regression_report",
    _ROLLUP_SQL
    + """SELECT v.test, k.base_kernel, k.tip_kernel, v.metric, round(pct_change, 5) AS pct_change, round(cohens_d, 5) AS cohens_d,
         round(t_pvalue, 5) AS t_pvalue, count(*) OVER (PARTITION BY v.test) AS n
         FROM verdict v JOIN kernels k USING (test) WHERE is_regression""",
)
def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written and read back into rows."""
    rows = view(spark, sf_dir, "bench")
    compared = materialise(verdicts.compare(rows))  # one row per metric, used three times
    docs = verdicts.regression_report(compared, verdicts.test_rollup(compared, rows))
    out = scratch_path(spark, "report")
    sinks.write_documents(docs, out)
    head = "test string, base_kernel string, tip_kernel string, n long"
    back = spark.read.schema(head + ", metric string, pct_change double, cohens_d double, t_pvalue double").json(out)
    rounded = [F.round(c, 5).alias(c) for c in ("pct_change", "cohens_d", "t_pvalue")]
    entries = back.filter("metric is not null").select("test", "metric", *rounded)
    return entries.join(back.filter("metric is null").select("test", "base_kernel", "tip_kernel", "n"), "test")


_PRINTED = ["mean_base", "stddev_base", "mean_tip", "stddev_tip", "pct_change", "cohens_d"]


@query(
    "format_regression",
    MOMENTS
    + f""", moved AS (SELECT * REPLACE ({", ".join(f"{c} + {OFF_TIES} AS {c}" for c in _PRINTED)}) FROM verdict WHERE is_regression)
       SELECT test, metric, printf('%s: base=%.2f±%.2f (cv: %.2f) → tip=%.2f±%.2f (cv: %.2f) %s (%+.1f%%) '
           || '[t-test p=%.4f, U-test p=%.4f, Cohen''s d=%.2f]', metric, mean_base, stddev_base, stddev_base / abs(mean_base),
           mean_tip, stddev_tip, stddev_tip / abs(mean_tip), unit, pct_change, abs(t_pvalue), abs(u_pvalue), cohens_d) AS line
         FROM moved""",
)
def format_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _compared(spark, sf_dir).filter("is_regression").withColumns({c: F.col(c) + OFF_TIES for c in _PRINTED})
    return moved.select("test", "metric", report.regression_line().alias("line"))


# ---------------------------------------------------------------- tail areas

_Z = "(l_quantity - 25) / 8e0"
_T = "abs(l_quantity - 25) / 10e0"
_DF = "(1 + l_discount * 1200)"


@query(
    "normal_cdf",
    f"SELECT l_quantity, n, round({simpson.normal_cdf(_Z)}, 6) AS p FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)",
)
def normal_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return grouped.select("l_quantity", "n", F.expr(f"round({stats.normal_cdf(_Z)}, 6) as p"))


@query(
    "t_pvalue",
    f"""SELECT l_quantity, l_discount, n, round({simpson.t_two_tailed(_T, _DF)}, 6) AS p
    FROM (SELECT l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def t_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n"))
    return grouped.select("l_quantity", "l_discount", "n", F.expr(f"round({stats.t_two_tailed(_T, _DF)}, 6) as p"))


# ---------------------------------------------------------------- files

# what the files built in ``csv_objects`` hold, said in SQL
_FILE_ROWS = """WITH f AS (SELECT *, CAST(floor(event_id / 50) AS BIGINT) AS file FROM events),
g AS (SELECT *, file % 2 = 1 AS turned,
     event_id % 17 = 0 AS short,
     CASE file % 5 WHEN 0 THEN 'base' WHEN 1 THEN 'base' WHEN 4 THEN 'none' ELSE 'tip' END AS side FROM f),
rows_ AS (SELECT concat('run_r', cast(file % 3 as string)) AS run_prefix, concat('t', cast(file % 20 as string)) AS test, side, file, event_id,
  CASE WHEN turned AND short THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS metric,
  CASE WHEN NOT turned AND short THEN NULL WHEN event_id % 13 = 0 THEN 'bad' ELSE cast(value as string) END AS value,
  CASE WHEN short THEN NULL WHEN event_type = 'view' THEN 'a, "b"' ELSE 'ops' END AS unit,
  CASE WHEN turned THEN 'true' WHEN short THEN NULL WHEN event_type = 'error' THEN 'False' ELSE 'True' END AS more_is_better,
  CASE WHEN turned THEN 'unknown' WHEN short THEN NULL ELSE concat('6.1.', cast(file % 5 as string), '.x86_64') END AS kernel_version,
  CASE WHEN short THEN NULL WHEN user_id % 2 = 1 THEN 'ARM64' ELSE 'x86_64' END AS arch,
  concat('i-', cast(file as string)) AS instance_id
  FROM g WHERE turned OR NOT short OR event_id % 11 <> 0) -- the others are blank lines
"""


@query(
    "scan_benchmark_csv",
    _FILE_ROWS
    + "SELECT run_prefix, test, side, instance_id, metric, unit, TRY_CAST(value AS DOUBLE) AS value, more_is_better, kernel_version, arch FROM rows_",
)
def scan_benchmark_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects.benchmark_rows(csv_objects(spark, sf_dir))
    columns = ["run_prefix", "test", "side", "instance_id", "metric", "unit"]
    return rows.select(*columns, F.col("value").try_cast("double").alias("value"), "more_is_better", "kernel_version", "arch")


@query(
    "clean_measurements",
    _FILE_ROWS
    + """SELECT test, side, metric, unit, TRY_CAST(value AS DOUBLE) AS value, more_is_better IS NULL AS flag_defaulted,
         lower(coalesce(more_is_better, 'true')) = 'true' AS more_is_better
         FROM rows_ WHERE metric <> '' AND TRY_CAST(value AS DOUBLE) IS NOT NULL""",
)
def clean_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts.clean_measurements(objects.benchmark_rows(csv_objects(spark, sf_dir)))
    return rows.select("test", "side", "metric", "unit", "value", "flag_defaulted", "more_is_better")


@query(
    "scan_offline_csv",
    _FILE_ROWS
    + """SELECT test, instance_id AS instance, concat(test, '_', instance_id, '_benchmark-', CASE side WHEN 'none' THEN '6.1.csv' ELSE concat(side, '-6.1.csv') END) AS source_file,
         metric, TRY_CAST(value AS DOUBLE) AS value, arch FROM rows_""",
)
def scan_offline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects.offline_rows(csv_objects(spark, sf_dir))
    return rows.select("test", "instance", "source_file", "metric", F.col("value").try_cast("double").alias("value"), "arch")


@query(
    "scan_cut_csv",
    """SELECT concat('f', cast(user_id % 3 as string)) AS file, event_id, CASE WHEN event_id % 5 = 0 THEN concat('two', chr(10), 'lines, "', event_type, '"') ELSE event_type END AS note,
    value, CASE WHEN user_id % 3 <> 1 THEN CASE WHEN event_id % 7 = 0 THEN '' ELSE 'u' END END AS unit FROM events""",
)
def scan_cut_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three headed files, each cut over many tasks, with line breaks inside quotes on either side of cuts."""
    root = scratch_path(spark, "large")
    note = "case when event_id % 5 = 0 then concat('\"two', chr(10), 'lines, \"\"', event_type, '\"\"\"') else event_type end"
    unit = "case when event_id % 7 = 0 then '' else 'u' end"
    line = f"case when user_id % 3 = 1 then concat_ws(',', event_id, {note}, value) else concat_ws(',', {unit}, value, {note}, event_id) end"
    lines = table(spark, sf_dir, "events").selectExpr("concat('f', cast(user_id % 3 as string)) as file", "event_id", f"{line} as value")
    heads = "values ('f0', -1L, 'unit,value,note,id'), ('f1', -1L, 'id,note,value'), ('f2', -1L, 'unit,value,note,id') as h(file, event_id, value)"
    whole = lines.unionByName(spark.sql(f"select * from {heads}")).repartition("file").sortWithinPartitions("file", "event_id")
    whole.select("file", "value").write.partitionBy("file").text(root)
    with small_cuts(spark, root, 16 << 10):
        rows = materialise(objects.read_headed(spark, root, ["id", "note", "value", "unit"], "*.txt"), "rows")
    file = F.regexp_extract("path", "file=(f[0-9])/", 1).alias("file")
    return rows.select(file, F.col("id").cast("long").alias("event_id"), "note", F.col("value").cast("double").alias("value"), "unit")


@query(
    "rejected_measurements",
    _FILE_ROWS
    + """, r AS (SELECT test, instance_id, CASE WHEN coalesce(metric, '') = '' THEN 'no metric' WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN 'no number' END AS reason FROM rows_)
    SELECT test, instance_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL""",
)
def rejected_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = verdicts.rejected_measurements(objects.benchmark_rows(csv_objects(spark, sf_dir)))
    return bad.groupBy("test", "instance_id", "reason").agg(F.count("*").alias("n"))


@query(
    "measurement_audit",
    _FILE_ROWS
    + """, r AS (SELECT CASE WHEN coalesce(metric, '') = '' THEN 'no metric' WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN 'no number' END AS reason FROM rows_)
    SELECT count(*) AS read, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'no metric') AS no_metric, count(*) FILTER (reason = 'no number') AS no_number,
      count(*) FILTER (reason IS NULL) AS written, count(*) FILTER (reason IS NOT NULL) AS set_aside FROM r""",
)
def measurement_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read, kept and set aside, counted while the rows were written, next to what then lies there."""
    marked = verdicts.judged_measurements(objects.benchmark_rows(csv_objects(spark, sf_dir)))
    watched, seen = rejects.counted(marked.withColumn("bad", F.col("reason").isNotNull()), ["no metric", "no number"], "measurements")
    out = scratch_path(spark, "judged")
    watched.drop("ord").write.partitionBy("bad").parquet(out)
    there = spark.read.schema("reason string, bad boolean").parquet(out)
    got = seen.get
    counts = [F.lit(got[k]).cast("long").alias(k.replace(" ", "_")) for k in ("read", "kept", "no metric", "no number")]
    return there.agg(F.count_if(~F.col("bad")).alias("written"), F.count_if("bad").alias("set_aside")).select(*counts, "written", "set_aside")


@query(
    "combine_results",
    """WITH f AS (SELECT *, CAST(floor(event_id / 50) AS BIGINT) AS file FROM events)
    SELECT concat('bench-', cast(file as string), '.csv') AS source_file, event_type AS metric, value,
           CASE WHEN file % 2 = 0 THEN 'ops' END AS unit,
           CASE WHEN file % 2 = 1 THEN concat('i-', cast(user_id as string)) END AS instance_id FROM f""",
)
def combine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("file", F.expr("cast(floor(event_id / 50) as bigint)"))
    name = F.concat(F.lit("bench-"), F.col("file").cast("string"), F.lit(".csv")).alias("source_file")
    even = events.filter("file % 2 = 0").select(name, F.col("event_type").alias("metric"), "value", F.lit("ops").alias("unit"))
    odd = events.filter("file % 2 = 1").select(
        F.concat(F.lit("i-"), F.col("user_id").cast("string")).alias("instance_id"), "value", F.col("event_type").alias("metric"), name
    )
    return offline.combine_results(even, odd).select("source_file", "metric", "value", "unit", "instance_id")


_SUITE = "WITH f AS (SELECT *, CAST(floor(event_id / 50) AS BIGINT) AS file FROM events)"
_SUITE_VIEW = [
    "concat('f', cast(cast(floor(event_id / 50) as bigint) as string)) as source_file",
    "event_id as pos",
    "case when floor(event_id / 50) % 3 = 0 then concat('Byte-UnixBench-6.0.0.', event_type) else event_type end as metric",
]


@query(
    "strip_suite_prefix",
    _SUITE
    + """SELECT concat('f', cast(file as string)) AS source_file, event_id AS pos, event_type AS metric,
         CASE WHEN file % 3 = 0 THEN 'Byte-UnixBench-6.0.0.' END AS unixbench_version FROM f""",
)
def strip_suite_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(*_SUITE_VIEW)
    return offline.strip_suite_prefix(rows).select("source_file", "pos", "metric", "unixbench_version")


@query("suite_label", "SELECT CASE WHEN count(*) > 0 THEN 'Byte-UnixBench-6.0.0.' ELSE '' END AS label FROM events WHERE floor(event_id / 50) % 3 = 0")
def suite_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.suite_label(offline.strip_suite_prefix(table(spark, sf_dir, "events").selectExpr(*_SUITE_VIEW)))


@query(
    "scan_unixbench_log",
    """SELECT doc_id, concat('byte-unixbench-6.0.0.Arithmetic_Test_(double)') AS metric, 'lps' AS unit, CAST(n_chars AS DOUBLE) AS value FROM documents
    UNION ALL SELECT doc_id, concat('byte-unixbench-6.0.0.Test_', lang), 'KBps', n_chars / 2.0 FROM documents""",
)
def scan_unixbench_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects.unixbench_rows(unixbench_objects(spark, sf_dir))
    return rows.select("doc_id", "metric", "unit", F.col("value").cast("double").alias("value"))


# ---------------------------------------------------------------- two kernels

_OFFLINE = (
    view_sql("kernels")
    + """,
names AS (SELECT DISTINCT regexp_replace(kernel_version, '\\.(x86_64|aarch64|arm64)$', '') AS k FROM kernels),
pair AS (SELECT (SELECT k FROM names ORDER BY k LIMIT 1) AS a, (SELECT k FROM names ORDER BY k LIMIT 1 OFFSET 1) AS b),
sliced AS (
  SELECT *, 'all' AS slice FROM kernels
  UNION ALL SELECT *, 'x86_64' FROM kernels WHERE arch ILIKE '%x86_64%'
  UNION ALL SELECT *, 'aarch64' FROM kernels WHERE arch ILIKE '%aarch64%' OR arch ILIKE '%arm64%'),
means AS (
  SELECT metric, slice AS arch, arg_min(unit, ord) AS unit, arg_min(more_is_better, ord) AS more_is_better, a AS kernel_a, b AS kernel_b,
         avg(CASE WHEN kernel_version LIKE a || '%' THEN value END) AS mean_a,
         avg(CASE WHEN kernel_version LIKE b || '%' THEN value END) AS mean_b
  FROM sliced, pair GROUP BY metric, slice, a, b),
result AS (
  SELECT *, mean_b - mean_a AS absolute_change, CASE WHEN mean_a > 0 THEN (mean_b - mean_a) / mean_a * 100 ELSE 0 END AS percent_change
  FROM means WHERE mean_a IS NOT NULL AND mean_b IS NOT NULL),
judged AS (SELECT *, CASE WHEN more_is_better THEN percent_change < 0 ELSE percent_change > 0 END AS is_regression FROM result)
"""
)
_OFFLINE_COLUMNS = """metric, arch, unit, more_is_better, kernel_a, kernel_b, round(mean_a + 1e-9, 4) AS mean_a, round(mean_b + 1e-9, 4) AS mean_b,
 round(absolute_change + 1e-9, 4) AS absolute_change, round(percent_change + 1e-9, 6) AS percent_change, is_regression"""


def _offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.compare_kernels(view(spark, sf_dir, "kernels"))


def _shown(result: DataFrame) -> DataFrame:
    digits = {"mean_a": 4, "mean_b": 4, "absolute_change": 4, "percent_change": 6}
    return result.withColumns({c: F.round(F.col(c) + OFF_TIES, d) for c, d in digits.items()})


@query("offline_compare", _OFFLINE + f"SELECT {_OFFLINE_COLUMNS}, 'Byte-UnixBench-6.0.0.' AS suite FROM judged")
def offline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the texts of output files, some rows of which lack the flag, to the result."""
    rows = objects.offline_rows(kernel_objects(spark, sf_dir))
    return _shown(offline.analyse(rows)).withColumn("more_is_better", F.coalesce("more_is_better", F.lit(True)))


@query("arch_slices", _OFFLINE + f"SELECT {_OFFLINE_COLUMNS} FROM judged")
def arch_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_offline(spark, sf_dir))


@query("significant_change", _OFFLINE + f"SELECT {_OFFLINE_COLUMNS} FROM judged WHERE abs(percent_change) > 1")
def significant_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(offline.significant_change(_offline(spark, sf_dir)))


@query(
    "offline_counts",
    _OFFLINE + "SELECT arch, count(*) AS total, count(*) FILTER (WHERE is_regression) AS regressions, count(*) FILTER (WHERE NOT is_regression) AS improvements FROM judged GROUP BY arch",
)
def offline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.offline_counts(_offline(spark, sf_dir))


@query(
    "sort_regressions",
    _OFFLINE + "SELECT metric, arch, round(percent_change + 1e-9, 6) AS percent_change FROM judged ORDER BY percent_change, metric, arch",
)
def sort_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.sort_regressions(_offline(spark, sf_dir)).select("metric", "arch", *_r("percent_change"))


@query("two_lowest_kernels", _OFFLINE + "SELECT a AS kernel_a, b AS kernel_b FROM pair")
def two_lowest_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.two_lowest_kernels(view(spark, sf_dir, "kernels"))


@query(
    "kernel_base",
    view_sql("kernels") + "SELECT kernel_version, regexp_replace(kernel_version, '\\.(x86_64|aarch64|arm64)$', '') AS kernel, count(*) AS n FROM kernels GROUP BY ALL",
)
def kernel_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "kernels").groupBy("kernel_version").agg(F.count("*").alias("n"))
    return counts.select("kernel_version", text.kernel_base(F.col("kernel_version")).alias("kernel"), "n")


# a name in one of seven forms, and its place among all of them: the number first, then the form as ``sort -V`` has them,
# then the text where only a zero before the number differs
_VERSION_FORMS = "case p_partkey % 7 when 0 then '~rc1' when 1 then '' when 2 then 'a' when 3 then '-1' when 4 then '.0~rc1' when 5 then '.0' else '.0-2' end"
_VERSION = f"concat('linux-6.', case when p_partkey % 2 = 0 then '0' else '' end, cast(p_size as string), '.', cast(p_partkey % 13 as string), {_VERSION_FORMS})"


@query(
    "version_sort",
    f"""WITH v AS (SELECT p_brand, {_VERSION} AS name, ((p_size * 100 + p_partkey % 13) * 10 + p_partkey % 7) * 2 + p_partkey % 2 AS place FROM part)
    SELECT p_brand, arg_min(name, place) AS first_version, arg_max(name, place) AS last_version FROM v GROUP BY ALL""",
)
def version_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last version per brand in version order."""
    names = table(spark, sf_dir, "part").select("p_brand", F.expr(_VERSION).alias("name"))
    return offline.version_range(names, ["p_brand"], "name").withColumnsRenamed({"first": "first_version", "last": "last_version"})


@query(
    "version_successors",
    f"""WITH v AS (SELECT DISTINCT p_brand, {_VERSION} AS name, ((p_size * 100 + p_partkey % 13) * 10 + p_partkey % 7) * 2 + p_partkey % 2 AS place FROM part)
    SELECT p_brand, name, coalesce(lead(name) OVER (PARTITION BY p_brand ORDER BY place), '-') AS following FROM v""",
)
def version_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of a brand with the next one in version order."""
    names = table(spark, sf_dir, "part").select("p_brand", F.expr(_VERSION).alias("name"))
    return offline.version_successors(names, ["p_brand"], "name").withColumn("following", F.coalesce("following", F.lit("-")))

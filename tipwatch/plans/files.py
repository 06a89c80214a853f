"""Registered queries for the sinks: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipwatch import sinks
from tipwatch.operators import logs, offline
from tipwatch.plans.bench import _OFFLINE
from tipwatch.plans.logs import _GROUPED
from tipwatch.plans.registry import query
from tipwatch.plans.views import csv_objects, table, view, view_sql
from tipwatch.session import materialise, scratch_path
from tipwatch.sources import groups, objects


@query(
    "write_combined",
    """SELECT concat('f', cast(cast(floor(event_id / 50) as bigint) as string)) AS source_file, event_type AS metric, value, user_id FROM events""",
)
def write_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "combined")
    rows = table(spark, sf_dir, "events").selectExpr(
        "concat('f', cast(cast(floor(event_id / 50) as bigint) as string)) as source_file", "event_type as metric", "value", "user_id"
    )
    sinks.write_combined(rows, out)
    return spark.read.csv(out, header=True, schema="source_file string, metric string, value double, user_id long")


@query(
    "write_regressions",
    _OFFLINE + "SELECT metric, arch, unit, round(mean_a + 1e-9, 4) AS first_mean, round(percent_change + 1e-9, 6) AS percent_change, is_regression FROM judged",
)
def write_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the mean columns named after the kernels, as in the file for people."""
    out = scratch_path(spark, "regressions")
    rows = view(spark, sf_dir, "kernels")
    result = offline.compare_kernels(rows)
    pair = offline.two_lowest_kernels(rows).first()  # one row of two names
    sinks.write_regressions(offline.with_kernel_columns(result, pair.kernel_a, pair.kernel_b), out)
    kept = f"metric string, arch string, unit string, more_is_better boolean, `{pair.kernel_a}_mean` double, `{pair.kernel_b}_mean` double, absolute_change double, percent_change double, is_regression boolean"
    back = spark.read.csv(out, header=True, schema=kept)
    return back.select(
        "metric",
        "arch",
        "unit",
        F.round(F.col(f"`{pair.kernel_a}_mean`") + 1e-9, 4).alias("first_mean"),
        F.round(F.col("percent_change") + 1e-9, 6).alias("percent_change"),
        "is_regression",
    )


@query(
    "publish_analysis",
    _OFFLINE + "SELECT concat('run_', arch) AS run_prefix, metric, is_regression FROM judged",
)
def publish_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slice published as a run of its own; publishing one again replaces only it."""
    out = scratch_path(spark, "analysis")
    result = offline.compare_kernels(view(spark, sf_dir, "kernels")).withColumn("run_prefix", F.concat(F.lit("run_"), "arch"))
    sinks.publish_analysis(result, out)
    sinks.publish_analysis(result.filter("arch = 'all'"), out)
    return spark.read.parquet(out).select("run_prefix", "metric", "is_regression")


@query(
    "write_instance_logs",
    view_sql("messages") + _GROUPED + "SELECT instance_id, line FROM g WHERE channel IS NOT NULL",
)
def write_instance_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "lines")
    sinks.write_instance_logs(logs.group_streams(view(spark, sf_dir, "messages")), out)
    return spark.read.parquet(f"{out}/lines").select("instance_id", "line")


@query(
    "instance_index",
    view_sql("messages") + _GROUPED + "SELECT instance_id, count(*) AS rows, count(DISTINCT channel) AS channels FROM g WHERE channel IS NOT NULL GROUP BY ALL",
)
def instance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per instance as the index has them, in files so small that many instances go over several."""
    out = scratch_path(spark, "lines")
    sinks.write_instance_logs(logs.group_streams(view(spark, sf_dir, "messages")), out, 1 << 14)
    index = spark.read.parquet(f"{out}/index").groupBy("instance_id").agg(F.sum(F.expr("last_row - first_row + 1")).alias("rows"))
    held = spark.read.parquet(f"{out}/lines").groupBy("instance_id").agg(F.count_distinct("channel").alias("channels"))
    return index.join(held, "instance_id")


@query(
    "instance_log",
    view_sql("messages")
    + _GROUPED
    + """SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY channel DESC, ts, seq) AS nth, line FROM g
    WHERE channel IS NOT NULL AND instance_id IN ('i-3', 'i-20')""",
)
def instance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instances read by the index, and one that is not there."""
    out = scratch_path(spark, "lines")
    sinks.write_instance_logs(logs.group_streams(view(spark, sf_dir, "messages")), out, 1 << 14)
    each = [sinks.read_instance_log(spark, out, i).withColumn("instance_id", F.lit(i)) for i in ("i-3", "i-20", "i-none")]
    nth = F.row_number().over(Window.partitionBy("instance_id").orderBy("place"))
    return each[0].unionByName(each[1]).unionByName(each[2]).select("instance_id", nth.cast("long").alias("nth"), "line")


@query(
    "container_log",
    view_sql("messages")
    + "SELECT concat('[', strftime(ts, '%Y-%m-%d %H:%M:%S'), '] [CONTAINER] ', coalesce(message, '')) AS line, count(*) AS times FROM messages WHERE stream LIKE '%/other' GROUP BY ALL",
)
def container_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that belong to no machine's output, as the container's log."""
    out = scratch_path(spark, "container")
    events = view(spark, sf_dir, "messages").filter(F.col("stream").endswith("/other"))
    sinks.write_container_log(logs.container_lines(events), out)
    return spark.read.text(out).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("times"))


_GROUPS = """, e AS (SELECT stream, seq, message, ts_ms, CASE user_no % 4 WHEN 0 THEN 'run_a' WHEN 1 THEN 'run_b' WHEN 2 THEN 'run_a' END AS run,
  CASE WHEN user_no % 4 = 2 THEN 'console' END AS suffix FROM (SELECT *, CAST(substr(run, 4) AS BIGINT) AS user_no FROM messages))
"""


@query(
    "scan_log_groups",
    view_sql("messages")
    + _GROUPS
    + """SELECT CASE WHEN suffix IS NULL THEN '/ec2/t/run_a' ELSE '/ec2/t/run_a/console' END AS log_group, stream, seq FROM e
    WHERE run = 'run_a' AND stream LIKE 'cmd%' AND ts_ms >= 1705276800000
    UNION ALL SELECT '/ec2/t', stream, seq FROM e WHERE run IS NULL AND stream LIKE 'cmd%' AND ts_ms >= 1705276800000""",
)
def scan_log_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of a run's logs and one that nobody wrote, from a table of five."""
    root = scratch_path(spark, "groups")
    user = F.substring("run", F.lit(4), F.length("run")).cast("long") % 4
    run, suffix = F.when(user.isin(0, 2), "run_a").when(user == 1, "run_b"), F.when(user == 2, "console")
    events = view(spark, sf_dir, "messages").withColumns({"base": F.lit("/ec2/t"), "run": run, "suffix": suffix})
    groups.write_log_events(events.select("base", "run", "suffix", "stream", "ts", "seq", "message"), root)
    other = events.limit(0).withColumn("base", F.lit("/ec2/u"))
    groups.write_log_events(other.select("base", "run", "suffix", "stream", "ts", "seq", "message"), root)
    names = [("/ec2/t", "run_a"), ("/ec2/t", "run_a", "console"), ("/ec2/t",), ("/ec2/t", "run_gone"), ("/ec2/u", "run_a")]
    return groups.read_log_groups(spark, root, names, "cmd", 1705276800000).select("log_group", "stream", "seq")


@query(
    "land_measurements",
    """SELECT concat('t', cast(cast(floor(event_id / 50) as bigint) % 20 as string)) AS test, count(*) AS n FROM events
    WHERE floor(event_id / 50) % 2 = 1 OR event_id % 17 <> 0 OR event_id % 11 <> 0 GROUP BY ALL""",
)
def land_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small CSV files landed as Parquet in two runs, one after the other and the second twice, then read from there."""
    out = scratch_path(spark, "landed")
    rows = materialise(objects.benchmark_rows(csv_objects(spark, sf_dir)).drop("run_prefix"), "parsed")  # parsed once for three landings
    second = F.pmod(F.xxhash64("test"), F.lit(2)) == 1
    for name, part in (("run_a_20240101_000000", ~second), ("run_b_20240202_000000", second), ("run_b_20240202_000000", second)):
        sinks.land_measurements(rows.filter(part).withColumn("run", F.lit(name)), out)
    return spark.read.parquet(out).groupBy("test").agg(F.count("*").alias("n"))

"""Registered queries that run as streams over the tables and are drained into Parquet."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch.operators import logs
from tipwatch.plans.jobs import INTAKE_WHERE, PLATFORMS, RUNTIME, as_events
from tipwatch.plans.logs import CRASH_HITS
from tipwatch.plans.registry import query
from tipwatch.plans.views import SPARK, VIEWS, table, view, view_sql
from tipwatch.session import folder_bytes, scratch_path
from tipwatch.streaming import intake, monitor
from tipwatch.streaming.runs import batches, drain, start_append

AFTER = "2024-01-20 00:00:00"
HOUR_MS, DAY_MS = 3600 * 1000, 24 * 3600 * 1000


def stream_view(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A derived view over its table, a file or a folder of part files, read as a stream of files."""
    source, columns = VIEWS[name]
    schema = table(spark, sf_dir, source).schema
    # as a pattern, since a stream takes no single file by its plain name; a folder matches with all its files
    place = f"{sf_dir}/{source}.parque[t]"
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(place)
    return files.selectExpr(*[c.format(**SPARK) for c in columns])


# some events have a stamp that cannot be read, some none
_STAMP = "case when definition like '%7' then '12/31/2024' when definition like '%8' then null else stamp end"
_OFFERED = (
    view_sql("job_events", "nodes")
    + f""", offered AS (SELECT node_id, {_STAMP} AS stamp FROM job_events WHERE {INTAKE_WHERE}
  AND node_id NOT IN (SELECT id FROM nodes WHERE job_id <> '' OR state <> 'available'))
"""
)


def _intake(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The intake over all job events, a few files at a time; gives the folder of its tables."""
    flat = stream_view(spark, sf_dir, "job_events", 2).withColumn("stamp", F.expr(_STAMP))
    nodes = view(spark, sf_dir, "nodes").withColumnRenamed("id", "node_id")
    out = scratch_path(spark, name)
    intake.job_intake(as_events(flat), out, f"{out}/checkpoint", RUNTIME, PLATFORMS, nodes, availableNow=True).awaitTermination()
    return out


@query("job_intake", _OFFERED + "SELECT node_id, count(*) AS claims FROM (SELECT DISTINCT node_id FROM offered WHERE stamp IS NULL OR stamp LIKE '2024-%') GROUP BY ALL")
def job_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = batches(spark, f"{_intake(spark, sf_dir, 'intake')}/taken", intake.TAKEN)
    return taken.groupBy("node_id").agg(F.count("*").alias("claims"))


@query("intake_rejects", _OFFERED + "SELECT node_id, stamp AS timestamp, 'invalid_timestamp' AS error_code FROM offered WHERE stamp LIKE '12/%'")
def intake_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, f"{_intake(spark, sf_dir, 'rejects')}/rejected", intake.REJECTED).select("node_id", "timestamp", "error_code")


@query(
    "poll_job_events",
    view_sql("job_events") + "SELECT stamp AS timestamp, node_id AS id, kind, count(*) AS times FROM job_events GROUP BY ALL",
)
def poll_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All job events out of pages, polled by a cursor; the poll is broken off once and goes on from its checkpoint.

    Events arrive by their numbers, which their stamps do not follow. A batch takes the polls of an eighth of the pages.
    """
    source, columns = VIEWS["job_events"]
    flat = table(spark, sf_dir, source).orderBy("event_id").selectExpr(*[c.format(**SPARK) for c in columns])
    pages, out = scratch_path(spark, "pages"), scratch_path(spark, "polled")
    as_events(flat).select(F.to_json(F.struct("timestamp", "node"))).write.text(pages)
    eighth = folder_bytes(spark, pages) // 8 + 1
    polled = intake.poll_job_events(spark, pages, batch_bytes=eighth).select("timestamp", "node.id", "node.kind")
    for last in (False, True):
        running = start_append(polled, f"{out}/rows", f"{out}/checkpoint", processingTime="0 seconds")
        while not last and not any(p["numInputRows"] for p in running.recentProgress) and running.isActive:
            time.sleep(0.05)
        if last:
            running.processAllAvailable()
        running.stop()
    found = spark.read.schema(polled.schema).parquet(f"{out}/rows")
    return found.groupBy("timestamp", "id", "kind").agg(F.count("*").alias("times"))


@query("tail_new_events", view_sql("messages") + f"SELECT stream, seq FROM messages WHERE ts > timestamp '{AFTER}'")
def tail_new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = intake.new_events(stream_view(spark, sf_dir, "messages"), AFTER)
    return drain(spark, events.select("stream", "seq"), "tail")


def _alerts(spark: SparkSession, sf_dir: str, limits: monitor.Limits) -> DataFrame:
    """The recorded consoles replayed on their own clock."""
    return monitor.replay(spark, stream_view(spark, sf_dir, "messages"), limits)


def _state_sql(hang_ms: int, timeout_ms: int) -> str:
    """The first ending of each run. The loop that watches a run asks for its age, then whether it stopped, then reads
    new lines for a crash and, where there are none, counts the silence since the last ones; a recording is watched
    without pause, so the earliest moment decides, and that order only among equal moments."""
    hang_us, timeout_us = hang_ms * 1000, timeout_ms * 1000
    return (
        view_sql("messages")
        + CRASH_HITS
        + f""", m AS (SELECT run, epoch_us(ts) AS us, stopped FROM messages),
w AS (SELECT max(us) AS end_us FROM m),
r AS (SELECT run, min(us) AS first_us, min(us) FILTER (stopped) AS stop_us FROM m GROUP BY run),
seen AS (SELECT run, first_us AS us FROM r UNION SELECT run, us FROM m WHERE NOT stopped),
gaps AS (SELECT run, us, coalesce(lead(us) OVER (PARTITION BY run ORDER BY us), end_us) - us AS quiet_us FROM seen, w),
h AS (SELECT run, min(us) + {hang_us} + 1 AS hang_us FROM gaps WHERE quiet_us > {hang_us} GROUP BY run),
c AS (SELECT run, epoch_us(ts) AS crash_us, message AS crash FROM hits WHERE k = 1),
ends AS (SELECT run, first_us + {timeout_us} + 1 AS at_us, 1 AS turn, 'timeout' AS status FROM r, w WHERE end_us - first_us > {timeout_us}
  UNION ALL SELECT run, stop_us, 2, 'stopped' FROM r WHERE stop_us IS NOT NULL
  UNION ALL SELECT run, crash_us, 3, 'crash' FROM c
  UNION ALL SELECT run, hang_us, 4, 'hang' FROM h),
s AS (SELECT run, coalesce(arg_min(status, (at_us, turn)), 'running') AS status, coalesce(min(at_us), any_value(end_us)) // 1000 AS at_ms, any_value(crash) AS crash
  FROM r LEFT JOIN ends USING (run) LEFT JOIN c USING (run), w GROUP BY run)
"""
    )


_QUIET = monitor.Limits(hang_ms=4 * HOUR_MS, timeout_ms=40 * DAY_MS)
_OLD = monitor.Limits(hang_ms=40 * DAY_MS, timeout_ms=29 * DAY_MS + 18 * HOUR_MS)


@query("crash_alerts", _state_sql(_QUIET.hang_ms, _QUIET.timeout_ms) + "SELECT run, concat('kernel crash detected in VM: ', left(trim(crash), 300)) AS message FROM s WHERE status = 'crash'")
def crash_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.crash_alerts(_alerts(spark, sf_dir, _QUIET)).select("run", "message")


@query("hang_alerts", _state_sql(_QUIET.hang_ms, _QUIET.timeout_ms) + "SELECT run, 'no VM console output for 14400s' AS message FROM s WHERE status = 'hang'")
def hang_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.hang_alerts(_alerts(spark, sf_dir, _QUIET)).select("run", "message")


@query("run_timeouts", _state_sql(_OLD.hang_ms, _OLD.timeout_ms) + "SELECT run FROM s WHERE status = 'timeout'")
def run_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_timeouts(_alerts(spark, sf_dir, _OLD)).select("run")


@query("run_state", _state_sql(_QUIET.hang_ms, _QUIET.timeout_ms) + "SELECT run, status FROM s")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.final_states(_alerts(spark, sf_dir, _QUIET)).select("run", "status")


_MIXED = monitor.Limits(hang_ms=60 * HOUR_MS, timeout_ms=12 * DAY_MS)


@query(
    "run_endings",
    _state_sql(_MIXED.hang_ms, _MIXED.timeout_ms)
    + """SELECT run, status, at_ms, CASE status WHEN 'crash' THEN concat('kernel crash detected in VM: ', left(trim(crash), 300))
  WHEN 'hang' THEN 'no VM console output for 216000s' WHEN 'timeout' THEN 'task wait timeout exceeded after 1036800s' ELSE '' END AS message FROM s""",
)
def run_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How and when each run ended, with limits of which every one ends some runs."""
    return _alerts(spark, sf_dir, _MIXED).select("run", "status", "at_ms", "message")


@query("stream_first_crash", view_sql("messages") + CRASH_HITS + "SELECT run, left(trim(message), 300) AS message FROM hits WHERE k = 1")
def stream_first_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest crash line per run from a recorded stream: matching lines are drained, then reduced."""
    from tipwatch.functions.text import is_crash

    hits = stream_view(spark, sf_dir, "messages").filter(is_crash(F.col("message"))).select("run", "ts", "seq", "message")
    return logs.first_crash(drain(spark, hits, "crash")).select("run", "message")

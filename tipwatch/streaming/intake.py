"""Job events as a stream: filter, claim once, hand on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tipwatch.operators.jobs import available_jobs, filter_has_definition, filter_runtime_platform
from tipwatch.schemas import JOB_EVENT
from tipwatch.sources.paged import read_pages
from tipwatch.streaming.runs import each_batch_once

TAKEN = "event_time timestamp, node_id string, parent string, platform string, definition_url string"
REJECTED = "timestamp string, node_id string, error_code string"
OFFERED = f"{TAKEN}, timestamp string, error_code string"
COLUMNS = [c.split()[0] for c in OFFERED.split(", ")]
UNREADABLE = "invalid_timestamp"


def read_job_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON event files as a stream; the checkpoint takes the place of a cursor."""
    return spark.readStream.schema(JOB_EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def poll_job_events(spark: SparkSession, path: str, limit: int = 1000, batch_bytes: int | None = None) -> DataFrame:
    """JSON event lines of a folder of pages as a stream, in the order of their arrival and ``limit`` a poll.

    A batch is one poll, or as many as ``batch_bytes`` hold, which tasks do side by side.
    """
    return read_pages(spark, path, limit, batch_bytes).select(F.from_json("value", JOB_EVENT).alias("event")).select("event.*")


def wanted_jobs(events: DataFrame, runtime: str, platforms: list[str] | None = None) -> DataFrame:
    """The events of job nodes to run, late ones too, whatever their stamps; ``event_time`` is null where the stamp is
    missing or cannot be read."""
    wanted = filter_has_definition(filter_runtime_platform(available_jobs(events, None), runtime, platforms))
    return wanted.filter("node.id <> '' and coalesce(node.data.job_id, '') = ''").select(
        F.expr("try_to_timestamp(timestamp)").alias("event_time"),
        F.col("node.id").alias("node_id"),
        F.col("node.parent").alias("parent"),
        F.col("node.data.platform").alias("platform"),
        F.col("node.artifacts")["job_definition"].alias("definition_url"),
        "timestamp",
    )


def _firsts(rows: pd.DataFrame) -> pd.DataFrame:
    """The earliest event of each node, and all that are to be rejected."""
    bad = rows["error_code"].notna()
    good = rows[~bad].sort_values(COLUMNS[:5], na_position="first").drop_duplicates("node_id")
    return pd.concat([good, rows[bad]])


def claimed(wanted: DataFrame) -> DataFrame:
    """Each node's earliest event when the node is first seen, and every event whose stamp cannot be read.

    What is known of a node is one flag in the state store, partitioned by node: a batch looks up its own nodes only,
    however many batches came before. Tasks reduce their rows to one per node before they are shuffled. An event
    without a stamp may claim its node.
    """
    error = F.when(F.col("event_time").isNull() & F.col("timestamp").isNotNull(), UNREADABLE)
    offered = wanted.withColumn("error_code", error).select(*COLUMNS)

    def condense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _firsts(batch)

    def claim(key: tuple, batches: Iterator[pd.DataFrame], taken: GroupState) -> Iterator[pd.DataFrame]:
        first = None
        for batch in batches:
            rows = _firsts(batch)
            bad = rows["error_code"].notna()
            if bad.any():
                yield rows[bad]
            first = rows[~bad] if first is None else _firsts(pd.concat([first, rows[~bad]]))
        if first is not None and len(first) and not taken.exists:
            taken.update((True,))
            yield first

    fewer = offered.mapInPandas(condense, OFFERED)
    return fewer.groupBy("node_id").applyInPandasWithState(claim, OFFERED, "taken boolean", "append", GroupStateTimeout.NoTimeout)


def job_intake(
    events: DataFrame,
    out: str,
    checkpoint: str,
    runtime: str,
    platforms: list[str] | None = None,
    nodes: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Start handing on every job node once, into ``out/taken``; bad stamps go to ``out/rejected``.

    A node is new if no earlier event claimed it, however old its event is, and if ``nodes(node_id, state, job_id)``, the
    nodes as they stand, do not show it taken or past being available; the latter is an anti-join of each batch. The
    state of claims belongs to the checkpoint, and a batch that is tried again starts from the state before it and
    replaces its own rows, so each job comes out once.
    """
    wanted = wanted_jobs(events, runtime, platforms)
    if nodes is not None:
        gone = nodes.filter("coalesce(job_id, '') <> '' or state <> 'available'").select("node_id")
        wanted = wanted.join(gone, "node_id", "left_anti")

    def split(batch: DataFrame, _: int) -> dict[str, DataFrame]:
        good = batch.filter("error_code is null").select(*COLUMNS[:5])
        return {"taken": good, "rejected": batch.filter("error_code is not null").select("timestamp", "node_id", "error_code")}

    return each_batch_once(claimed(wanted), split, out, checkpoint, **trigger)


def new_events(events: DataFrame, after: str) -> DataFrame:
    """Log events later than ``after``; what was read before is known from the source offsets, not from a clock."""
    return events.filter(F.col("ts") > F.lit(after).cast("timestamp"))

"""Log groups: events of many groups in one table, addressed by name.

A group is named ``base``, ``base/run`` or ``base/run/suffix``. The parts are partition columns, so a reader lists and
reads the folder of its group only. A group that nobody has written has no events; it is no error, since machines that
never came up leave none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch.operators.logs import log_events
from tipwatch.schemas import LOG_EVENT

PARTS = ["base", "run", "suffix"]
# What stands for a part that a name does not have; no part of a name is blank.
NONE = "-"


def group_name(base: str, run: str | None = None, suffix: str | None = None) -> tuple[str, str, str]:
    """The parts of a group's name; a part that is left out stands as ``NONE``."""
    return base, run or NONE, suffix or NONE


def write_log_events(events: DataFrame, root: str) -> None:
    """Add events ``(base, run, suffix, stream, ts, seq, message)`` to their groups; null parts are left out of names.

    Rows go to the folders of their groups in tasks that follow bytes, so a hot group is cut over many files.
    """
    named = events.withColumns({p: F.coalesce(p, F.lit(NONE)) for p in PARTS})
    named.hint("rebalance", *[F.col(p) for p in PARTS]).write.mode("append").partitionBy(*PARTS).parquet(root)


def read_log_group(
    spark: SparkSession,
    root: str,
    base: str,
    run: str | None = None,
    suffix: str | None = None,
    stream_prefix: str | None = None,
    start_ms: int | None = None,
) -> DataFrame:
    """Events of one group, by stream prefix and inclusive start; none where there is no such group."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LOG_EVENT)
    wanted = dict(zip(PARTS, group_name(base, run, suffix), strict=True))
    table = spark.read.schema(f"{LOG_EVENT}, " + ", ".join(f"{p} string" for p in PARTS)).parquet(root)
    for part, value in wanted.items():
        table = table.filter(F.col(part) == value)
    return log_events(table.drop(*PARTS), stream_prefix, start_ms)


def read_log_groups(spark: SparkSession, root: str, names: list[tuple], stream_prefix: str | None = None, start_ms: int | None = None) -> DataFrame:
    """Events of several groups with the name of theirs in ``log_group``."""
    out = None
    for name in names:
        title = "/".join(x for x in group_name(*name) if x != NONE)
        rows = read_log_group(spark, root, *name, stream_prefix=stream_prefix, start_ms=start_ms).withColumn("log_group", F.lit(title))
        out = rows if out is None else out.unionByName(rows)
    return out

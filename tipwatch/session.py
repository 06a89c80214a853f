"""Session helpers: settings, shared scratch folder, materialisation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Cluster sizing (executors, memory, shuffle partitions) stays with the submitter.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

_GIVEN: list[str] = []


def build_session(app: str = "tipwatch", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Where that is unset, a folder of this application under the warehouse, which every executor can reach too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/_scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never reused, so a retry cannot see another run's files."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _GIVEN.append(path)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once into a table in the shared folder, for plans that must see the same rows twice.

    Lost executors cost a task's rerun, not the lineage; readers prune columns and know the size. The table is the
    application's: ``clear_scratch`` removes it with the others once their readers are done.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of the files below ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


@contextmanager
def small_cuts(spark: SparkSession, root: str, least: int, cuts: int = 256) -> Iterator[None]:
    """Meanwhile tasks read files as if those below ``root`` were large: a ``cuts``-th of all their bytes at a time, though
    ``least`` bytes or more, and no more than is set. So the number of tasks does not grow with small files."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(key, str(min(most, max(least, -(-folder_bytes(spark, root) // cuts)))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what ``scratch_path`` gave out in this session. Results that still read from there are lost."""
    jvm = spark.sparkContext._jvm
    for path in _GIVEN:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _GIVEN.clear()

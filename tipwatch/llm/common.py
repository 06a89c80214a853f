"""What several of these operators share: word pattern, tables in the shared folder, batches of rows in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch.session import scratch_path

# White space between words: space and \x09-\x0D.
GAP = r"[ \x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path that all executors can reach: under ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    return scratch_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into a table of the shared folder, so that every reader sees the same rows and a lost
    executor costs the rerun of a task, not of the plan."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Texts of an Arrow batch one by one, null as empty; a batch never becomes a list of Python strings at once."""
    values = batch.column(batch.schema.get_field_index(column))
    for value in values:
        yield value.as_py() or ""

"""Starting and draining streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tipwatch.session import scratch_path


def start_append(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to Parquet. File sink and checkpoint together write each row once, also after a restart."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start(out)


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run ``stream`` over everything available, then give back what it wrote."""
    out = scratch_path(spark, name)
    query = start_append(stream, f"{out}/rows", f"{out}/checkpoint", availableNow=True)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def each_batch_once(
    stream: DataFrame, step: Callable[[DataFrame, int], dict[str, DataFrame]], out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Run ``step(batch, number)`` on every batch and write the tables it gives below ``out/<name>/batch=<number>``.

    A batch that is tried again after a failure overwrites its own folders, so its rows are there once.
    """

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read once by all of the step's tables; a lost block is read from the source again
        try:
            for name, rows in step(held, number).items():
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``each_batch_once`` wrote to ``path``, with the column ``batch``; no rows before the first batch."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def earlier_batches(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    return batches(spark, path, schema).filter(f"batch < {number}")

"""Where results go. Parquet is the copy to work from; CSV, JSON and text are for people and other services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch.session import materialise

# About how many bytes of lines a file of instance logs holds.
LOG_FILE_BYTES = 128 << 20


def write_combined(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_regressions(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").csv(path, header=True)


def publish_analysis(result: DataFrame, root: str) -> None:
    """Below ``root/run_prefix=.../``, so a run's results can be replaced or pruned alone."""
    writer = result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_prefix").parquet(root)


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON documents, one per line, from ``(keys..., part, id, document)``: the header of a group and its entries next
    to each other. Ranges include the entry, so a group of any size is cut over as many files as it needs."""
    order = [c for c in documents.columns if c != "document"]
    sorted_ = documents.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.select("document").write.mode("overwrite").text(path)


def write_instance_logs(grouped: DataFrame, path: str, file_bytes: int = LOG_FILE_BYTES) -> None:
    """Lines of all instances in ``path/lines``, each one's stdout lines by time and then its stderr lines, and in
    ``path/index`` where they are: ``(instance_id, file, first_row, last_row)``.

    Files are cut by bytes: a small instance shares one, a large one goes on over several, and their number does not
    follow the number of instances. The lines are written once before they are dealt, so that finding the cuts does not
    compute them again.
    """
    order = [F.asc("instance_id"), F.desc("channel"), F.asc("ts"), F.asc("seq")]
    lines = materialise(grouped.filter("channel is not null").select("instance_id", "channel", "ts", "seq", "line"), "instance_lines")
    total = lines.agg(F.sum(F.octet_length("line") + 16)).first()[0] or 0
    dealt = lines.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").parquet(f"{path}/lines")
    row = F.col("_metadata.row_index")
    places = lines.sparkSession.read.parquet(f"{path}/lines").groupBy("instance_id", F.col("_metadata.file_name").alias("file"))
    places.agg(F.min(row).alias("first_row"), F.max(row).alias("last_row")).write.mode("overwrite").parquet(f"{path}/index")


def read_instance_log(spark: SparkSession, path: str, instance_id: str) -> DataFrame:
    """(place, channel, line) of one instance, by the index: only its files are opened, and of them only its rows kept.
    ``place`` orders the lines; an unknown instance has none."""
    places = spark.read.parquet(f"{path}/index").filter(F.col("instance_id") == instance_id).collect()  # a row per file
    kinds = spark.read.parquet(f"{path}/lines").schema
    if not places:
        return spark.createDataFrame([], "place struct<file:string,row:bigint>, channel string, line string")
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    rows = spark.read.schema(kinds).parquet(*[f"{path}/lines/{p['file']}" for p in places])
    return rows.filter(F.col("instance_id") == instance_id).select(F.struct(name.alias("file"), row.alias("row")).alias("place"), "channel", "line")


def export_instance_log(spark: SparkSession, path: str, instance_id: str, to: str) -> None:
    """The log of one instance as a text for people, cut over files by its size, in order."""
    lines = read_instance_log(spark, path, instance_id)
    lines.repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(to)


def write_container_log(rendered: DataFrame, path: str) -> None:
    """Lines of a container in the order of their times, as a text for people."""
    rendered.repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq").select("line").write.mode("overwrite").text(path)


def land_measurements(rows: DataFrame, root: str) -> None:
    """Measurements by (run_date, run, test), the table the analyses read: they skip what they do not need.

    Landing a run again replaces its own tests only. Rows are gathered by the folders they go to, and adaptive execution
    cuts a folder of many bytes over as many tasks; ``rows`` has ``run`` as ``run_<id>_<yyyymmdd>_<hhmmss>``, or any text
    without a date.
    """
    stamp = F.regexp_extract("run", r"_(\d{8})_\d{6}$", 1)
    dated = rows.withColumn("run_date", F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyyMMdd")).cast("date").cast("string"), F.lit("unknown")))
    writer = dated.hint("rebalance", *[F.col(c) for c in ("run_date", "run", "test")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_date", "run", "test").parquet(root)

"""Files of a run, as rows of (path, content), and the tables parsed from them.

Layout: ``run_<id>_<stamp>/test_<test>/{input|output|state}/<instance>/<file>`` and ``.../shared/<folder>/``.
Benchmark files are small and many; land them once as Parquet partitioned by (run_date, test) and work from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch.schemas import MANIFEST, MEASUREMENT_COLUMNS, STAGE_STATS
from tipwatch.sources import cut
from tipwatch.sources.fields import BOUND, RECORDS, bound_header, fields_of, named_fields

def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below ``root`` whose name matches the glob, one row per file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_binaries(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(root).select("path", F.col("content"), F.col("length").alias("size"))


def split_bytes(spark: SparkSession) -> int:
    """How much of a file a task reads at most."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def read_headed(
    spark: SparkSession, root: str, columns: list[str], pattern: str = "*", chosen: Callable[[Column], Column] | None = None, whole_bytes: int | None = None
) -> DataFrame:
    """(path, pos, ``columns``, present, extras) of the headed CSV files below ``root``, as ``parse_csv`` gives them.

    Files of up to ``whole_bytes`` (what a task reads at most) are read whole, which takes no shuffle; the lines of
    larger ones are cut over as many tasks as they need (``sources.cut``). ``pos`` orders the rows of a file.
    """
    most = split_bytes(spark) if whole_bytes is None else whole_bytes
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    of_path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    wanted = F.lit(True) if chosen is None else chosen(of_path)
    whole = reader.text(root, wholetext=True).filter((size <= most) & wanted)
    small = parse_csv(whole.select(of_path.alias("path"), F.col("value").alias("content")), columns)
    place = F.struct(F.lit(0).cast("long").alias("block"), F.col("pos").cast("long").alias("line"), F.lit(0).alias("part"))
    lines = cut.numbered(reader.option("lineSep", "\n").text(root).filter((size > most) & wanted))
    return small.withColumn("pos", place).unionByName(cut.headed_rows(cut.records(lines), columns))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def layout(path: Column) -> dict[str, Column]:
    """Run, test, area, instance and file of an object key in the run layout; null where the key is outside it.

    The shape is checked by one pattern, the same for all parts, so it runs once per key; the key is then split.
    """
    inside = F.regexp_extract(path, r"(?:^|/)(run_[^/]+/test_[^/]+/[^/]+/[^/]+/[^/]+)$", 1)
    parts = F.split(inside, "/")
    names = ["run_prefix", "test", "area", "instance_id", "file"]
    made = {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}
    made["test"] = F.substring(made["test"], F.lit(len("test_") + 1), F.length(path))
    return {n: F.when(F.length(inside) > 0, c) for n, c in made.items()}


def side_of(path: Column) -> Column:
    return (
        F.when(path.contains("benchmark-base-"), "base").when(path.contains("benchmark-tip-"), "tip").otherwise("none")
    )


def parse_csv(objects: DataFrame, columns: list[str], content: str = "content") -> DataFrame:
    """Rows of headed CSV texts, bound by column name: reordered and short files are fine.

    Adds ``pos`` (row number in the file), the asked ``columns`` as strings (null where the file or row lacks them),
    ``present`` (which of the asked columns the header has) and ``extras`` (all other columns).
    """
    kept = [c for c in objects.columns if c != content]
    records = objects.withColumn("_records", F.regexp_extract_all(content, F.lit(RECORDS), F.lit(1)))
    headers = bound_header(records.withColumn("_header", fields_of(F.get("_records", F.lit(0)))), columns)
    lines = headers.select(
        *kept, *BOUND, F.posexplode(F.slice("_records", F.lit(2), F.greatest(F.size("_records") - 1, F.lit(0)))).alias("pos", "_line")
    )
    return named_fields(lines, columns).select(*kept, "pos", *columns, "present", "extras")


def benchmark_rows(objects: DataFrame) -> DataFrame:
    """Measurements (still text) of the benchmark files of a run, with test, side and arrival order.

    Takes ``(path, content)``; other files are passed over. Columns a file lacks get the documented defaults:
    value 0, more_is_better true, kernel unknown.
    """
    return _measured(parse_csv(objects.filter(_is_benchmark(F.col("path"))), MEASUREMENT_COLUMNS))


def _is_benchmark(path: Column) -> Column:
    return path.rlike(r"/test_[^/]+/output/") & path.endswith(".csv") & path.contains("benchmark-")


def _measured(rows: DataFrame) -> DataFrame:
    path = F.col("path")

    def lacking(name: str, default: str) -> Column:
        return F.when(F.array_contains("present", name), F.col(name)).otherwise(F.lit(default))

    place = layout(path)
    return rows.select(
        place["run_prefix"].alias("run_prefix"),
        place["test"].alias("test"),
        side_of(path).alias("side"),
        "metric",
        lacking("unit", "").alias("unit"),
        lacking("value", "0").alias("value"),
        lacking("more_is_better", "true").alias("more_is_better"),
        lacking("kernel_version", "unknown").alias("kernel_version"),
        F.coalesce("instance_id", place["instance_id"]).alias("instance_id"),
        "instance_type",
        "arch",
        F.struct("path", "pos").alias("ord"),
    )


def scan_benchmark_csv(spark: SparkSession, run_root: str) -> DataFrame:
    """``benchmark_rows`` of the files below ``run_root``; large files are cut over many tasks."""
    return _measured(read_headed(spark, run_root, MEASUREMENT_COLUMNS, "*benchmark-*.csv", _is_benchmark))


def offline_rows(objects: DataFrame, pattern: str = "*.csv") -> DataFrame:
    """All measurements of the output files whose name matches ``pattern``, kernel suffixes and suite names included."""
    return _sourced(parse_csv(objects.filter(_is_output(F.col("path"), pattern)), MEASUREMENT_COLUMNS))


def _is_output(path: Column, pattern: str) -> Column:
    if not pattern.endswith(".csv"):
        raise ValueError(f"file pattern {pattern!r} is not supported, only *.csv")
    like = "^" + pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$"
    return path.contains("/output/") & file_name(path).rlike(like)


def _sourced(rows: DataFrame) -> DataFrame:
    path = F.col("path")
    parts = F.split(F.regexp_extract(path, r"(run_[^/]+/.*)$", 1), "/")
    test = F.coalesce(F.replace(F.get(parts, F.lit(1)), F.lit("test_"), F.lit("")), F.lit("unknown"))
    instance = F.coalesce(F.get(parts, F.lit(3)), F.lit("unknown"))
    return rows.withColumns({"test": test, "instance": instance, "source_file": F.concat_ws("_", test, instance, file_name(path))})


def scan_offline_csv(spark: SparkSession, run_root: str, pattern: str = "*.csv") -> DataFrame:
    """``offline_rows`` of the files below ``run_root``; large files are cut over many tasks."""
    return _sourced(read_headed(spark, run_root, MEASUREMENT_COLUMNS, pattern, lambda path: _is_output(path, pattern)))


def discover_instances(inventory: DataFrame) -> DataFrame:
    """Distinct (run_prefix, test, instance_id) with an output folder, from a table of object keys."""
    inside = F.col("key").rlike(r"^run_[^/]*/test_[^/]*/output/[^/]+/.")
    parts = inventory.filter(inside).select(F.split("key", "/").alias("p"))

    def part(index: int) -> Column:
        return F.get("p", F.lit(index))

    names = parts.select(part(0).alias("run_prefix"), F.substr(part(1), F.lit(6)).alias("test"), part(3).alias("instance_id"))
    return names.distinct()


def vm_logs(objects: DataFrame) -> DataFrame:
    """(instance_id, content) of VM execution logs: ``*.log`` but not the boot consoles beside them."""
    name = file_name(F.col("path"))
    kept = objects.filter(name.endswith(".log") & ~name.endswith("-console.log"))
    return kept.withColumn("instance_id", F.regexp_replace(name, r"\.log\z", ""))


def scan_vm_logs(spark: SparkSession, root: str) -> DataFrame:
    return vm_logs(read_texts(spark, root, "*.log"))


def result_files(objects: DataFrame) -> DataFrame:
    """(run_prefix, test, instance_id, passed) from ``result.txt`` files."""
    place = layout(F.col("path"))
    results = objects.filter(file_name(F.col("path")) == "result.txt")
    keys = [place[n].alias(n) for n in ("run_prefix", "test", "instance_id")]
    return results.select(*keys, F.col("content").contains("SUCCESS").alias("passed"))


def scan_result_files(spark: SparkSession, root: str) -> DataFrame:
    return result_files(read_texts(spark, root, "result.txt"))


def parse_stage_stats(objects: DataFrame) -> DataFrame:
    place = layout(F.col("path"))
    stats = F.from_json("content", STAGE_STATS)
    return objects.filter(file_name(F.col("path")) == "stats.json").select(
        place["test"].alias("test"), place["instance_id"].alias("instance_id"), stats.alias("s")
    ).select("test", "instance_id", "s.*")


def scan_stage_stats(spark: SparkSession, root: str) -> DataFrame:
    return parse_stage_stats(read_texts(spark, root, "stats.json"))


def parse_manifest(objects: DataFrame) -> DataFrame:
    """Entries of manifest documents; an unreadable document has none."""
    doc = objects.select(F.from_json("content", MANIFEST, {"mode": "PERMISSIVE"}).alias("m"))
    entries = doc.select(F.col("m.run_prefix").alias("run_prefix"), F.posexplode("m.artifacts").alias("pos", "e"))
    return entries.select("run_prefix", "pos", "e.*")


def manifest_log_urls(entries: DataFrame) -> DataFrame:
    """(run_prefix, test, instance_id, log_url) of entries that have all of them; of repeats the last counts."""
    named = entries.filter("test <> '' and instance_id <> '' and log_url <> ''")
    return named.groupBy("run_prefix", "test", "instance_id").agg(F.max_by("log_url", "pos").alias("log_url"))


def scan_manifest(spark: SparkSession, root: str) -> DataFrame:
    return parse_manifest(read_texts(spark, root, "artifacts.json"))


def unixbench_rows(logs: DataFrame, suite: str = "byte-unixbench-6.0.0") -> DataFrame:
    """Measurements from raw suite output, one log per row in ``content``.

    Results start at the double-precision arithmetic line and end at an index table; a result line has its value
    sixth and its unit fifth from the end, after the words of the name.
    """
    others = [c for c in logs.columns if c != "content"]
    sections = F.split("content", r"(?dm)^System Benchmarks (?:Partial Index|Index Values).*$")
    started = F.transform(sections, lambda s: F.regexp_extract(s, r"(?dms)^(Arithmetic Test \(double\).*)", 1))
    result_lines = F.flatten(F.transform(started, lambda s: F.split(s, "\n")))
    rows = logs.select(*others, F.posexplode(result_lines).alias("pos", "line"))
    words = F.split(F.regexp_replace("line", r"^[ \t]+|[ \t\r]+$", ""), r"[ \t]+")
    counted = rows.select(*others, "pos", words.alias("w")).filter("size(w) >= 6")
    name = F.array_join(F.slice("w", F.lit(1), F.size("w") - 6), "_")
    return counted.select(
        *others,
        "pos",
        F.concat(F.lit(suite + "."), name).alias("metric"),
        F.element_at("w", -5).alias("unit"),
        F.element_at("w", -6).alias("value"),
        F.lit("true").alias("more_is_better"),
    )

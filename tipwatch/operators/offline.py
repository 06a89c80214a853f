"""Two-kernel comparison by sign of the change, overall and per architecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipwatch.functions.text import kernel_base, version_key
from tipwatch.operators.verdicts import parse_number

PLOT_PERCENT = 1.0


def combine_results(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns a frame lacks are null."""
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    return combined


def strip_suite_prefix(rows: DataFrame, file: str = "source_file", pos: str = "pos") -> DataFrame:
    """Where a file's first metric carries the suite name, cut it from all its metrics and keep it as the version.

    The first row per file is found by aggregation and joined back, so a huge file is not sorted in one task.
    """
    first = rows.groupBy(file).agg(F.min_by("metric", pos).alias("_sample"))
    version = F.nullif(F.regexp_extract("_sample", r"(?i)byte-unixbench-[\d.]+", 0), F.lit(""))
    labelled = rows.join(first.select(file, version.alias("unixbench_version")), file, "left")
    cut = F.trim(F.regexp_replace("metric", r"(?iU)byte-unixbench-[\d.]+\s*", ""))
    return labelled.withColumn("metric", F.when(F.col("unixbench_version").isNull(), F.col("metric")).otherwise(cut))


def suite_label(rows: DataFrame) -> DataFrame:
    """The first suite version over the whole set by (source_file, pos), else empty; one row."""
    first = F.min_by("unixbench_version", F.struct("source_file", "pos"))
    return rows.filter("unixbench_version is not null").agg(F.coalesce(first, F.lit("")).alias("label"))


def measurements(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to compare, label of the suite) from rows of output files as ``sources.objects.offline_rows`` gives them.

    Suite names are cut from the metrics; values and flags are read, a missing or blank flag stays null (it counts as
    true); rows without a metric or a number are left out; ``ord`` is the place in the files.
    """
    labelled = strip_suite_prefix(rows)
    flag = F.nullif(F.lower(F.trim("more_is_better")), F.lit(""))
    read = labelled.withColumns(
        {"value": parse_number(F.col("value")), "more_is_better": flag == "true", "ord": F.struct("source_file", "pos")}
    )
    return read.filter((F.col("metric") != "") & F.col("value").isNotNull()), suite_label(labelled)


def analyse(rows: DataFrame, kernels: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Rows of output files to the comparison of their kernels, with the suite's label as a column."""
    measured, label = measurements(rows)
    return compare_kernels(measured, kernels, strict).withColumn("suite", label.select("label").scalar())


def two_lowest_kernels(rows: DataFrame) -> DataFrame:
    """One row (kernel_a, kernel_b): the first two kernels in text order, architecture suffix aside."""
    versions = rows.select("kernel_version").distinct()
    names = versions.select(kernel_base(F.col("kernel_version")).alias("kernel")).filter("kernel is not null")
    lowest = names.distinct().orderBy("kernel").limit(2)
    return lowest.agg(F.min("kernel").alias("kernel_a"), F.when(F.count("*") == 2, F.max("kernel")).alias("kernel_b"))


def arch_slice(arch: Column) -> Column:
    lowered = F.lower(arch)
    return F.when(lowered.contains("x86_64"), "x86_64").when(lowered.contains("aarch64") | lowered.contains("arm64"), "aarch64")


def compare_kernels(rows: DataFrame, kernels: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Change from kernel a to kernel b per metric, for ``arch`` all, x86_64 and aarch64.

    Rows: ``metric, unit, value, more_is_better, kernel_version, arch, ord``. One pass over them sums by the labels as
    they are; names, slices and the pair are worked out on the few sums. ``kernels(kernel_a, kernel_b)`` overrides the
    pair taken from the data. With fewer than two kernels there is nothing to compare: no rows, or an error with
    ``strict``.
    """
    number = F.when(~F.isnan("value"), F.col("value"))
    sums = rows.groupBy("metric", "kernel_version", "arch", "unit", "more_is_better").agg(
        F.sum(number).alias("total"), F.count(number).alias("n"), F.min("ord").alias("ord")
    )
    pair = kernels if kernels is not None else two_lowest_kernels(rows)
    if strict:
        lacking = F.raise_error(F.lit("need at least two kernel versions to compare"))
        pair = pair.withColumn("kernel_b", F.when(F.col("kernel_b").isNull(), lacking).otherwise(F.col("kernel_b")))
    a, b = pair.select("kernel_a").scalar(), pair.select("kernel_b").scalar()
    slices = F.explode(F.array_compact(F.array(F.lit("all"), arch_slice(F.col("arch"))))).alias("arch")
    named = sums.select(
        "metric",
        "total",
        "n",
        F.struct("ord", "unit", "more_is_better").alias("labels"),
        kernel_base(F.col("kernel_version")).alias("kernel"),
        a.alias("kernel_a"),
        b.alias("kernel_b"),
        slices,
    )

    def mean(side: str) -> Column:
        mine = F.col("kernel") == F.col(side)
        n = F.sum(F.when(mine, F.col("n")))
        return F.sum(F.when(mine, F.col("total"))) / F.when(n > 0, n)

    means = named.groupBy("metric", "arch", "kernel_a", "kernel_b").agg(
        mean("kernel_a").alias("mean_a"), mean("kernel_b").alias("mean_b"), F.min("labels").alias("first")
    )
    change = F.col("mean_b") - F.col("mean_a")
    percent = F.when(F.col("mean_a") > 0, change / F.col("mean_a") * 100.0).otherwise(0.0)
    # a null flag counts as true
    worse = F.when(F.coalesce("more_is_better", F.lit(True)), F.col("percent_change") < 0).otherwise(F.col("percent_change") > 0)
    both = means.filter("mean_a is not null and mean_b is not null").select(
        "metric",
        "arch",
        "first.unit",
        "first.more_is_better",
        "kernel_a",
        "kernel_b",
        "mean_a",
        "mean_b",
        change.alias("absolute_change"),
        percent.alias("percent_change"),
    )
    return both.withColumn("is_regression", worse)


def with_kernel_columns(result: DataFrame, kernel_a: str, kernel_b: str) -> DataFrame:
    """The same table with the mean columns named after the kernels, for files read by people."""
    renamed = result.withColumnsRenamed({"mean_a": f"{kernel_a}_mean", "mean_b": f"{kernel_b}_mean"})
    return renamed.drop("kernel_a", "kernel_b")


def significant_change(result: DataFrame, percent: float = PLOT_PERCENT) -> DataFrame:
    return result.filter(F.abs("percent_change") > percent)


def offline_counts(result: DataFrame) -> DataFrame:
    """Per slice: metrics, regressions and improvements (every metric that is no regression)."""
    worse = F.count_if("is_regression")
    return result.groupBy("arch").agg(
        F.count("*").alias("total"), worse.alias("regressions"), (F.count("*") - worse).alias("improvements")
    )


def sort_regressions(result: DataFrame) -> DataFrame:
    return result.orderBy("percent_change", "metric", "arch")


def version_range(names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """First and last name per group in version order: the usual base and tip of a set of kernels."""
    key = version_key(F.col(name))
    return names.groupBy(*keys).agg(F.min_by(name, key).alias("first"), F.max_by(name, key).alias("last"))


def version_sort(names: DataFrame, name: str) -> DataFrame:
    return names.orderBy(version_key(F.col(name)))


def version_successors(names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Each distinct name of a group with the one that follows in version order, null after the last."""
    each = names.select(*keys, name).distinct()
    return each.withColumn("following", F.lead(name).over(Window.partitionBy(*keys).orderBy(version_key(F.col(name)))))

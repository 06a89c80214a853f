"""A/B benchmark verdicts: base against tip per (test, metric).

Measurements in: ``test, metric, unit, value (double), more_is_better (boolean), kernel_version, side, ord`` where
``side`` is base, tip or none, and ``ord`` is any orderable column giving the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipwatch.functions import stats
from tipwatch.operators.chunks import documents
from tipwatch.operators.ranking import sample_statistics

GROUP = ["test", "metric"]
# Python's float() allows single underscores between digits and no type suffix; Spark's cast is the reverse.
_UNDERSCORES = r"(?<=[0-9])_(?=[0-9])"
_SUFFIXED = r"[dDfF]\s*$"
_NON_FINITE = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def parse_number(raw: Column) -> Column:
    plain = F.regexp_replace(raw, _UNDERSCORES, "")
    suffixed = raw.rlike(_SUFFIXED) & ~raw.rlike(_NON_FINITE)
    return F.when(~suffixed, F.trim(plain).try_cast("double"))


def judged_measurements(rows: DataFrame) -> DataFrame:
    """All rows with their number read and ``reason``, why a row cannot be used: it has no metric, or no number for a value;
    null for the others. A null flag counts as true and is marked."""
    reason = F.when(F.coalesce("metric", F.lit("")) == "", "no metric").when(F.col("value").isNull(), "no number")
    return (
        rows.withColumns({"raw_value": F.col("value"), "value": parse_number(F.col("value"))})
        .withColumn("reason", reason)
        .withColumn("flag_defaulted", F.col("more_is_better").isNull())
        .withColumn("more_is_better", F.lower(F.coalesce("more_is_better", F.lit("true"))) == "true")
    )


def clean_measurements(rows: DataFrame) -> DataFrame:
    """Drop rows without a metric or a parsable value; a null flag counts as true and is marked."""
    return judged_measurements(rows).filter("reason is null").drop("reason", "raw_value")


def rejected_measurements(rows: DataFrame) -> DataFrame:
    """The rows that ``clean_measurements`` drops, with the value as it was read and the reason."""
    bad = judged_measurements(rows).filter("reason is not null")
    return bad.withColumn("value", F.col("raw_value")).drop("raw_value", "flag_defaulted")


def metric_labels(measures: DataFrame) -> DataFrame:
    """First-seen unit and direction per (test, side, metric).

    The first step meets only equal labels, so it shrinks map-side to a handful of rows per task.
    """
    combos = measures.groupBy(*GROUP, "side", "unit", "more_is_better").agg(F.min("ord").alias("ord"))
    first = F.min(F.struct("ord", "unit", "more_is_better"))
    return combos.groupBy(*GROUP, "side").agg(first.alias("f")).select(*GROUP, "side", "f.unit", "f.more_is_better")


def kernel_of_side(rows: DataFrame) -> DataFrame:
    """Kernel of the first row per (test, side), over all rows including unusable ones; ``unknown`` if it has none."""
    combos = rows.filter(F.col("side").isin("base", "tip")).groupBy("test", "side", "kernel_version").agg(F.min("ord").alias("ord"))
    first = F.min_by("kernel_version", "ord")
    return combos.groupBy("test", "side").agg(F.coalesce(first, F.lit("unknown")).alias("kernel"))


def _described(side: str) -> list[str]:
    """Count, mean, median, deviation and coefficient of variation of one side, from its statistics."""
    sd = f"sqrt(var_{side})"
    return [
        f"cast(n_{side} as bigint) as n_{side}",
        f"mean_{side}",
        f"median_{side}",
        f"{sd} as stddev_{side}",
        f"if(mean_{side} <> 0, {sd} / abs(mean_{side}), 0D) as cv_{side}",
    ]


def metric_stats(measures: DataFrame) -> DataFrame:
    """n, mean, exact median, stddev (n-1; 0 for one value) and cv per (test, side, metric)."""
    both = sample_statistics(measures, GROUP).selectExpr(*GROUP, *_described("base"), *_described("tip"))
    names = ["n", "mean", "median", "stddev", "cv"]
    rows = ", ".join(f"'{s}', " + ", ".join(f"{c}_{s}" for c in names) for s in ("base", "tip"))
    return both.selectExpr(*GROUP, f"stack(2, {rows}) as (side, {', '.join(names)})").filter("n > 0")


def compare(measures: DataFrame, p_limit: float = stats.P_VALUE_LIMIT, effect_limit: float = stats.EFFECT_LIMIT) -> DataFrame:
    """One row per (test, metric) measured on both sides, with tests, effect size and verdict."""
    paired = sample_statistics(measures, GROUP).filter("n_base > 0 and n_tip > 0")
    labels = metric_labels(measures.filter("side = 'base'")).drop("side")
    base, tip = (stats.Sample(f"mean_{s}", f"var_{s}", f"n_{s}") for s in ("base", "tip"))
    t, df = stats.welch_t(base, tip)
    u, z = stats.mann_whitney("u_base", "n_base", "n_tip")
    tested = paired.selectExpr("*", f"{t} as t_statistic", f"{df} as df", f"{u} as u_statistic", f"{z} as z")
    scored = tested.selectExpr(
        *GROUP,
        *_described("base"),
        *_described("tip"),
        f"{stats.pct_change('mean_base', 'mean_tip')} as pct_change",
        "t_statistic",
        f"{stats.welch_p('t_statistic', 'df')} as t_pvalue",
        "u_statistic",
        f"{stats.mann_whitney_p('z')} as u_pvalue",
        f"{stats.cohens_d(base, tip)} as cohens_d",
    )
    verdict = stats.is_regression("t_pvalue", "u_pvalue", "cohens_d", "pct_change", "more_is_better", p_limit, effect_limit)
    measured = [c for c in scored.columns if c not in GROUP]
    return scored.join(labels, GROUP).selectExpr(*GROUP, "unit", "more_is_better", *measured, f"{verdict} as is_regression")


def test_rollup(comparisons: DataFrame, rows: DataFrame) -> DataFrame:
    """Per test with rows on both sides: metrics compared, regressions, kernels. Tests lacking a side are dropped."""
    kernels = kernel_of_side(rows)
    sides = kernels.groupBy("test").agg(
        F.max(F.when(F.col("side") == "base", F.col("kernel"))).alias("base_kernel"),
        F.max(F.when(F.col("side") == "tip", F.col("kernel"))).alias("tip_kernel"),
    )
    both = sides.filter("base_kernel is not null and tip_kernel is not null")
    counts = comparisons.groupBy("test").agg(
        F.count("*").alias("metrics_compared"), F.count_if("is_regression").alias("regressions")
    )
    return both.join(counts, "test", "left").select(
        "test",
        "base_kernel",
        "tip_kernel",
        F.coalesce("metrics_compared", F.lit(0)).alias("metrics_compared"),
        F.coalesce("regressions", F.lit(0)).alias("regressions"),
        (F.coalesce("regressions", F.lit(0)) > 0).alias("has_regression"),
    )


def pipeline_rollup(tests: DataFrame, rollup: DataFrame, vm_success: DataFrame | None = None) -> DataFrame:
    """One summary row for a run: ``tests(test)`` are the planned tests, ``vm_success(test, success)`` is optional."""
    plan = tests.distinct().join(rollup.select("test", "has_regression"), "test", "left")
    if vm_success is not None:
        plan = plan.join(vm_success, "test", "full")
    else:
        plan = plan.withColumn("success", F.lit(None).cast("boolean"))
    planned = tests.distinct().select("test", F.lit(True).alias("planned"))
    plan = plan.join(planned, "test", "left")
    return plan.agg(
        F.count_if("planned").alias("total_tests"),
        F.count_if("success").alias("successful_tests"),
        F.count_if(~F.col("success")).alias("failed_tests"),
        F.count_if(F.col("has_regression").isNotNull()).alias("tests_with_benchmarks"),
        F.count_if("has_regression").alias("tests_with_regression"),
    )


def pipeline_names(rollup: DataFrame, vm_success: DataFrame | None = None) -> DataFrame:
    """The names behind the counts, one row each: ``kind`` is regression or failed."""
    names = rollup.filter("has_regression").select(F.lit("regression").alias("kind"), "test")
    if vm_success is None:
        return names
    return names.unionByName(vm_success.filter(~F.col("success")).select(F.lit("failed").alias("kind"), "test"))


def regression_report(comparisons: DataFrame, rollup: DataFrame) -> DataFrame:
    """JSON documents ``(test, part, id, document)``: a header per test with a regression, and one for each of them."""
    hits = comparisons.filter("is_regression")
    heads = rollup.filter("has_regression").select(
        "test", F.struct("test", "base_kernel", "tip_kernel", F.col("regressions").cast("long").alias("n")).alias("body")
    )
    entries = hits.select("test", F.col("metric").alias("id"), F.struct("test", "metric", "pct_change", "cohens_d", "t_pvalue").alias("body"))
    return documents(heads, entries, ["test"])

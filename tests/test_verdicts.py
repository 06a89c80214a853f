import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tipwatch.functions import stats
from tipwatch.operators import ranking, verdicts

SCHEMA = "test string, metric string, unit string, value double, more_is_better boolean, kernel_version string, side string, ord long"


def measures(spark, groups):
    """groups: {metric: (base values, tip values, more_is_better)}"""
    rows = []
    for metric, (base, tip, more) in groups.items():
        for side, values in (("base", base), ("tip", tip)):
            rows += [("t", metric, "lps", float(v), more, "k" + side, side, len(rows) + i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def by_metric(df):
    return {r["metric"]: r for r in df.collect()}


def pairwise_u(base, tip):
    wins = sum((b > t) + 0.5 * (b == t) for b in base for t in tip)
    return min(wins, len(base) * len(tip) - wins)


CASES = {
    "single": ([5], [1, 2, 3], True),
    "apart": ([10, 11, 12], [1, 2, 3], True),
    "apart_less": ([10, 11, 12], [1, 2, 3], False),
    "zero_base": ([-1, 1], [100, 101], False),
    "nan": ([10, 11, math.nan], [1, 2, 3], True),
    "ties": ([1, 2], [1, 2], True),
    "constant": ([0.1] * 3, [0.2] * 3, True),
    "base_only": ([1, 2, 3], [], True),
}


@pytest.fixture(scope="module")
def compared(spark):
    return by_metric(verdicts.compare(measures(spark, CASES)))


def test_one_value_has_no_test(compared):
    row = compared["single"]
    assert (row.t_pvalue, row.u_pvalue, row.cohens_d, row.stddev_base, row.cv_base) == (1, 1, 0, 0, 0)
    assert not row.is_regression


def test_separated_samples(compared):
    row = compared["apart"]
    assert row.u_statistic == 0
    assert row.u_pvalue == pytest.approx(0.0495, abs=1e-4)
    assert row.pct_change == pytest.approx(-900 / 11)
    assert row.is_regression
    assert not compared["apart_less"].is_regression


def test_zero_base_mean_is_never_a_regression(compared):
    assert compared["zero_base"].pct_change == 0
    assert not compared["zero_base"].is_regression


def test_nan_is_not_a_regression(compared):
    assert compared["nan"].t_pvalue == 1
    assert not compared["nan"].is_regression


def test_equal_samples(compared):
    row = compared["ties"]
    assert (row.t_statistic, row.t_pvalue, row.cohens_d, row.u_statistic) == (0, pytest.approx(1), 0, 2)


def test_constant_samples_have_no_spread(compared):
    row = compared["constant"]
    assert (row.stddev_base, row.t_pvalue, row.cohens_d) == (0, 1, 0)
    assert row.mean_base == 0.1


def test_metric_on_one_side_is_dropped(compared):
    assert "base_only" not in compared


def test_published_examples(spark):
    """Eleven values a side around the published means and deviations."""

    def sample(mean, sd):
        raw = [i - 5.0 for i in range(11)]
        scale = sd / math.sqrt(sum(x * x for x in raw) / 10)
        return [mean + x * scale for x in raw]

    groups = {
        "Process_Creation": (sample(57012.12, 658.82), sample(41959.92, 306.71), True),
        "Execl_Throughput": (sample(22944.75, 155.73), sample(21684.21, 154.45), True),
    }
    found = by_metric(verdicts.compare(measures(spark, groups)))
    first, second = found["Process_Creation"], found["Execl_Throughput"]
    assert round(first.cohens_d, 2) == 29.29 and round(first.pct_change, 1) == -26.4
    assert round(second.cohens_d, 2) == 8.13 and round(second.pct_change, 1) == -5.5
    assert all(round(r.t_pvalue, 4) == 0 and round(r.u_pvalue, 4) == 0.0001 for r in (first, second))
    assert first.is_regression and second.is_regression


def test_mid_ranks(spark):
    rows = ranking.average_ranks(measures(spark, {"m": ([1, 1], [2, 2], True)}), verdicts.GROUP).collect()
    assert {r.value: r.avg_rank for r in rows} == {1.0: 1.5, 2.0: 3.5}


def test_split_plan_agrees_on_a_hot_group(spark):
    """One group with most rows, near-unique values: cut over several tasks, same numbers as by hand."""
    rng = random.Random(3)
    base = [rng.gauss(100, 10) for _ in range(3000)]
    tip = [round(rng.gauss(99, 12), 1) for _ in range(2500)]
    df = measures(spark, {"hot": (base, tip, True), "cold": ([1, 2], [3, 4], True)})
    row = by_metric(verdicts.compare(df))["hot"]
    assert row.u_statistic == pairwise_u(base, tip)
    ordered = sorted(base)
    assert row.median_base == (ordered[1499] + ordered[1500]) / 2
    mean = sum(base) / 3000
    assert row.mean_base == pytest.approx(mean)
    assert row.stddev_base == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in base) / 2999))


values = st.lists(st.integers(-20, 20).map(lambda x: x / 4), min_size=2, max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(base=values, tip=values, seed=st.integers(0, 99))
def test_swap_and_order(spark, base, tip, seed):
    shuffled = random.Random(seed).sample(base, len(base))
    groups = {"a": (base, tip, True), "swapped": (tip, base, True), "shuffled": (shuffled, tip, True)}
    found = by_metric(verdicts.compare(measures(spark, groups)))
    a, b, c = found["a"], found["swapped"], found["shuffled"]
    assert a.u_statistic == pairwise_u(base, tip) == b.u_statistic
    assert a.t_statistic == pytest.approx(-b.t_statistic) and a.cohens_d == pytest.approx(-b.cohens_d)
    assert a.t_pvalue == pytest.approx(b.t_pvalue) and a.u_pvalue == pytest.approx(b.u_pvalue)
    assert c.asDict() | {"metric": "a"} == pytest.approx(a.asDict())


def test_tail_areas(spark):
    cases = [(1.0, 1.0, 0.5), (3.0, 1.0, 1 - 2 * math.atan(3) / math.pi), (2.0, 2.0, 1 - 2 / math.sqrt(6)), (0.001, 60.0, 0.9992054330)]
    cases += [(1.984, 100.5, math.erfc(1.984 / math.sqrt(2))), (5.0, 0.0, 1.0), (math.nan, 9.0, 1.0)]
    # heavier tails than df = 1: by the trapezoid rule on the tail, with x = t exp(s)
    for t, degrees in ((2.0, 0.5), (0.3, 0.7), (10.0, 0.25)):
        scale = math.gamma((degrees + 1) / 2) / math.gamma(degrees / 2) / math.sqrt(degrees * math.pi)
        steps = [t * math.exp(i / 1000) for i in range(int(40 / degrees) * 1000)]
        cases.append((t, degrees, 2 * scale * (sum(x * (1 + x * x / degrees) ** (-(degrees + 1) / 2) for x in steps) - t * (1 + t * t / degrees) ** (-(degrees + 1) / 2) / 2) / 1000))
    df = spark.createDataFrame(cases, "t double, df double, p double")
    for row in df.withColumn("got", F.expr(stats.t_two_tailed("t", "df"))).collect():
        assert row.got == pytest.approx(row.p, rel=1e-9 if not 0 < row.df < 1 else 1e-4)
    zs = [(z / 4,) for z in range(-40, 41)]
    for row in spark.createDataFrame(zs, "z double").withColumn("got", F.expr(stats.normal_cdf("z"))).collect():
        assert row.got == pytest.approx(0.5 * math.erfc(-row.z / math.sqrt(2)), rel=1e-10)


def test_number_parsing(spark):
    raw = ["1", " 2.5 ", "1_000", "1.5d", "bad", "", "nan", "inf", "1e3", None, "1__0"]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", verdicts.parse_number(F.col("raw")).alias("v"))
    got = {r.raw: r.v for r in rows.collect()}
    assert (got["1"], got[" 2.5 "], got["1_000"], got["1e3"], got["inf"]) == (1, 2.5, 1000, 1000, math.inf)
    assert math.isnan(got["nan"])
    assert all(got[r] is None for r in ("1.5d", "bad", "", None, "1__0"))


def test_rollups(spark):
    df = measures(spark, CASES)
    compared = verdicts.compare(df)
    rollup = verdicts.test_rollup(compared, df)
    assert [tuple(r) for r in rollup.collect()] == [("t", "kbase", "ktip", 7, 1, True)]
    tests = spark.createDataFrame([("t",), ("other",)], "test string")
    plain = verdicts.pipeline_rollup(tests, rollup).first()
    assert (plain.total_tests, plain.successful_tests, plain.failed_tests, plain.tests_with_regression) == (2, 0, 0, 1)
    success = spark.createDataFrame([("t", True), ("other", False)], "test string, success boolean")
    assert verdicts.pipeline_rollup(tests, rollup, success).first().failed_tests == 1
    names = {tuple(r) for r in verdicts.pipeline_names(rollup, success).collect()}
    assert names == {("regression", "t"), ("failed", "other")}


def test_report_has_a_header_and_an_entry_each(spark):
    groups = {f"m{i}": ([10, 11, 12], [1, 2, 3], True) for i in range(40)}
    df = measures(spark, groups)
    compared = verdicts.compare(df)
    docs = [json.loads(d.document) for d in verdicts.regression_report(compared, verdicts.test_rollup(compared, df)).collect()]
    assert [d for d in docs if "metric" not in d] == [{"test": "t", "base_kernel": "kbase", "tip_kernel": "ktip", "n": 40}]
    assert sorted(d["metric"] for d in docs if "metric" in d) == sorted(groups)


def test_a_hot_metric_is_cut_over_tasks(spark):
    """One metric holds nine tenths of the rows; its values still meet only as subtotals."""
    values = spark.range(40000).selectExpr(
        "'t' as test", "if(id % 10 = 0, concat('m', id % 70), 'hot') as metric", "'lps' as unit", "cast(id % 9973 as double) as value",
        "true as more_is_better", "'k' as kernel_version", "if(id % 3 = 0, 'tip', 'base') as side", "id as ord",
    )
    row = by_metric(verdicts.compare(values))["hot"]
    rows = values.filter("metric = 'hot'").toPandas()
    base, tip = rows.value[rows.side == "base"], rows.value[rows.side == "tip"]
    assert (row.n_base, row.n_tip) == (len(base), len(tip))
    assert row.median_base == base.median() and row.median_tip == tip.median()
    ranks = rows.value.rank()
    u = ranks[rows.side == "base"].sum() - len(base) * (len(base) + 1) / 2
    assert row.u_statistic == min(u, len(base) * len(tip) - u)
    plan = verdicts.compare(values)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window " in line]
    assert windows and all("cut" in line for line in windows)

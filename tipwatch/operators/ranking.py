"""Two-sample value frequencies with running counts, safe for groups of any size.

Everything the verdicts need (mean, variance, exact median, U) follows from one table with a row per distinct value
and, on each row, the counts per side below it and the group's totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipwatch.session import materialise

_SIDES = ("base", "tip")


def _each(*templates: str) -> list[str]:
    """The expressions for both sides, ``{s}`` standing for the side."""
    return [t.format(s=s) for t in templates for s in _SIDES]


def value_frequencies(measures: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, value) with the number of base and tip measurements; combines map-side."""
    counts = _each("count_if(side = '{s}') as n_{s}")
    return measures.filter("side in ('base', 'tip')").groupBy(*keys, "value").agg(*map(F.expr, counts))


def ranked_frequencies(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``below_*`` (measurements with a smaller value), ``total_*`` and ``mean_*`` per side.

    Values are cut into ranges, so that a hot group is spread over many tasks; only per-range subtotals meet per group.
    """
    ranked = _ranked(value_frequencies(measures, keys), keys)
    means = _each("if(total_{s} > 0, weighted_{s} / total_{s}, null) as mean_{s}")
    return ranked.selectExpr(*keys, "value", *_each("n_{s}", "below_{s}", "total_{s}"), *means)


# a side without this value must not turn inf or NaN into a NaN total for itself
_WEIGHTED = "sum(if(n_{s} > 0, n_{s} * value, null))"


def _before(group: str, order: str) -> str:
    return f"(partition by {group} order by {order} rows between unbounded preceding and 1 preceding)"


def _ranked(freq: DataFrame, keys: list[str]) -> DataFrame:
    # Range partitions cut hot groups at value boundaries. Their ids are used by two branches, so fix them first.
    ranged = materialise(freq.repartitionByRange(*keys, "value").withColumn("cut", F.spark_partition_id()))
    subtotals = ranged.groupBy(*keys, "cut").agg(*map(F.expr, _each("sum(n_{s}) as cut_n_{s}", f"{_WEIGHTED} as cut_w_{{s}}")))
    group = ", ".join(keys)
    offsets = subtotals.selectExpr(
        *keys,
        "cut",
        *_each(
            f"coalesce(sum(cut_n_{{s}}) over {_before(group, 'cut')}, 0) as offset_{{s}}",
            f"sum(cut_n_{{s}}) over (partition by {group}) as total_{{s}}",
            f"sum(cut_w_{{s}}) over (partition by {group}) as weighted_{{s}}",
        ),
    )
    inside = _before(f"{group}, cut", "value")
    below = _each(f"offset_{{s}} + coalesce(sum(n_{{s}}) over {inside}, 0) as below_{{s}}")
    return ranged.join(offsets, [*keys, "cut"]).selectExpr("*", *below)


def average_ranks(measures: DataFrame, keys: list[str]) -> DataFrame:
    """1-based mid-rank of every distinct value over the pooled sides."""
    ranked = ranked_frequencies(measures, keys)
    rank = "cast(below_base + below_tip + (n_base + n_tip + 1) / 2 as double) as avg_rank"
    return ranked.selectExpr(*keys, "value", "n_base", "n_tip", rank)


def sample_statistics(measures: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: n, mean, variance (n-1), exact median per side, and base's U."""
    ranked = ranked_frequencies(measures, keys)
    at = "max(if(below_{{s}} <= {0} and {0} < below_{{s}} + n_{{s}}, value, null))"
    aggregates = _each(
        "cast(first(total_{s}) as double) as n_{s}",
        "first(mean_{s}) as plain_mean_{s}",
        "sum(if(n_{s} > 0, n_{s} * pow(value - mean_{s}, 2), null)) as squares_{s}",
        "count_if(n_{s} > 0) as distinct_{s}",
        "max(if(n_{s} > 0, value, null)) as top_{s}",
        at.format("floor((total_{s} - 1) / 2)") + " as lower_{s}",
        at.format("floor(total_{s} / 2)") + " as upper_{s}",
    )
    aggregates.append("sum(n_base * (below_tip + n_tip * 0.5D)) as u_base")
    columns = _each(
        "n_{s}",
        # no rounding noise for a constant sample
        "if(distinct_{s} = 1, top_{s}, plain_mean_{s}) as mean_{s}",
        "if(n_{s} < 2 or distinct_{s} = 1, 0D, squares_{s} / (n_{s} - 1)) as var_{s}",
        "(lower_{s} + upper_{s}) / 2 as median_{s}",
    )
    return ranked.groupBy(*keys).agg(*map(F.expr, aggregates)).selectExpr(*keys, *columns, "u_base")

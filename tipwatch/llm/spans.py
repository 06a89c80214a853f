"""Spans of pattern matches as DataFrame columns: code points, end exclusive, no Python on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<struct<start:int,end:int,kind:string,text:string>>"


def matches(text: Column, pattern: str, kind: str, value: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, kind, text of group ``value``).

    Splitting by the pattern gives what lies between the matches, so lengths add up to places. The pattern never
    matches nothing.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if not value else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(state: Column, step: Column) -> Column:
        low = state["at"] + step["g"]
        span = F.struct(low.alias("start"), (low + step["m"]).alias("end"))
        return F.struct((low + step["m"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    places = F.aggregate(steps, start, add, lambda s: s["out"])
    return F.zip_with(
        places, part, lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind"), t.alias("text"))
    )


def where(gate: Column, spans: Column) -> Column:
    """``spans`` where the cheap ``gate`` holds, else none."""
    return F.when(gate, spans).otherwise(F.array().cast(EMPTY))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then by the order of ``kinds``, comma-joined."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("d"))
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["d"], s["a"], s["c"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def near(left: DataFrame, right: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Pairs of spans (start, end) and (r_start, r_end, ...) of the same text of which the left one begins no further
    than ``reach`` before the right one's begin or after its end: an interval join on bins of ``reach`` code points, so a
    text with very many spans is spread over many tasks."""
    bins = F.sequence(F.floor(F.col("r_start") / reach) - 1, F.floor(F.col("r_end") / reach) + 1)
    spread = right.withColumn("_bin", F.explode(bins))
    held = left.withColumn("_bin", F.floor(F.col("start") / reach))
    named = spread.select(*[F.col(k).alias(f"_{k}") for k in keys], "_bin", *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = (held["_bin"] == named["_bin"]) & (F.col("start") >= F.col("r_start") - reach) & (F.col("start") <= F.col("r_end") + reach)
    for s in same:
        on = on & s
    return held.join(named, on).drop("_bin", *[f"_{k}" for k in keys])

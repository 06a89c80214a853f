"""Bad records set aside and counted, not lost.

Operators that read outside texts mark every row with a ``reason``, null for good ones. ``counted`` counts good and bad
rows by reason as they stream by, in the same pass that writes or reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tipwatch.schemas import MANIFEST, STAGE_STATS
from tipwatch.sources.objects import file_name, layout

# Marks a text that is no JSON of the wanted shape.
_BROKEN = "_broken"


def counted(marked: DataFrame, reasons: list[str], name: str = "records") -> tuple[DataFrame, Observation]:
    """``marked`` as it is, and an observation with ``read``, ``kept`` and a count per reason once an action has run."""
    seen = Observation(name)
    each = [F.count_if(F.col("reason") == r).alias(r) for r in reasons]
    return marked.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col("reason").isNull()).alias("kept"), *each), seen


def _parsed(content: Column, schema: str) -> Column:
    return F.from_json(content, f"{schema}, {_BROKEN} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})


def _reason(parsed: Column, content: Column) -> Column:
    unreadable = parsed.isNull() | parsed[_BROKEN].isNotNull()
    return F.when(content.isNull() | (F.trim(content) == ""), "empty").when(unreadable, "unreadable")


def judged_stage_stats(objects: DataFrame) -> DataFrame:
    """A row per stage file ``(path, content)`` with its fields, ``reason`` and, for bad ones, the text itself."""
    place, stats = layout(F.col("path")), _parsed(F.col("content"), STAGE_STATS)
    files = objects.filter(file_name(F.col("path")) == "stats.json").withColumn("_s", stats)
    outside = F.when(place["test"].isNull(), "outside the layout")
    reason = F.coalesce(_reason(F.col("_s"), F.col("content")), outside).alias("reason")
    fields = [F.col(f"_s.{c.split()[0]}") for c in STAGE_STATS.split(", ")]
    rows = files.select("path", place["test"].alias("test"), place["instance_id"].alias("instance_id"), *fields, reason, "content")
    return rows.withColumn("content", F.when(F.col("reason").isNotNull(), F.col("content")))


def judged_manifests(objects: DataFrame) -> DataFrame:
    """A row per entry of the manifests ``(content)``, and one for each document that has none or cannot be read."""
    docs = objects.select("content", _parsed(F.col("content"), MANIFEST).alias("_m"))
    broken = _reason(F.col("_m"), F.col("content"))
    empty = F.when(F.coalesce(F.size("_m.artifacts"), F.lit(0)) <= 0, "no entries")
    docs = docs.withColumn("_reason", F.coalesce(broken, empty))
    good = F.when(F.col("_reason").isNull(), F.col("_m.artifacts"))
    rows = docs.select("content", "_reason", F.col("_m.run_prefix").alias("run_prefix"), F.posexplode_outer(good).alias("pos", "e"))
    lacking = F.when(F.col("e").isNotNull() & ((F.coalesce("e.test", F.lit("")) == "") | (F.coalesce("e.instance_id", F.lit("")) == "")), "no test or instance")
    reason = F.coalesce("_reason", lacking).alias("reason")
    return rows.select("run_prefix", "pos", "e.*", reason, F.when(reason.isNotNull(), F.col("content")).alias("content"))


def judged_keys(inventory: DataFrame) -> DataFrame:
    """Object keys ``(key)`` with run, test and instance; keys that are not in an output folder carry the reason."""
    place = layout(F.col("key"))
    names = [place[n].alias(n) for n in ("run_prefix", "test", "instance_id")]
    reason = F.when(place["test"].isNull(), "outside the layout").when(place["area"] != "output", "no output").alias("reason")
    return inventory.select("key", *names, reason)

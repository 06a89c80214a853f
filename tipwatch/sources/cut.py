"""Text files cut over many tasks: lines in their order, and headed CSV records with line breaks inside quotes.

A task reads a range of bytes of a file. Lines carry where their range begins and a number that grows within it, which
together give their order. Whether a line begins inside quotes depends on all quotes before it: every range counts its
own, the counts of the ranges of a file are added up (a row per range), and the lines of a range go on from there. Only
files in which some line has an odd number of quotes take part in that; in all others a line is a record as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tipwatch.sources.fields import RECORDS, bound_header, fields_of, named_fields

BLOCK = ["path", "block"]
UNIT = ["path", "block", "line"]


def _earlier(*order: str) -> WindowSpec:
    """What comes before in the order of the last of the columns, within the others."""
    return Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)


def numbered(texts: DataFrame) -> DataFrame:
    """(path, block, line, value) of what ``spark.read.text`` reads, right from the scan."""
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return texts.select(*where, F.monotonically_increasing_id().alias("line"), "value")


def read_lines(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Lines of the files below ``root`` whose name matches the glob; a line ends at a line feed only."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n")
    return numbered(reader.text(root))


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size) of the same files, empty ones too; their contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(root).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"))


def units(lines: DataFrame) -> DataFrame:
    """(path, block, line, value): lines, or as many of them as lie between a quote and its end, as one text.

    A quote that is never closed makes the rest of its file one unit.
    """
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    lines = lines.withColumn("_odd", odd)
    counts = lines.groupBy(*BLOCK).agg(F.sum("_odd").alias("_odd"))
    before = F.coalesce(F.sum("_odd").over(_earlier(*BLOCK)), F.lit(0))
    # one row per range
    blocks = counts.withColumn("_before", before).withColumn("_quoted", F.max("_odd").over(Window.partitionBy("path")))
    quoted = blocks.filter("_quoted > 0").select(*BLOCK, "_before")
    files = quoted.select("path").distinct()
    plain = lines.join(files, "path", "left_anti").select(*UNIT, "value")

    seen = F.coalesce(F.sum("_odd").over(_earlier(*UNIT)), F.lit(0))
    state = lines.join(quoted, BLOCK).withColumn("_begins", (F.col("_before") + seen) % 2 == 0)
    state = state.withColumn("_closed", (F.col("_before") + seen + F.col("_odd")) % 2 == 0)
    return plain.unionByName(_gathered(state))


def _gathered(state: DataFrame) -> DataFrame:
    """(path, block, line, value) from lines that know whether a unit begins with them (``_begins``) and whether the next
    line begins one (``_closed``). A line alone stays where it is; the others meet by the first line of their unit."""
    begun = F.last(F.when(F.col("_begins"), F.col("line")), ignorenulls=True).over(Window.partitionBy(*BLOCK).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    state = state.withColumn("_first", begun)
    alone = state.filter("_begins and _closed").select(*UNIT, "value")
    parts = state.filter("not (_begins and _closed)")
    # lines at the head of a range that belong to the last unit begun in an earlier one
    last = state.groupBy(*BLOCK).agg(F.max(F.when(F.col("_begins"), F.col("line"))).alias("_last"))
    carried = F.last(F.when(F.col("_last").isNotNull(), F.struct("block", "_last")), ignorenulls=True)
    owners = last.select(*BLOCK, carried.over(_earlier(*BLOCK)).alias("_owner"))
    parts = parts.join(owners, BLOCK)
    home = F.when(F.col("_first").isNotNull(), F.struct("block", F.col("_first").alias("_last"))).otherwise(F.col("_owner"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n")
    joined = parts.withColumn("_home", home).groupBy("path", "_home").agg(text.alias("value"))
    return alone.unionByName(joined.select("path", F.col("_home.block").alias("block"), F.col("_home._last").alias("line"), "value"))


def stretches(lines: DataFrame, effects: list[tuple[Column, Column]]) -> DataFrame:
    """(path, block, line, value): lines, or as many of them as belong together, as one text.

    Each of ``effects`` is a pair of conditions on ``value``: a line that opens a stretch, and one that closes it; all
    others leave it open or closed as it is. A line opens only if a later one of its file closes, so a stretch without an
    end holds nothing together. Every range finds its own last opening or closing line, the ranges of a file pass that
    on (a row per range), and the lines of a range go on from there. Files without an opening line take no part in that.
    """
    marks = [f"_effect{i}" for i in range(len(effects))]
    for m, (opens, closes) in zip(marks, effects, strict=True):
        lines = lines.withColumns({f"_o{m}": opens, f"_c{m}": closes})
    place = F.struct("block", "line")
    ends = lines.groupBy("path").agg(*[F.max(F.when(F.col(f"_c{m}"), place)).alias(f"_end{m}") for m in marks], *[F.bool_or(f"_o{m}").alias(f"_any{m}") for m in marks])
    files = ends.filter(" or ".join(f"_any{m}" for m in marks)).drop(*[f"_any{m}" for m in marks])  # a row per file
    plain = lines.join(files, "path", "left_anti").select(*UNIT, "value")
    effect = lambda m: F.when(F.col(f"_o{m}") & (place < F.col(f"_end{m}")), 1).when(F.col(f"_c{m}"), 0)
    state = lines.join(files, "path").withColumns({m: effect(m) for m in marks}).select(*UNIT, "value", *marks)
    known = state.groupBy(*BLOCK).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col("line"))).alias(m) for m in marks])
    carried = [F.coalesce(F.last(m, ignorenulls=True).over(_earlier(*BLOCK)), F.lit(0)).alias(f"_carried{m}") for m in marks]
    state = state.join(known.select(*BLOCK, *carried), BLOCK)
    begins, closed = F.lit(True), F.lit(True)
    for m in marks:
        before = F.coalesce(F.last(m, ignorenulls=True).over(_earlier(*UNIT)), F.col(f"_carried{m}"))
        begins, closed = begins & (before == 0), closed & (F.coalesce(m, before) == 0)
    return plain.unionByName(_gathered(state.withColumns({"_begins": begins, "_closed": closed})))


def records(lines: DataFrame) -> DataFrame:
    """(path, pos, record) of CSV lines; blank lines are none. ``pos`` (block, line, part) orders the records of a file."""
    many = F.col("value").contains('"') | F.col("value").contains("\r")
    each = F.when(many, F.regexp_extract_all("value", F.lit(RECORDS), F.lit(1))).otherwise(F.array("value"))
    out = units(lines).select("path", "block", "line", F.posexplode(each).alias("part", "record"))
    return out.filter("record <> ''").select("path", F.struct("block", "line", "part").alias("pos"), "record")


def headed_rows(found: DataFrame, columns: list[str]) -> DataFrame:
    """The records of ``records`` by the names of the first one of their file, as ``objects.parse_csv`` gives them."""
    headers = found.groupBy("path").agg(F.min("pos").alias("_top"), fields_of(F.min_by("record", "pos")).alias("_header"))
    lines = found.join(bound_header(headers, columns), "path").filter(F.col("pos") > F.col("_top")).withColumnRenamed("record", "_line")
    return named_fields(lines, columns).select("path", "pos", *columns, "present", "extras")

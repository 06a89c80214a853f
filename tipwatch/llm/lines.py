"""Line dedup by content-defined chunks of lines.

A rolling hash runs over the hashes of every ``WINDOW`` consecutive lines. Of every two neighbouring windows the one of the
lower hash is a boundary, so the same lines choose the same boundaries wherever they stand, and no three lines are
without one. The lines under a boundary are a chunk. Chunks that occur again anywhere are held against the first place of
their hash (smallest key, then place) and grow line by line to both sides as long as that one earlier place has the same
lines. What has grown together against one place is a run; runs of two or more lines that are not blank are compared byte
by byte with their earlier place and taken out.

A line is taken out by one run only: of runs that overlap, the later one counts from where the earlier one ends, and only
if two of its lines are left, so runs that stand in different texts do not add up to one that stands in none. A run of
two lines between differing neighbours is missed where the neighbours choose other boundaries; longer ones are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Lines under the rolling hash, lines on either side of a chunk that it may grow over at once (a run has a boundary at
# least every three lines), and lines of a run that must not be blank.
WINDOW, AROUND, FULL = 2, 4, 2
COUNTS = ["n_chunks", "n_lines", "n_removed_chunks", "n_removed_lines"]


def _identity(key: Column, text: Column) -> Column:
    """What names a document, in the order in which earlier ones stay: null keys last, texts of one key apart."""
    return F.struct(key.isNull().alias("no"), key.alias("key"), F.xxhash64(text).alias("text"))


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_hashes``, a hash per line, ``_rolled``, one per window, and ``_starts``, the first lines of chunks."""
    hashes = F.transform(F.split(F.col(text), "\n"), lambda x: F.xxhash64(x))
    hash_at = lambda i: F.get(F.col("_hashes"), i)
    last = F.size("_hashes") - WINDOW
    windows = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rolled = F.transform(windows, lambda i: F.xxhash64(*[hash_at(i + k) for k in range(WINDOW)]))
    at = lambda i: F.get(F.col("_rolled"), i)

    def boundary(value: Column, i: Column) -> Column:
        # of two equal neighbours both
        return (F.size("_rolled") == 1) | F.coalesce(value <= at(i + 1), F.lit(False)) | F.coalesce((i > 0) & (value <= at(i - 1)), F.lit(False))

    places = F.transform(F.col("_rolled"), lambda value, i: F.when(boundary(value, i), i))
    out = docs.withColumn("_hashes", F.coalesce(hashes, F.array().cast("array<bigint>"))).withColumn("_rolled", rolled)
    return out.withColumn("_starts", F.array_compact(places))


def _common(left: Column, right: Column) -> Column:
    """How many elements two arrays begin with alike."""
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def _matches(base: DataFrame) -> DataFrame:
    """(_doc, lo, hi, _from, shift): lines of a document that grew from a repeated chunk, and by how much their place
    differs from the first place of that chunk, in document ``_from``."""
    place = lambda i: F.greatest(i - AROUND, F.lit(0))
    chunk = F.transform(
        "_starts",
        lambda i: F.struct(
            F.get(F.col("_rolled"), i).alias("hash"),
            i.alias("place"),
            F.reverse(F.slice("_hashes", place(i) + 1, i - place(i))).alias("before"),
            F.slice("_hashes", i + 1 + WINDOW, AROUND).alias("after"),
        ),
    )
    # the inner form would add a filter on the size of the array, which the optimizer moves below the steps that make it
    # and so unfolds each step into every one that uses it
    each = chunked(base, "_text").select("_doc", F.explode_outer(chunk).alias("_c")).select("_doc", "_c.*").filter("place is not null")
    often = each.groupBy("hash").agg(F.count("*").alias("_times")).filter("_times > 1").select("hash")
    again = written(each.join(often, "hash", "left_semi"), "chunks")
    first = again.groupBy("hash").agg(F.min(F.struct("_doc", "place", "before", "after")).alias("_first"))
    pairs = again.join(first, "hash").filter(F.struct("_doc", "place") > F.struct("_first._doc", "_first.place"))
    shift = F.col("place") - F.col("_first.place")
    left, right = _common(F.col("before"), F.col("_first.before")), _common(F.col("after"), F.col("_first.after"))
    # within one text the earlier place must stay whole
    own = F.col("_doc") == F.col("_first._doc")
    room = F.when(own, shift - WINDOW).otherwise(F.lit(2 * AROUND))
    left = F.least(left, room)
    right = F.least(right, room - left)
    grown = pairs.filter(room >= 0).select("_doc", (F.col("place") - left).alias("lo"), (F.col("place") + WINDOW - 1 + right).alias("hi"), F.col("_first._doc").alias("_from"), shift.alias("shift"))
    # what overlaps or touches against one earlier place is one run
    line = Window.partitionBy("_doc", "_from", "shift").orderBy("lo", "hi")
    ended = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("lo") > ended + 1, 1).otherwise(0)
    run = F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))
    runs = grown.withColumn("_new", begins).withColumn("_run", run)
    return runs.groupBy("_doc", "_from", "shift", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``_doc`` (see ``_identity``) and ``_gone``, the sorted numbers of its lines to take out, for documents with any.

    Only hashes are counted over all chunks, with a combine on the map side; texts are read again for the runs found and
    for their earlier places, each once however many runs point there.
    """
    base = docs.select(_identity(F.col(key), F.col(text)).alias("_doc"), F.col(text).alias("_text"))
    runs = _matches(base)
    before = F.max("hi").over(Window.partitionBy("_doc").orderBy("lo", F.desc("hi"), "_from").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("lo", F.greatest("lo", F.coalesce(before + 1, F.lit(0)))).filter(F.col("hi") - F.col("lo") + 1 >= FULL)
    runs = written(runs.select("_doc", "lo", "hi", "_from", (F.col("lo") - F.col("shift")).alias("flo"), (F.col("hi") - F.col("shift")).alias("fhi")), "runs")
    asked = runs.select("_doc", "lo", "hi").union(runs.select("_from", "flo", "fhi")).distinct()
    asked = asked.groupBy("_doc").agg(F.collect_list(F.struct("lo", "hi")).alias("_asked"))
    # texts are dealt by document at every size, so that a small run tells what a large one costs
    lines = base.join(asked.hint("merge"), "_doc").select("_doc", "_asked", F.split("_text", "\n").alias("_lines"))
    own = F.transform("_asked", lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"), F.slice("_lines", a["lo"] + 1, a["hi"] - a["lo"] + 1).alias("lines")))
    parts = lines.select("_doc", F.explode_outer(own).alias("_a")).select("_doc", "_a.*").filter("lo is not null")
    full = F.size(F.filter("lines", lambda x: x.rlike(r"\S"))) >= FULL
    # rows of one key and text are one document
    parts = written(parts.filter(full).select("_doc", "lo", "hi", F.array_join("lines", "\n").alias("part")).dropDuplicates(["_doc", "lo", "hi"]), "parts")
    there = parts.select(F.col("_doc").alias("_from"), F.col("lo").alias("flo"), F.col("hi").alias("fhi"), F.col("part").alias("_other"))
    equal = runs.join(parts, ["_doc", "lo", "hi"]).join(there, ["_from", "flo", "fhi"]).filter(F.col("part") == F.col("_other"))
    numbers = F.flatten(F.collect_list(F.sequence("lo", "hi")))
    return equal.groupBy("_doc").agg(F.sort_array(F.array_distinct(numbers)).alias("_gone"))


def run_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` less its repeated runs of lines, and n_chunks, n_lines, n_removed_chunks (both lines of which
    went) and n_removed_lines.

    Texts without repeats stay as they are, null included (no chunks, no lines); an empty text is one empty line. Rows of
    one key and text are one document and do not take lines from each other. Columns named as the counts are replaced.
    """
    gone = repeated_lines(docs, text, key).withColumnRenamed("_doc", "_gdoc")
    out = docs.drop(*COUNTS).withColumn("_doc", _identity(F.col(key), F.col(text)))
    out = out.join(gone.hint("merge"), F.col("_doc") == F.col("_gdoc"), "left").drop("_gdoc", "_doc")
    # a byte for each line up to the last that goes, so that lines are looked up in no time
    marks = F.transform("_gone", lambda g, k: F.concat(F.repeat(F.lit("0"), g - F.coalesce(F.get(F.col("_gone"), k - 1), F.lit(-1)) - 1), F.lit("1")))
    out = chunked(out, text).withColumn("_marks", F.coalesce(F.array_join(marks, ""), F.lit("")).cast("binary")).drop("_rolled", "_gone")
    went = lambda at, n: F.substring(F.col("_marks"), at + 1, F.lit(n)) == F.lit("1" * n).cast("binary")
    kept = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~went(i, 1))
    out = out.withColumn("_kept", F.when(F.length("_marks") > 0, kept))
    chunks = F.when(F.col("_kept").isNotNull(), F.size(F.filter("_starts", lambda i: went(i, WINDOW)))).otherwise(0)
    return out.withColumns(
        {
            "n_chunks": F.size("_starts").cast("long"),
            "n_lines": F.size("_hashes").cast("long"),
            "n_removed_chunks": chunks.cast("long"),
            "n_removed_lines": F.when(F.col("_kept").isNull(), 0).otherwise(F.size("_hashes") - F.size("_kept")).cast("long"),
            text: F.when(F.col("_kept").isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n")),
        }
    ).drop("_hashes", "_starts", "_marks", "_kept")

"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Every text becomes a vector of transformed statistics. For each (lang, source) the centre and scatter of the densest
part of its rows are found by concentration steps from a coordinate-wise median start; rows far off by Mahalanobis
distance are rejected. Everything is a DataFrame aggregate of exact integers, so the verdict does not depend on the
order in which tasks finish, and a hot source is combined on the map side like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, words_of, written

SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
DIMS = 4
# Quantiles of the chi-square distribution with DIMS degrees of freedom: 0.5 and 0.975.
CHI_MEDIAN, CHI_975 = 3.3567, 11.1433
# Statistics are counted in steps of 1/UNIT, so that sums of products are exact integers.
UNIT = 1024
# Least spread of each statistic: a source whose rows all agree does not reject a row for a single symbol.
FLOORS = (0.05, 0.06, 0.12, 0.10)
# Squared distance beyond which a row goes, and the rows a group needs for an estimate of its own.
CUTOFF = 60.0
LEAST_ROWS = 50
STEPS = 4
CORE = 0.75
# Words added to both parts of a ratio, so that short texts do not look odd by chance.
PRIOR_WORDS, PRIOR_CHARS = 20, 100

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS, ``_lines`` (lines with a word) and ``base_failed``; columns so named are replaced.

    Null and blank texts have no words: all counts 0, base failed. A repeated 5-word window is found by its 64-bit
    hash within the one text, sorted with its positions only if the text has a repeat at all.
    """
    words, hashes, windows = F.col("_words"), F.col("_hashes"), F.col("_windows")
    n = F.size(words)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    out = docs.drop(*COUNTS, "base_failed", "_lines").withColumn("_words", words_of(F.col(text)))
    out = out.withColumn("_hashes", F.when(n >= WINDOW, F.transform(words, lambda w: F.xxhash64(w)))).withColumn("_text_lines", lines)
    both = lambda a, b: F.xxhash64(a, b)
    # every word is hashed once; neighbours make pairs, pairs make fours, and a four and its next word a window
    pairs = F.zip_with(F.slice(hashes, 1, n - 1), F.slice(hashes, 2, n - 1), both)
    out = out.withColumn("_pairs", F.when(n >= WINDOW, pairs))
    fours = F.zip_with(F.slice("_pairs", 1, n - 4), F.slice("_pairs", 3, n - 4), both)
    out = out.withColumn("_windows", F.when(n >= WINDOW, F.zip_with(fours, F.slice(hashes, 5, n - 4), both))).drop("_pairs", "_hashes")
    places = F.sequence(F.lit(0), F.size(windows) - 1)
    ordered = F.sort_array(F.arrays_zip(windows.alias("h"), places.alias("i")))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct(windows)) < F.size(windows), ordered)).drop("_windows")
    h, last = F.col("_sorted.h"), F.size("_sorted") - 1
    out = out.withColumn("_same", F.zip_with(F.slice(h, 1, last), F.slice(h, 2, last), lambda a, b: a == b))
    # a window is found again if it equals the one before or after it in order
    edge = F.array(F.lit(False))
    again = F.zip_with(F.concat(edge, "_same"), F.concat("_same", edge), lambda a, b: a | b)
    found = F.zip_with(again, F.col("_sorted.i"), lambda a, i: F.when(a, i))
    out = out.withColumn("_starts", F.sort_array(F.array_compact(found))).drop("_sorted", "_same")
    d = F.col("_starts")
    # the last one has no next: least passes over the null
    covered = F.aggregate(F.zip_with(d, F.slice(d, 2, F.size(d)), lambda x, y: F.least(F.lit(WINDOW), y - x)), F.lit(0), lambda a, x: a + x)
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SYMBOLS, "")).cast("long"),
            "n_dup_lines": (F.size("_text_lines") - F.size(F.array_distinct("_text_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_lines": F.size("_text_lines").cast("long"),
        }
    ).drop("_words", "_text_lines", "_starts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    """Transformed statistics in steps of 1/UNIT: log of the mean word length, roots of the shares of symbols, of
    repeated lines and of repeated words (the root evens out the spread of a count)."""
    words, chars = F.col("n_words") + PRIOR_WORDS, F.col("word_chars") + PRIOR_CHARS
    values = [
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / (F.col("_lines") + 2)),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return {f"_x{i}": F.round(v * UNIT).cast("long") for i, v in enumerate(values)}


def _estimate(rows: DataFrame) -> DataFrame:
    """Per ``_group``: number of rows, centre and the Cholesky factor of the scatter, floors added."""
    pairs = [(i, j) for i in range(DIMS) for j in range(i + 1)]
    sums = rows.groupBy("_group").agg(
        F.count("*").alias("_n"),
        *[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(DIMS)],
        *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_p{i}{j}") for i, j in pairs],
    )
    out = sums.withColumns({f"_m{i}": F.col(f"_s{i}") / F.col("_n") / UNIT for i in range(DIMS)})
    for i, j in pairs:
        scatter = F.col(f"_p{i}{j}") / F.col("_n") / UNIT**2 - F.col(f"_m{i}") * F.col(f"_m{j}")
        part = _total([scatter, *[-F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)]])
        # rounding may leave a tiny negative part: the floor alone counts then
        factor = F.sqrt(F.greatest(part, F.lit(0.0)) + FLOORS[i] ** 2) if i == j else part / F.col(f"_l{j}{j}")
        out = out.withColumn(f"_l{i}{j}", factor)
    return out.select("_group", "_n", *[f"_m{i}" for i in range(DIMS)], *[f"_l{i}{j}" for i, j in pairs])


def _start(rows: DataFrame) -> DataFrame:
    """Per ``_group``: medians, and the spreads that the median deviation from them gives."""
    middle = rows.groupBy("_group").agg(
        F.count("*").alias("_n"), *[F.percentile(f"_x{i}", F.lit(0.5)).alias(f"_c{i}") for i in range(DIMS)]
    )
    off = rows.join(middle.drop("_n"), "_group").groupBy("_group").agg(
        *[F.percentile(F.abs(F.col(f"_x{i}") - F.col(f"_c{i}")), F.lit(0.5)).alias(f"_d{i}") for i in range(DIMS)]
    )
    spread = {
        f"_l{i}{j}": F.sqrt((1.4826 * F.col(f"_d{i}") / UNIT) ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0)
        for i in range(DIMS)
        for j in range(i + 1)
    }
    centre = {f"_m{i}": F.col(f"_c{i}") / UNIT for i in range(DIMS)}
    return middle.join(off, "_group").select(
        "_group", "_n", *[c.alias(k) for k, c in centre.items()], *[c.alias(k) for k, c in spread.items()]
    )


def _distances(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with ``_d2``, the squared Mahalanobis distance to the model of their group (forward substitution)."""
    out = rows.join(model.drop("_n"), "_group", "left")
    for i in range(DIMS):
        part = _total([F.col(f"_x{i}") / UNIT - F.col(f"_m{i}"), *[-F.col(f"_l{i}{k}") * F.col(f"_y{k}") for k in range(i)]])
        out = out.withColumn(f"_y{i}", part / F.col(f"_l{i}{i}"))
    out = out.withColumn("_d2", _total([F.col(f"_y{i}") ** 2 for i in range(DIMS)]))
    return out.drop(*[c for c in model.columns if c not in ("_group", "_scale")], *[f"_y{i}" for i in range(DIMS)])


def _step() -> Column:
    """Distances are compared in steps of a 256th of their logarithm: exact quantiles then need few distinct values."""
    return (F.log1p("_d2") * 256).cast("long")


def outliers(counted: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS, steps: int = STEPS) -> DataFrame:
    """A written table of ``text_statistics`` with ``distance`` (null: not judged) and ``kept``.

    Rows that fail the base are not part of any estimate and are not kept. Groups of fewer than ``least_rows`` rows are
    pooled by language, and such pools into one; where even that has fewer rows, nothing more is rejected. Null
    languages and sources are values like others. Repeated rows count as often as they occur; an empty table gives none.
    """
    lean = counted.filter(~F.col("base_failed")).select("lang", "source", *COUNTS, "_lines")
    sizes = lean.groupBy("lang", "source").agg(F.count("*").alias("_rows"))
    by_lang = sizes.filter(F.col("_rows") < least_rows).groupBy("lang").agg(F.sum("_rows").alias("_pool"))
    named = sizes.join(by_lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    # nulls are written out, so that no two groups share a name
    name = lambda kind, *cols: F.to_json(F.struct(F.lit(kind).alias("of"), *cols), {"ignoreNullFields": "false"})
    group = (
        F.when(F.col("_rows") >= least_rows, name("own", "lang", "source"))
        .when(F.col("_pool") >= least_rows, name("language", "lang"))
        .otherwise(name("all"))
    )
    named = written(named.select(F.col("lang").alias("_glang"), F.col("source").alias("_gsource"), group.alias("_group")), "groups")
    same = F.col("lang").eqNullSafe(F.col("_glang")) & F.col("source").eqNullSafe(F.col("_gsource"))

    def grouped(df: DataFrame) -> DataFrame:
        return df.join(named, same, "left").drop("_glang", "_gsource").withColumns(_vector())

    vectors = written(grouped(lean).select("_group", *_vector()), "vectors")
    model = written(_start(vectors), "model")
    for _ in range(steps):
        far = _distances(vectors, model).withColumn("_step", _step())
        edge = far.groupBy("_group").agg(F.percentile("_step", F.lit(CORE)).alias("_edge"))
        model = written(_estimate(far.join(edge, "_group").filter(F.col("_step") <= F.col("_edge"))), "model")
    # the core is narrower than the whole: scale it by its median distance, then estimate once more from all rows
    # within the 0.975 quantile, and scale again
    for last in (False, True):
        far = _distances(vectors, model).withColumn("_step", _step())
        scale = far.groupBy("_group").agg(F.percentile("_step", F.lit(0.5)).alias("_mid"), F.count("*").alias("_rows"))
        scale = scale.select("_group", F.greatest(F.lit(1.0), F.expm1((F.col("_mid") + 0.5) / 256) / CHI_MEDIAN).alias("_scale"), "_rows")
        if not last:
            near = far.join(scale, "_group").filter(F.col("_d2") <= CHI_975 * F.col("_scale"))
            model = written(_estimate(near), "model")
    final = written(model.join(scale.filter(F.col("_rows") >= least_rows).drop("_rows"), "_group"), "model")
    judged = _distances(grouped(counted.drop("distance", "kept")), final)
    distance = F.when(~F.col("base_failed"), F.col("_d2") / F.col("_scale"))
    judged = judged.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return judged.withColumn("kept", kept).drop("_group", "_d2", "_scale", *_vector())


def quality_rules(docs: DataFrame, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``distance`` and ``kept``; missing lang or source columns fail."""
    return outliers(written(text_statistics(docs, text), "statistics"), cutoff).drop("_lines")

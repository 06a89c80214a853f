"""Documents in, cleaned and tokenised documents out: the stages of the corpus pipeline, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipwatch.llm import bpe, decontaminate, lines, quality, signature
from tipwatch.llm.common import shared_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# MCD distances, compressed sizes, line chunks, alignments and tokenizers are beyond SQL; tests/llm holds each stage
# against a plain version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated runs of lines; those of which nothing is left go. n_chars follows the text."""
    out = lines.run_dedup(docs.select(*COLUMNS))
    # the explode keeps the filter from being moved below the steps that make the text, each unfolded into the next
    made = F.struct("text", F.length("text").cast("long").alias("length"), F.col("n_removed_lines").alias("removed"))
    out = out.select("doc_id", "lang", "source", F.col("n_chars").alias("_before"), F.explode_outer(F.array(made)).alias("_made"))
    changed = F.col("_made.removed") > 0
    left = ~changed | F.col("_made.text").rlike(r"[^ \x09-\x0D]")
    text, chars = F.col("_made.text").alias("text"), F.when(changed, F.col("_made.length")).otherwise(F.col("_before")).alias("n_chars")
    return out.filter(left).select("doc_id", text, "lang", "source", chars)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates; documents without words stay.

    Rows without an id cannot name a class: they stay too, but for repeats of the same text.
    """
    kept = signature.classes(docs).filter("component_id = doc_id").select("doc_id")
    # the join deals the texts by id, which is all that dropping repeated rows needs
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    nameless = docs.filter("doc_id is null").dropDuplicates(["text"])
    return named.select(*COLUMNS).unionByName(nameless.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no piece of a benchmark item is found."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and the text that they decode to."""
    return bpe.encode_and_decode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_class),
    ("decontamination", without_benchmark),
    ("bpe", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

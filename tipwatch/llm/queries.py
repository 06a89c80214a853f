"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compression, decontaminate, lines, middle, personal, quality, ranked, secrets, sharding, signature, suffixes, tokenfiles
from .checks import CHECKS  # noqa: F401
from .common import shared_path, table


def op1_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")), secrets.BASE, secrets.WEAK)


def op2_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.substring_dedup(table(spark, sf_dir, "documents"), keep_bytes=False)


def op3_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(personal.scan(table(spark, sf_dir, "documents")), personal.BASE, personal.ADDED)


def op4_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = quality.written(quality.text_statistics(docs).drop("text"), "statistics")
    return quality.outliers(counted).select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op5_zstd_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "ids")
    tokenfiles.write(table(spark, sf_dir, "documents"), folder)
    return tokenfiles.read(spark, folder, keep_ids=False)


def op7_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature.classes(table(spark, sf_dir, "documents"))


def op8_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.run_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ["n_chunks", "n_lines", "n_removed_chunks", "n_removed_lines"]
    return docs.select("doc_id", *counts, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bag_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_wavelet_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_credential_links": op1_credential_links,
    "op2_interval_tree": op2_interval_tree,
    "op3_boosted_candidates": op3_boosted_candidates,
    "op4_mcd_outliers": op4_mcd_outliers,
    "op5_zstd_dictionaries": op5_zstd_dictionaries,
    "op6_hash_index": op6_hash_index,
    "op7_signature_tree": op7_signature_tree,
    "op8_bpe_stream": op8_bpe_stream,
    "op9_line_chunks": op9_line_chunks,
    "op10_qgram_lemma": op10_qgram_lemma,
    "op11_bag_dedup": op11_bag_dedup,
    "op12_wavelet_cuts": op12_wavelet_cuts,
    "op13_sampled_splitters": op13_sampled_splitters,
}

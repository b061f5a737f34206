"""The operators' queries: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import ann, decontaminate, divergence, hard_negatives, language_id, license_scan, line_dedup, mixing, ngram_join, secret_scan, simhash, token_count, warc
from cohortlens.llm.common import read_table, shared_path

TOKENIZER = "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document, learned from the documents that are not held out."""
    return language_id.predict_languages(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document: template, best coverage, number of occurrences and their spans."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source, with the lines it had and the lines dropped."""
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned into a new ledger; spans hold all findings, base_sha256 digests those of the base rules."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.secrets(docs, shared_path(spark, "ledger"), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best overlap."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id is divisible by 20."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives written."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"), spark)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), ["doc_id"])


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of links of Jaccard similarity 0.85 or more of every document."""
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100, after the labels of every seventh id have moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between the sources of every language and the terms in which each stands out."""
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_license_scan, op3_line_dedup, op4_secret_scan, op5_decontamination, op6_nearest, op7_mixing, op8_warc, op9_simhash, op10_token_count, op11_ngram_join, op12_hard_negatives, op13_source_divergence)
}

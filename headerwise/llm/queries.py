"""The operators of this subpackage as registered queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headerwise.llm.common import read_table
from headerwise.llm.decontaminate import contamination
from headerwise.llm.divergence import divergences
from headerwise.llm.embeddings import similar_vectors
from headerwise.llm.learning import tables
from headerwise.llm.lines import line_report
from headerwise.llm.minhash import near_duplicates
from headerwise.llm.oracle import ORACLE  # noqa: F401
from headerwise.llm.pieces import encoded
from headerwise.llm.pii import pii_digests
from headerwise.llm.quality import quality_scores
from headerwise.llm.ranking import ranked_documents
from headerwise.llm.secrets import secret_digests
from headerwise.llm.sharding import shard_digests
from headerwise.llm.substrings import without_repeats
from headerwise.llm.toxicity import toxicity_scores


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(*tables(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digests(read_table(spark, sf_dir, "documents"), shards=8)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(*tables(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10
    )
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(read_table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs).select("doc_id", "n_tokens", "ids", "round_trip", "parity")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(read_table(spark, sf_dir, "documents"))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark")
    return ranked_documents(read_table(spark, sf_dir, "documents"), items, depth=10)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = without_repeats(docs, window=35)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(read_table(spark, sf_dir, "documents"), least=3, terms=200)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_minhash,
        op3_sharding,
        op4_toxicity,
        op5_decontamination,
        op6_pii,
        op7_embeddings,
        op8_sentencepiece,
        op9_lines,
        op10_secrets,
        op11_ranking,
        op12_substrings,
        op13_divergence,
    )
}

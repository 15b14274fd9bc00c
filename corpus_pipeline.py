"""The corpus pipeline: quality, lines, near duplicates, benchmark text, tokens.

Every stage takes all rows that the one before kept and returns the columns of
documents; the last adds token ids. Nulls, empty texts, repeated rows and further
columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headerwise.llm.common import free_name, read_table
from headerwise.llm.decontaminate import decontaminated
from headerwise.llm.lines import deduplicated_lines
from headerwise.llm.minhash import without_near_duplicates
from headerwise.llm.pieces import encoded
from headerwise.llm.quality import of_quality
from headerwise.sources.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of more than the lowest grade; fitted on ``labels`` of these documents."""
    return of_quality(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay at their first place; a document of which nothing is left goes."""
    before = F.coalesce(F.length(F.btrim("text", F.lit(" \t\r\n"))), F.lit(0)) == 0
    blank = free_name(docs.columns, "_blank")
    rest = deduplicated_lines(docs.withColumn(blank, before))
    left = F.length(F.btrim("text", F.lit(" \t\r\n"))) > 0
    return rest.where(F.col(blank) | left).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return without_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly such text goes."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ``n_tokens``, ``ids``, ``round_trip``, ``parity``."""
    return encoded(docs)


STAGES = [
    ("quality", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: SQL has no classifier, no 64-bit hashes of these kinds and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

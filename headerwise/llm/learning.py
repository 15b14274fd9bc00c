"""Fitting linear models of hashed text features on a bounded sample of labelled rows.

The sample's features are counted by Spark, and only those that differ between the
labels by more than chance are kept, at most ``FEATURES`` of them. The rows that reach
the driver hold kept features alone, so their size is bounded by the sample's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headerwise.llm.common import by_batch, column_text, read_table
from headerwise.sources.scratch import written

#: Labelled rows a model is fitted on, at most.
SAMPLE_ROWS = 6000
#: Size of the hashed feature space.
FEATURES = 1 << 18
#: Standard deviations by which a feature must differ between labels, and its rows.
MIN_Z, MIN_ROWS = 4.0, 3

_ROW = "doc_id long, grade int, features array<int>, variants array<array<int>>"


def labelled_sample(
    docs: DataFrame, labels: DataFrame, grade, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """At most ``rows`` rows ``(doc_id, grade, text)``, one for each labelled document.

    The documents are chosen by a hash of their doc_id among those with a label and a
    text. Of several labels of one document the lowest counts, of several texts the
    smallest; null labels and documents without text do not.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    chosen = chosen.where("doc_id IS NOT NULL AND grade IS NOT NULL")
    chosen = chosen.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    texts = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # repeated rows collapse before the shuffle; only doc_ids are moved
    chosen = chosen.join(texts.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` rows of two numbers
    found = texts.join(F.broadcast(chosen), "doc_id")
    return written(
        found.groupBy("doc_id", "grade").agg(F.min("text").alias("text")), "labelled"
    )


def _counts(batches: Iterator[pa.RecordBatch], maker: Callable):
    make = maker()
    for batch in by_batch(batches, 2000):
        grades = column_text(batch, "grade")
        found = [make.features(t) for t in column_text(batch, "text")]
        for grade in sorted(set(grades)):
            own = [f for f, g in zip(found, grades, strict=True) if g == grade]
            ids, n = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids.astype(np.int32)),
                    pa.array(np.full(len(ids), grade, np.int32)),
                    pa.array(n.astype(np.int64)),
                ],
                names=["feature", "grade", "n"],
            )


def _rows(batches: Iterator[pa.RecordBatch], maker: Callable, kept):
    make, keep = maker(), kept.value
    for batch in by_batch(batches, 500):
        texts = column_text(batch, "text")
        own = [f[keep[f]].astype(np.int32) for f in map(make.features, texts)]
        variants = [[f[keep[f]].astype(np.int32) for f in make.variants(t)] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                batch.column(batch.schema.get_field_index("grade")),
                pa.array(own, pa.list_(pa.int32())),
                pa.array(variants, pa.list_(pa.list_(pa.int32()))),
            ],
            names=["doc_id", "grade", "features", "variants"],
        )


def training_rows(sample: DataFrame, maker: Callable) -> list:
    """The sample's rows with the features that tell the grades apart, by doc_id."""
    spark = sample.sparkSession
    sizes = {r.grade: r.n for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    counts = sample.mapInArrow(partial(_counts, maker=maker), "feature int, grade int, n long")
    cuts = sorted(sizes)[1:]
    above = {g: sum(n for k, n in sizes.items() if k >= g) / total for g in cuts}
    by_feature = counts.groupBy("feature").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("grade") >= g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in cuts],
    )
    far = F.lit(False)
    for g, p in above.items():
        off = F.abs(F.col(f"n{g}") - F.col("n") * F.lit(p))
        far = far | (off >= F.sqrt(F.col("n") * F.lit(p * (1 - p))) * F.lit(MIN_Z))
    kept = np.zeros(FEATURES, bool)
    # never more than FEATURES numbers
    ids = [r.feature for r in by_feature.where((F.col("n") >= MIN_ROWS) & far).collect()]
    kept[ids] = True
    shared = spark.sparkContext.broadcast(kept)
    rows = sample.mapInArrow(partial(_rows, maker=maker, kept=shared), _ROW).collect()
    return sorted(rows, key=lambda r: (r.doc_id, r.grade, r.features))


class Sparse:
    """Rows of feature lists as one matrix of zeros and ones."""

    def __init__(self, rows: list[list[int]], width: int):
        self.index = np.array([i for r in rows for i in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.rows, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, g[self.row], self.width)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descend(gradient: Callable, start: list[np.ndarray], steps: int = 300, rate: float = 0.05):
    """Adam on several arrays; ``gradient`` takes and returns as many."""
    x = [a.copy() for a in start]
    first, second = [np.zeros_like(a) for a in x], [np.zeros_like(a) for a in x]
    for step in range(1, steps + 1):
        for i, g in enumerate(gradient(*x)):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            size = np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8
            x[i] -= rate * first[i] / (1 - 0.9**step) / size
    return x


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")

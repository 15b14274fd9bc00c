"""Quality by ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature, shared by all grades, and ordered thresholds:
P(grade >= j) = sigmoid(z - threshold_j). A row's expected grade ranks it, its tail
probability selects it. Features are the words of a text and the shares of word shapes
(``a``, ``A!!``, ``a$$``, ``|``), repeated words and repeated lines in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerwise.llm.common import (
    CACHE_WORDS,
    by_batch,
    column_text,
    extended,
    free_name,
    opened,
    releasing,
    shipped,
    text_column,
)
from headerwise.llm.learning import (
    FEATURES,
    SAMPLE_ROWS,
    Sparse,
    descend,
    labelled_sample,
    sigmoid,
    training_rows,
)

#: Weight of the squared weights in the loss.
RIDGE = 1e-3
#: Rows are kept from this probability of more than the lowest grade.
MIN_TAIL = 0.5

_LOWER = re.compile("[a-zß-öø-ÿ]+")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")
_DIGIT = re.compile("[0-9]+")
_RUN = re.compile(r"(.)\1{2,}")


def _hash(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace")) % FEATURES


def shape(word: str) -> str:
    """Letters and digits as one sign per run, other runs cut to two, eight signs."""
    word = _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", word[:200])))
    return _RUN.sub(r"\1\1", word)[:8]


class QualityFeatures(dict):
    """Features of texts; as a dict, the number of each word met so far."""

    def __init__(self):
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.shapes: dict[str, int] = {}
        self.shape_of = np.zeros(1 << 10, np.int64)
        self.feature_of = np.zeros(1 << 10, np.int64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        if number == len(self.shape_of):
            self.shape_of = np.concatenate((self.shape_of, np.zeros_like(self.shape_of)))
            self.feature_of = np.concatenate((self.feature_of, np.zeros_like(self.feature_of)))
        self.shape_of[number] = self.shapes.setdefault(shape(word), len(self.shapes))
        self.feature_of[number] = _hash(f"w{word.lower()}")
        return number

    def features(self, text: str | None) -> np.ndarray:
        """Sorted distinct features; a text without words has one of its own."""
        words = (text or "").split()
        if not words:
            return np.array([_hash("empty")], np.int64)
        if len(self) > CACHE_WORDS:
            self.restart()
        n = len(words)
        codes = np.fromiter(map(self.__getitem__, words), np.int64, n)
        distinct = np.unique(codes)
        counts = np.bincount(self.shape_of[codes], minlength=len(self.shapes))
        names = list(self.shapes)
        share = lambda name, k: _hash(f"s{name}|{int(np.log2(k / n))}")
        extra = [share(names[i], counts[i]) for i in np.flatnonzero(counts)]
        if again := int(np.count_nonzero(codes[1:] == codes[:-1])):
            extra.append(share("<again>", again))
        if len(distinct) < n:
            extra.append(share("<repeated>", n - len(distinct)))
        lines = [x for x in text.split("\n") if x]
        extra.append(_hash(f"l{int(10 * (1 - len(set(lines)) / max(1, len(lines))))}"))
        extra.append(_hash(f"n{int(np.log2(n))}"))
        return np.unique(np.concatenate((self.feature_of[distinct], np.array(extra, np.int64))))

    def variants(self, text: str | None) -> list:
        return []


@dataclass(frozen=True)
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= grades[1]), P(grade >= grades[2]), ... in columns."""
        return sigmoid(z[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: list, ridge: float = RIDGE) -> OrdinalModel:
    """Maximum likelihood with all grades weighted alike, from ``training_rows``.

    The thresholds are a first one plus positive steps, so they stay in order. With
    fewer than two grades nothing can be learnt and every row gets the only grade.
    """
    grades = sorted({r.grade for r in rows})
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros(FEATURES), np.empty(0))
    ids = sorted({i for r in rows for i in r.features})
    place = {x: i for i, x in enumerate(ids)}
    data = Sparse([[place[i] for i in r.features] for r in rows], len(ids))
    y = np.array([grades.index(r.grade) for r in rows])
    k = len(grades)
    weight = (1 / (k * np.bincount(y, minlength=k)))[y]

    def cuts(a: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((a[:1], np.exp(a[1:]))))

    def gradient(w: np.ndarray, a: np.ndarray):
        z = data.times(w)
        edge = np.concatenate(([-np.inf], cuts(a), [np.inf]))
        upper, lower = edge[y + 1] - z, edge[y] - z
        up = np.where(y == k - 1, 1.0, sigmoid(np.minimum(upper, 40)))
        low = np.where(y == 0, 0.0, sigmoid(np.maximum(lower, -40)))
        slope_up, slope_low = up * (1 - up), low * (1 - low)
        p = np.maximum(up - low, 1e-9)
        by_edge = np.bincount(y + 1, -weight * slope_up / p, k + 1)
        by_edge += np.bincount(y, weight * slope_low / p, k + 1)
        inner = by_edge[1:k]
        steps = np.cumsum(inner[::-1])[::-1]
        steps = np.concatenate((steps[:1], steps[1:] * np.exp(a[1:])))
        return data.back(weight * (slope_up - slope_low) / p) + ridge * w, steps

    w, a = descend(gradient, [np.zeros(len(ids)), np.linspace(-1, 0, k - 1)])
    weights = np.zeros(FEATURES)
    weights[ids] = w
    return OrdinalModel(grades, weights, cuts(a))


def rating() -> Column:
    """Three grades from the labels: 0 poor, 1 sound but toxic, 2 sound."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(
        F.col("quality") == 1, 2
    )


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """A model of the grades in ``labels``, fitted on at most ``rows`` documents."""
    sample = labelled_sample(docs, labels, rating(), rows)
    return fit_ordinal(training_rows(sample, QualityFeatures))


@releasing
def _scores(batches: Iterator[pa.RecordBatch], model, text: str, names: list[str]):
    model, make = opened(model), QualityFeatures()
    low, steps = model.grades[0], np.diff(model.grades)
    for batch in by_batch(batches, 500):
        z = np.array([model.weights[make.features(t)].sum() for t in column_text(batch, text)])
        tails = model.tails(z) if len(steps) else np.ones((len(z), 0))
        tail = tails[:, 0] if len(steps) else np.ones(len(z))
        columns = [pa.array(low + tails @ steps), pa.array(tail)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])


def graded(docs: DataFrame, model: OrdinalModel, names: tuple[str, str]) -> DataFrame:
    """``docs`` with the expected grade and the probability of more than the lowest."""
    docs = text_column(docs, "text")
    schema = extended(docs, ", ".join(f"{name} double" for name in names))
    shared = shipped(docs.sparkSession, model)
    return docs.mapInArrow(
        partial(_scores, model=shared, text="text", names=list(names)), schema
    )


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every row of ``docs (doc_id, text)``: ``doc_id``, ``expected_grade``
    (0 to 2), ``tail`` (probability of more than grade 0) and ``kept`` (from 0.5).

    The model is fitted on a bounded sample of ``labels (doc_id, quality, toxic)``;
    null labels do not count. Every whole text is scored; null and empty texts are
    scored alike, by the thresholds and the feature of a text without words. Repeated
    rows are scored alike. Other columns are not read. Without two grades every row
    is kept; an empty table gives an empty result.
    """
    model = fit_quality(docs, labels)
    rows = graded(docs.select("doc_id", "text"), model, ("expected_grade", "tail"))
    return rows.select("doc_id", "expected_grade", "tail", (F.col("tail") >= MIN_TAIL).alias("kept"))


def of_quality(docs: DataFrame, labels: DataFrame, min_tail: float = MIN_TAIL) -> DataFrame:
    """The rows of ``docs`` whose text is more than the lowest grade, all columns as
    they are; the model is fitted on ``docs`` and ``labels`` as in ``quality_scores``."""
    model = fit_quality(docs, labels)
    names = tuple(free_name(docs.columns, n) for n in ("_expected", "_tail"))
    return graded(docs, model, names).where(F.col(names[1]) >= min_tail).drop(*names)

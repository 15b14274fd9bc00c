"""Toxicity by a classifier that counterfactual sentences keep fair.

A logistic model of hashed words and their beginnings. Labelled texts that mention a
group are also taken with that group's name swapped for another of its kind and for a
neutral word; the loss has the squared change of their score. So a group's name alone
cannot carry a high score, however the labels mention it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerwise.llm.common import CACHE_WORDS, by_batch, column_text, extended, opened, shipped, text_column
from headerwise.llm.decontaminate import words_of
from headerwise.llm.learning import (
    FEATURES,
    SAMPLE_ROWS,
    Sparse,
    descend,
    labelled_sample,
    sigmoid,
    training_rows,
)

RIDGE = 1e-3
#: Weight of the squared score change between a text and its swapped forms.
FAIRNESS = 1.0
CUT = 0.7

# Names of groups; those of one line can stand for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male", "transgender"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
)
NEUTRAL = "people"
_PREFIXES = (3, 4, 5, 6)


def word_features(word: bytes) -> tuple[int, ...]:
    """The word and its first three to six letters, hashed."""
    names = [b"w" + word]
    text = word.decode("utf-8", "replace")
    names += [f"{k}{text[:k]}".encode() for k in _PREFIXES if len(text) > k]
    return tuple(xxhash.xxh3_64_intdigest(n) % FEATURES for n in names)


class WordFeatures(dict):
    """The features of each word met so far, or those of them that have a weight."""

    def __init__(self, weighted: np.ndarray | None = None):
        self.weighted = weighted

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = word_features(word)
        if self.weighted is not None:
            found = tuple(f for f in found if self.weighted[f])
        self[word] = found
        return found

    def of(self, words: set[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = set(chain.from_iterable(map(self.__getitem__, words)))
        return np.fromiter(found, np.int64, len(found))


class ToxicityFeatures:
    """Features of a text, and of its forms with identity terms swapped."""

    def __init__(self, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS):
        self.known = WordFeatures()
        self.swaps: dict[bytes, list[bytes]] = {}
        for group in terms:
            for i, term in enumerate(group):
                other = group[(i + 1) % len(group)]
                self.swaps[term.encode()] = [other.encode(), NEUTRAL.encode()]

    def features(self, text: str | None) -> np.ndarray:
        return self.known.of(text_words(text))

    def variants(self, text: str | None) -> list[np.ndarray]:
        words = text_words(text)
        named = [w for w in words if w in self.swaps]
        if not named:
            return []
        rest = words.difference(named)
        forms = [rest | {self.swaps[w][i] for w in named} for i in (0, 1)]
        return [self.known.of(f) for f in forms]


def text_words(text: str | None) -> set[bytes]:
    return set(words_of(text.lower().encode("utf-8", "replace"))) if text else set()


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float


def fit_toxic(rows: list, ridge: float = RIDGE, fairness: float = FAIRNESS) -> ToxicityModel:
    """Logistic regression with both labels weighted alike and the fairness penalty.

    With one label only nothing can be learnt and every text gets that label's side.
    """
    y = np.array([float(r.grade > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(FEATURES), -2.0 if not len(y) or not y.max() else 2.0)
    swapped = [(r.features, form) for r in rows for form in r.variants]
    ids = sorted({i for r in rows for i in r.features} | {i for _, f in swapped for i in f})
    place = {x: i for i, x in enumerate(ids)}
    matrix = lambda lists: Sparse([[place[i] for i in f] for f in lists], len(ids))
    data = matrix([r.features for r in rows])
    own, other = matrix([a for a, _ in swapped]), matrix([b for _, b in swapped])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))

    def gradient(w: np.ndarray, b: np.ndarray):
        g = weight * (sigmoid(data.times(w) + b[0]) - y)
        total = data.back(g) + ridge * w
        if swapped:
            change = 2 * fairness / len(swapped) * (own.times(w) - other.times(w))
            total += own.back(change) - other.back(change)
        return total, np.array([g.sum()])

    w, b = descend(gradient, [np.zeros(len(ids)), np.zeros(1)])
    weights = np.zeros(FEATURES)
    weights[ids] = w
    return ToxicityModel(weights, float(b[0]))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    fairness: float = FAIRNESS,
    rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """A model of ``labels (doc_id, toxic)``, fitted on at most ``rows`` documents."""
    sample = labelled_sample(docs, labels, F.col("toxic").cast("int"), rows)
    return fit_toxic(training_rows(sample, partial(ToxicityFeatures, terms)), fairness=fairness)


def _scores(batches: Iterator[pa.RecordBatch], model, text: str, name: str):
    model = opened(model)
    known = WordFeatures(model.weights != 0)
    for batch in by_batch(batches, 500):
        found = [known.of(text_words(t)) for t in column_text(batch, text)]
        z = np.array([np.sort(model.weights[f]).sum() for f in found]) + model.bias
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sigmoid(z))], [*batch.schema.names, name]
        )


def toxicity(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every whole text; a column called ``name``
    is replaced, all others stay. Null and empty texts score alike."""
    docs = text_column(docs.drop(name), "text")
    schema = extended(docs, f"{name} double")
    shared = shipped(docs.sparkSession, model)
    return docs.mapInArrow(partial(_scores, model=shared, text="text", name=name), schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every row of ``docs (doc_id, text)``: ``doc_id``, ``held_out`` (crc32
    of the doc_id as text leaves 1 when divided by 3), ``score`` and ``predicted`` (1
    from 0.7).

    Held-out labels and null labels are never learnt from, and the score depends on
    the text alone, so repeated rows score alike and a null text scores as an empty
    one. A null doc_id is not held out. Other columns are not read. An empty table
    gives an empty result.
    """
    fold = lambda: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = fit_toxicity(docs, labels.where(fold() != 1))
    rows = toxicity(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )

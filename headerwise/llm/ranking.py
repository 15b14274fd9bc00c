"""Ranked lexical search of few queries in many documents, the search reversed.

The items' terms make an inverted index, which is broadcast. Each document's term
counts are streamed through it once; every task keeps, for each item, a bounded heap
of its best documents, and the tasks' heaps are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headerwise.llm.common import (
    by_batch,
    column_bytes,
    extended,
    opened,
    shipped,
    text_column,
)
from headerwise.llm.decontaminate import words_of

#: Bytes of item text in one index. More items make several, each with a pass of its own.
BLOCK_BYTES = 8 << 20
#: Scores held at a time while a task reads its documents.
CELLS = 1 << 21


class ItemIndex:
    """The terms of a block of items, numbered, and the items of each term."""

    def __init__(self, texts: list[bytes | None]):
        self.number: dict[bytes, int] = {}
        at: list[list[int]] = []
        for item, text in enumerate(texts):
            for term in set(words_of(text)):
                n = self.number.setdefault(term, len(at))
                if n == len(at):
                    at.append([])
                at[n].append(item)
        self.items = len(texts)
        self.sizes = np.array([len(x) for x in at], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.postings = np.array([i for x in at for i in x], np.int64)
        self.weights = np.zeros(len(at), np.int64)

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """Lengths of the texts in terms; and text, term and count for the index's terms."""
        length, owner, codes = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            terms = words_of(text)
            length[i] = len(terms)
            found = np.fromiter(map(self.number.get, terms, repeat(-1)), np.int64, len(terms))
            found, n = np.unique(found[found >= 0], return_counts=True)
            owner.append(np.full(len(found), i))
            codes.append(np.stack((found, n)))
        if not texts:
            return length, *np.zeros((3, 0), np.int64)
        return length, np.concatenate(owner), *np.concatenate(codes, axis=1)


def _frequencies(batches: Iterator[pa.RecordBatch], shared: Broadcast):
    """Per task: documents and terms in all (as term -1), and each term's documents."""
    index: ItemIndex = opened(shared)
    documents = terms = 0
    holding = np.zeros(len(index.sizes), np.int64)
    for batch in by_batch(batches, 200):
        length, _, term, _ = index.counts(column_bytes(batch, "text"))
        documents += int(np.count_nonzero(length))
        terms += int(length.sum())
        holding += np.bincount(term, minlength=len(holding))
    held = np.flatnonzero(holding)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(([-1], held))),
            pa.array(np.concatenate(([documents], holding[held]))),
            pa.array(np.concatenate(([terms], np.zeros(len(held), np.int64)))),
        ],
        names=["term", "df", "length"],
    )


class _Heaps:
    """The best documents of each item so far: higher scores first, then smaller ids."""

    def __init__(self, items: int, depth: int):
        self.depth = depth
        self.best: list[list[tuple[int, tuple]]] = [[] for _ in range(items)]
        self.floor = np.ones(items, np.int64)

    def add(self, item: int, scores: list[int], ids: list) -> None:
        held = self.best[item] + [
            (-s, (i is None, 0 if i is None else i)) for s, i in zip(scores, ids, strict=True)
        ]
        held.sort()
        self.best[item] = held[: self.depth]
        if len(held) >= self.depth:
            self.floor[item] = -self.best[item][-1][0]


def _scored(index: ItemIndex, texts: list[bytes | None], documents: int, terms: int) -> np.ndarray:
    """Integer scores, a row for each text and a column for each item."""
    length, owner, term, count = index.counts(texts)
    # the length's part, in integers of any size: it cannot overflow
    m = [10 + 90 * n * documents // max(terms, 1) for n in length.tolist()]
    m = np.array(m, np.int64)[owner]
    part = index.weights[term] * (1_000_000_000 * count // (1000 * count + 8 * m))
    size = index.sizes[term]
    ends = np.cumsum(size)
    places = np.arange(int(size.sum())) - np.repeat(ends - size - index.starts[term], size)
    cell = np.repeat(owner, size) * index.items + index.postings[places]
    # sums of integers below 2^53 are exact in doubles
    total = np.bincount(cell, np.repeat(part, size), len(texts) * index.items)
    return total.astype(np.int64).reshape(len(texts), index.items)


def _ranked(batches: Iterator[pa.RecordBatch], shared: Broadcast, depth: int, documents: int, terms: int):
    index: ItemIndex = opened(shared)
    heaps = _Heaps(index.items, depth)
    kind = None
    for batch in by_batch(batches, max(1, min(500, CELLS // max(index.items, 1)))):
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        kind, ids = ids.type, ids.to_pylist()
        scores = _scored(index, column_bytes(batch, "text"), documents, terms)
        for item in np.flatnonzero((scores >= heaps.floor).any(axis=0)).tolist():
            rows = np.flatnonzero(scores[:, item] >= heaps.floor[item])
            heaps.add(item, scores[rows, item].tolist(), [ids[r] for r in rows.tolist()])
    if kind is not None:
        held = [(i, -s, None if null else d) for i, h in enumerate(heaps.best) for s, (null, d) in h]
        place, score, doc = zip(*held, strict=True) if held else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, kind), pa.array(place, pa.int32()), pa.array(score, pa.int64())],
            names=["doc_id", "place", "score"],
        )


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Rows ``(item_id, text)`` in blocks of at most BLOCK_BYTES of text, or one row."""
    block, held = [], 0
    for row in items.toLocalIterator():
        size = len(row.text or "")
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row.item_id, row.text and row.text.encode()))
        held += size
    if block:
        yield block


def _searched(texts: DataFrame, block: list[tuple], kind, depth: int) -> DataFrame:
    spark = texts.sparkSession
    index = ItemIndex([text for _, text in block])
    found = texts.select("text").mapInArrow(
        partial(_frequencies, shared=shipped(spark, index)), "term long, df long, length long"
    )
    documents = terms = 0
    holding: dict[int, int] = {}
    # a row for each term of the block and one more
    for row in found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).collect():
        if row.term < 0:
            documents, terms = row.df, row.length
        else:
            holding[row.term] = row.df
    for term, df in holding.items():
        index.weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], kind)
    schema = extended(texts.select("doc_id"), "place int, score long")
    heaps = texts.mapInArrow(
        partial(_ranked, shared=shipped(spark, index), depth=depth, documents=documents, terms=terms),
        schema,
    )
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    return best.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, depth: int = 10) -> DataFrame:
    """The ``depth`` best documents of ``docs`` (``doc_id``, ``text``) for each item.

    Rows ``item_id, rank, doc_id, score``: ranks from 1, higher scores first, equal ones
    by ascending doc_id with null last. Terms are runs of ASCII letters and digits and
    of anything beyond ASCII, with A-Z lowered. The weight of a term falls with the number
    of documents that hold it, and its count levels off the sooner the shorter the
    document is; all is integer arithmetic but the logarithm.

    Every row of ``items`` (``item_id``, ``text``) is an item, so repeated rows are
    answered each, and so is every row of ``docs`` a document. Items or documents whose
    text is null, empty or without terms have no rows, and there are fewer than ``depth``
    where fewer documents share a term. Further columns are ignored, whatever they are called. Items
    are read in blocks of BLOCK_BYTES of text, which bound what is broadcast; each
    block takes two passes over the documents. Without items the result is empty.
    """
    texts = text_column(docs, "text").select("doc_id", "text")
    items = text_column(items, "text").select("item_id", "text")
    kind = extended(items.sparkSession.createDataFrame([], "place int"), "item_id int")
    kind["item_id"].dataType = items.schema["item_id"].dataType
    out = None
    for block in _blocks(items):
        rows = _searched(texts, block, kind, depth)
        out = rows if out is None else out.unionByName(rows)
    return _searched(texts, [], kind, depth) if out is None else out

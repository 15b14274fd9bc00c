"""Substring dedup by de Bruijn compaction of token k-mers.

The ``window`` consecutive words that start at a place are an edge, from its first to
its last ``window - 1`` words. Neighbouring edges that share their anchor, the short
word sequence of least hash inside them, make a path, cut alike wherever its words
stand. Only paths whose anchor occurs again can hold a repeated edge.

Equal paths are one path of the graph. Paths that follow each other wherever they
occur, without a branch, are compacted into one by joins; an occurrence is then a long
span with its source coordinates, and the words at all coordinates of a compacted path
are compared by digest. Paths that occur once but share an anchor are taken apart into
their edges, and those edges are compared alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerwise.llm.common import (
    CACHE_WORDS,
    GOLDEN,
    by_batch,
    column_bytes,
    extended,
    free_name,
    joined,
    lasting,
    mix,
    text_column,
)
from headerwise.llm.minhash import WordHashes
from headerwise.sources.scratch import measured, written

#: Words of an anchor. Longer ones make more paths, shorter ones meet by chance.
ANCHOR = 8
#: Bytes of the digests that decide whether words are the same.
DIGEST = 16

_PLACE = ["doc_id", "print"]


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64, as many as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(GOLDEN), -1, 1 << 64))
            self.up, self.down = (
                np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))))
                for base in (GOLDEN, inverse)
            )
        return self.up[:n], self.down[:n]


def _least(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and place of the first least code of every ``width`` neighbours."""
    value, place, reach = codes, np.arange(len(codes)), 1
    while reach < width:
        step = min(reach, width - reach)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        place = np.where(right, place[step:], place[:-step])
        reach += step
    return value, place


def paths_of(codes: np.ndarray, sizes: np.ndarray, window: int, anchor: int, powers: _Powers):
    """Paths of texts whose word codes stand one after the other in ``codes``.

    Arrays of text number, first word within the text, number of edges, anchor, and
    a hash of the path's words.
    """
    up, down = powers.of(len(codes) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * up[:-1])))
    short = mix((sums[anchor:] - sums[:-anchor]) * down[: len(sums) - anchor])
    least, at = _least(short, window - anchor + 1)
    ends = np.cumsum(sizes)
    first = ends - sizes
    # the texts long enough for an edge, and the places where one can start
    long = np.flatnonzero(sizes >= window)
    counts = sizes[long] - window + 1
    text = np.repeat(long, counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + first[text]
    head = np.flatnonzero(np.diff(at[start], prepend=-1))
    edges = np.diff(np.append(head, len(start)))
    begin, text = start[head], text[head]
    end = begin + edges + window - 1
    whole = mix((sums[end] - sums[begin]) * down[begin] + edges.astype(np.uint64))
    return text, begin - first[text], edges, least[begin].view(np.int64), whole.view(np.int64)


def _paths(batches: Iterator[pa.RecordBatch], window: int, anchor: int):
    known, powers = WordHashes(), _Powers()
    for batch in by_batch(batches, 100):
        words = [t.split() if t else [] for t in column_bytes(batch, "text")]
        sizes = np.array([len(w) for w in words], np.int64)
        if not (sizes >= window).any():
            continue
        if len(known) > CACHE_WORDS:
            known.clear()
        codes = np.fromiter(
            (c for w in words for c in map(known.__getitem__, w)), np.uint64, int(sizes.sum())
        )
        with np.errstate(over="ignore"):
            text, start, edges, least, whole = paths_of(codes, sizes, window, anchor, powers)
        rows = batch.select(_PLACE).take(pa.array(text))
        yield pa.RecordBatch.from_arrays(
            [
                *rows.columns,
                pa.array(start, pa.int32()),
                pa.array(edges, pa.int32()),
                pa.array(least),
                pa.array(whole),
            ],
            names=[*_PLACE, "start", "edges", "anchor", "path"],
        )


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=DIGEST).digest()


def _read(batches: Iterator[pa.RecordBatch], window: int):
    """Digests of the words at the coordinates ``seek`` of each text: of a whole span,
    or, where ``path`` is null, of each of its edges."""
    for batch in by_batch(batches, 100):
        row, start, size, path, digest, again = [], [], [], [], [], []
        seeks = batch.column(batch.schema.get_field_index("seek")).to_pylist()
        for i, (text, seek) in enumerate(zip(column_bytes(batch, "text"), seeks, strict=True)):
            words = text.split()
            for s in seek:
                whole = s["path"] is not None
                reach = s["edges"] + window - 1 if whole else window
                for k in range(s["start"], s["start"] + (1 if whole else s["edges"])):
                    row.append(i)
                    start.append(k)
                    size.append(s["edges"] if whole else 1)
                    path.append(s["path"])
                    digest.append(_digest(words[k : k + reach]))
                    again.append(s["again"])
        rows = batch.select(_PLACE).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                *rows.columns,
                pa.array(start, pa.int32()),
                pa.array(size, pa.int32()),
                pa.array(path, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.array(again, pa.bool_()),
            ],
            names=[*_PLACE, "start", "edges", "path", "digest", "again"],
        )


def _cut(batches: Iterator[pa.RecordBatch], text: str, gone: str):
    for batch in by_batch(batches, 100):
        n_words, n_removed, rest = [], [], []
        spans = batch.column(batch.schema.get_field_index(gone)).to_pylist()
        for body, own in zip(column_bytes(batch, text), spans, strict=True):
            words = body.split() if body else []
            n_words.append(len(words))
            if own:
                stay = np.zeros(len(words) + 1, np.int64)
                for s in own:
                    stay[s["first"]] += 1
                    stay[s["end"]] -= 1
                covered = np.cumsum(stay)[:-1] > 0
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            n_removed.append(n_words[-1] - len(words))
            rest.append(b" ".join(words))
        new = {
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(rest, pa.binary()).cast(pa.string()),
        }
        batch = batch.select([n for n in batch.schema.names if n != gone])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *new.values()], names=[*batch.schema.names, *new]
        )


def _rows(docs: DataFrame) -> DataFrame:
    docs = text_column(docs, "text")
    return docs.select("doc_id", "text", F.xxhash64("text").alias("print"))


def _with_rows(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the arrays ``found`` of their places. Both grow with the
    corpus, so both are shuffled at every size."""
    found = found.withColumnsRenamed({c: f"_{c}" for c in _PLACE})
    same = rows["doc_id"].eqNullSafe(found["_doc_id"]) & (rows["print"] == found["_print"])
    return rows.join(found.hint("merge"), same, how).drop("_doc_id", "_print")


def _shared(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """The paths whose anchor is that of a further path; ``alike`` where those are equal."""
    rows = rows.where(F.col("text").isNotNull())
    schema = extended(rows.select(*_PLACE), "start int, edges int, anchor long, path long")
    every = written(rows.mapInArrow(partial(_paths, window=window, anchor=anchor), schema), "paths")
    anchors = every.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("low"), F.max("path").alias("high")
    )
    anchors = anchors.where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike"))
    return every.join(anchors.hint("merge"), "anchor").drop("anchor")


def _compacted(paths: DataFrame) -> DataFrame:
    """Occurrences of repeated paths, joined where the graph has no branch.

    ``path`` is the first of the joined paths; ``parts`` their number. With both, the
    words are the same wherever it occurs, but for collisions of the hash.
    """
    order = Window.partitionBy(*_PLACE).orderBy("start")
    ahead, behind = F.lead("start").over(order), F.lag(F.col("start") + F.col("edges")).over(order)
    paths = paths.select(*_PLACE, "start", "edges", "path").dropDuplicates([*_PLACE, "start"])
    paths = paths.withColumns(
        {
            "next": F.when(ahead == F.col("start") + F.col("edges"), F.lead("path").over(order)),
            "last": F.when(behind == F.col("start"), F.lag("path").over(order)),
        }
    )
    paths = written(paths, "linked")

    def single(c: str) -> Column:
        return (F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))

    # a path branches when not one and the same path comes next, or came last, everywhere
    nodes = paths.groupBy("path").agg(
        F.coalesce(single("next"), F.lit(False)).alias("one_next"),
        F.coalesce(single("last"), F.lit(False)).alias("one_last"),
    )
    paths = paths.join(nodes.hint("merge"), "path")
    glued = F.col("last").isNotNull() & F.col("one_last") & F.lag("one_next").over(order)
    paths = paths.withColumn("head", F.when(F.coalesce(glued, F.lit(False)), 0).otherwise(1))
    paths = paths.withColumn("span", F.sum("head").over(order))
    return paths.groupBy(*_PLACE, "span").agg(
        F.min("start").alias("start"),
        F.sum("edges").cast("int").alias("edges"),
        F.min_by("path", "start").alias("path"),
        F.count(F.lit(1)).alias("parts"),
    )


def _digests(rows: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """The words at the places ``found`` of ``rows``, read at their source."""
    seek = F.collect_set(F.struct("start", "edges", "path", "again")).alias("seek")
    found = found.groupBy(*_PLACE).agg(seek)
    texts = _with_rows(rows, found, "inner")
    schema = extended(
        rows.select(*_PLACE), "start int, edges int, path long, digest binary, again boolean"
    )
    return written(texts.mapInArrow(partial(_read, window=window), schema), "digests")


def _again(edges: DataFrame) -> DataFrame:
    """Of single edges those whose words start at another place too."""
    counted = edges.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = edges.where("NOT again").select(*_PLACE, "start", "edges", "digest")
    return known.join(counted.select("digest").hint("merge"), "digest")


def repeated_spans(docs: DataFrame, window: int = 35, anchor: int = ANCHOR) -> DataFrame:
    """Where the texts of ``docs`` (``doc_id``, ``text``) hold repeated windows.

    A row for every document that has some: ``doc_id``, ``print`` (64-bit hash of the
    text) and ``spans``, an array of the word places ``first`` and ``end`` (exclusive),
    which may touch or overlap. A span is covered by windows of ``window`` words that
    also start elsewhere, in the same or another row. Words are runs between the six
    ASCII white-space characters. Null, empty and shorter texts have no window. Rows
    that agree in doc_id and text are documents of their own, which repeat each other
    and share a row here. An empty table gives an empty result.
    """
    spark, anchor, rows = docs.sparkSession, min(anchor, window), _rows(docs)
    shared = lasting(spark, "shared", lambda: _shared(rows, window, anchor))
    unlike = shared.where("NOT alike")
    place = F.struct(*_PLACE, "start", "edges")
    contents = unlike.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    contents = written(contents, "contents")
    unlike = unlike.join(contents.select("path", "n").hint("merge"), "path")
    unlike = written(unlike.select(*_PLACE, "start", "edges", "path", "n"), "unlike")
    columns = [*_PLACE, "start", "edges", "path"]
    repeated = shared.where("alike").select(columns).union(unlike.where("n > 1").select(columns))
    # the name of a compacted path: two that begin alike may go on differently
    name = F.xxhash64("path", "parts", "edges").alias("path")
    spans = lasting(
        spark, "spans", lambda: _compacted(repeated).select(*_PLACE, "start", "edges", name)
    )
    # edges of paths that occur once, and of one occurrence of each other path beside them
    loose = unlike.where("n = 1").select(*_PLACE, "start", "edges", F.lit(False).alias("again"))
    beside = contents.where("n > 1").select("one.*", F.lit(True).alias("again"))
    single = loose.union(beside).withColumn("path", F.lit(None).cast("long"))
    seek = single.unionByName(spans.withColumn("again", F.lit(False)))
    read = _digests(rows, seek, window)
    edges, whole = read.where("path IS NULL"), read.where("path IS NOT NULL")
    doubted = whole.groupBy("path").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high"), F.count(F.lit(1)).alias("n")
    )
    doubted, got = measured(
        doubted.where("low <> high OR n < 2").select("path"), "doubted", F.count(F.lit(1)).alias("rows")
    )
    if got["rows"]:
        # hashes collided: these spans are taken apart as well, beside all other edges
        apart = joined(spans, doubted, "path", "left_semi", got["rows"], 64)
        apart = apart.withColumn("path", F.lit(None).cast("long")).withColumn("again", F.lit(False))
        apart = _digests(rows, apart, window)
        other = apart.select(*[F.col(c).alias(f"_{c}") for c in (*_PLACE, "start")])
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        for c in ("print", "start"):
            same &= F.col(c) == F.col(f"_{c}")
        beside = edges.where("again").join(other.hint("merge"), same, "left_anti")
        edges = edges.where("NOT again").unionByName(beside).unionByName(apart)
        whole = joined(whole, doubted, "path", "left_anti", got["rows"], 64)
    gone = whole.select(*_PLACE, "start", "edges").union(_again(edges).select(*_PLACE, "start", "edges"))
    span = F.struct(
        F.col("start").alias("first"), (F.col("start") + F.col("edges") + window - 1).alias("end")
    )
    return gone.groupBy(*_PLACE).agg(F.collect_set(span).alias("spans"))


def without_repeats(docs: DataFrame, window: int = 35, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` added.

    ``kept_text`` has the words that no repeated window covers (see ``repeated_spans``),
    joined by one space; it is empty for null texts, and no occurrence of a repeated
    window stays, not the first one either. All rows and columns stay, but for columns
    of the three names, which are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    stamp, gone, own = (free_name(docs.columns, f"_{n}") for n in ("print", "spans", "id"))
    text = text_column(docs, "text")
    found = lasting(docs.sparkSession, "gone", lambda: repeated_spans(docs, window, anchor)).select(
        F.col("doc_id").alias(own), F.col("print").alias(stamp), F.col("spans").alias(gone)
    )
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(stamp))
    rows = text.join(found.hint("merge"), same, "left").drop(own, stamp)
    schema = extended(text, "n_words long, n_removed long, kept_text string")
    return rows.mapInArrow(partial(_cut, text="text", gone=gone), schema)

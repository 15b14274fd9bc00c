"""MinHash near-duplicates: one-permutation hashing with optimal densification,
banded buckets, star-shaped candidate edges.

Every text becomes a set of hashed word shingles. One sort of the set gives all
minima: the top bits of a hash choose the bin, the lowest hash of a bin is its value.
Empty bins borrow from another bin that a hash of (bin, attempt) names, the same for
every document. Bands of a few bins each are the buckets.

Within a bucket the first document is the centre and only centre-to-member edges are
compared, on the full sets. That finds all links of a bucket whose members form one
component, which nearly all do. A bucket whose members still lie in several
components gets further centres, more in each round, compared to members of other
components only, until every pair between different components has been compared or
cannot be similar enough by its sizes and sketches, which the join itself sees to.
So the pairs of a bucket grow with its size times its number of components, never
with the square of a group of copies, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headerwise.llm.common import (
    CACHE_WORDS,
    GOLDEN,
    by_batch,
    column_bytes,
    free_name,
    joined,
    mix,
    releasing,
    text_column,
)
from headerwise.llm.components import components
from headerwise.sources.scratch import stored, written

#: 32 bands of 4 bins: a pair of similarity 0.85 stays unseen once in 10^10, one of
#: 0.8 once in 10^7.
BANDS, ROWS = 32, 4

#: 64-bit words of a set's parity sketch.
SKETCH = 8

_SIGNED = "doc_id long, n_shingles int, set_id binary, bands array<long>, sketch array<long>"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, width: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``width`` words.

    A-Z are lowered and white space is the six ASCII characters. A shorter text is
    one shingle; null or a text without words has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > CACHE_WORDS:
        known.clear()
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    take = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - take + 1, take, np.uint64)
        for i in range(take):
            total = mix(total * GOLDEN + codes[i : len(codes) - take + 1 + i])
    return np.unique(total)


def _probes(bins: int, attempt: int) -> np.ndarray:
    """Which bin each empty bin looks at in this attempt."""
    at = np.arange(bins, dtype=np.uint64) + np.uint64(attempt * bins)
    return (mix((at + np.uint64(1)) * GOLDEN) % np.uint64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` minima for each non-empty set, without empty bins."""
    width = np.uint64(2**64 // bins)
    edges = np.arange(bins, dtype=np.uint64) * width
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, codes in enumerate(sets):
        at = np.searchsorted(codes, edges)
        inside = np.minimum(at, len(codes) - 1)
        least = codes[inside]
        full[i] = (at < len(codes)) & (least // width == np.arange(bins, dtype=np.uint64))
        out[i] = least
    filled = out.copy()
    row, col = np.nonzero(~full)
    attempt = 0
    while len(row):
        attempt += 1
        source = _probes(bins, attempt)[col]
        hit = full[row, source]
        filled[row[hit], col[hit]] = out[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return filled


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands))
        for r in range(rows):
            keys = mix(keys * GOLDEN + signature[:, r::rows])
    return keys.view(np.int64)


def sketch(codes: np.ndarray) -> np.ndarray:
    """One bit per residue of the codes: whether an odd number of them has it."""
    odd = np.bincount((codes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@releasing
def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int):
    known = WordHashes()
    for batch in by_batch(batches, 500):
        sets = [shingle_set(t, width, known) for t in column_bytes(batch, "text")]
        held = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if held:
            with np.errstate(over="ignore"):
                signed = signatures([sets[i] for i in held], bands * rows)
            for i, row in zip(held, band_keys(signed, bands, rows), strict=True):
                keys[i] = row
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "set_id", "bands", "sketch"],
        )


@releasing
def _sets(batches: Iterator[pa.RecordBatch], width: int):
    known = WordHashes()
    for batch in by_batch(batches, 500):
        codes = [shingle_set(t, width, known).tobytes() for t in column_bytes(batch, "text")]
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(codes, pa.binary())], names=["doc_id", "codes"]
        )


@releasing
def _linked(batches: Iterator[pa.RecordBatch], percent: int):
    for batch in by_batch(batches, 500):
        one, other = column_bytes(batch, "codes_a"), column_bytes(batch, "codes_b")
        keep = []
        for x, y in zip(one, other, strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((a, b))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * common >= percent * (len(a) + len(b) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are similar enough on their full sets."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("codes").alias(f"codes_{x}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    return both.select("a", "b", "codes_a", "codes_b").mapInArrow(
        partial(_linked, percent=percent), "a long, b long"
    )


def _possible(percent: int):
    """Whether two sets can be similar enough, by their sizes and parity sketches.

    Every shingle that one set has and the other has not flips one bit, so the sketches
    never differ in more bits than the sets do in shingles.
    """
    n, m = F.col("n"), F.col("n_a")
    bits = [F.bit_count(F.get("sketch", i).bitwiseXOR(F.get("sketch_a", i))) for i in range(SKETCH)]
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
        reduce(lambda x, y: x + y, bits) * (100 + percent) <= (n + m) * (100 - percent)
    )


def _star_pairs(rows: DataFrame, centres: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's centres and its members of other components, and the
    centres; ``rows`` has ``bucket, id, n, sketch, label, top``."""
    if centres == 1:
        first = rows.groupBy("bucket").agg(F.min("id").alias("c"))
        chosen = rows.join(first.hint("merge"), "bucket").where("id = c")
    else:
        # members outside the component ``top`` come first: when those are used up, the
        # rest is one component
        rank = Window.partitionBy("bucket").orderBy(F.col("label") == F.col("top"), "id", "n")
        chosen = rows.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= centres)
    chosen = chosen.select(
        "bucket", *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "sketch", "label")]
    )
    pairs = rows.join(chosen.hint("merge"), "bucket").where(
        (F.col("label") != F.col("label_a")) & _possible(percent)
    )
    pairs = pairs.select(F.least("id", "id_a").alias("a"), F.greatest("id", "id_a").alias("b"))
    return pairs.distinct(), chosen


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose members lie in several components."""
    rows = rows.select("bucket", "id", "n", "sketch").join(labels.hint("merge"), "id", "left")
    rows = rows.withColumn("label", F.coalesce("component", "id")).drop("component")
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("top"))
    mixed = mixed.where("low != top").select("bucket", "top")
    return rows.join(mixed.hint("merge"), "bucket")


def _star_labels(
    docs: DataFrame, copies: DataFrame, buckets: DataFrame, width: int, percent: int
) -> DataFrame:
    """Components of ``copies`` and of all links among rows ``(bucket, id, n, sketch)``."""
    nodes = stored(buckets.select("id").distinct(), "minhash-nodes")
    members = joined(
        docs.select("doc_id", "text"),
        nodes.table.withColumnRenamed("id", "doc_id"),
        "doc_id",
        "left_semi",
        nodes.rows,
        64,
    )
    # a document number that is used for several texts stands for all of them
    sets = written(
        members.mapInArrow(partial(_sets, width=width), "doc_id long, codes binary").distinct(),
        "minhash-sets",
    )
    links, labels, centres = copies, None, 1
    rows = buckets.withColumns({"label": F.col("id"), "top": F.col("id")})
    while True:
        pairs, chosen = _star_pairs(rows, centres, percent)
        found = stored(_verified(pairs, sets, percent), "minhash-links")
        if labels is None or found.rows:
            labels = components(links.union(found.table))
            links = labels.select("component", "id")
        used = chosen.select("bucket", F.col("id_a").alias("id"), F.col("n_a").alias("n"))
        rest = rows.join(used.hint("merge"), ["bucket", "id", "n"], "left_anti")
        left = stored(_open(rest, labels), "minhash-open")
        if not left.rows:
            return labels
        rows, centres = left.table, 32 * centres


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Components of near-duplicate texts among rows with ``doc_id`` and ``text``.

    Returns a row for every row: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest doc_id that can be reached, itself included) and ``kept`` (whether that
    is its own). Two texts are linked when ``100 * common >= percent * all`` holds
    for their sets of shingles of ``width`` words.

    Texts without words (null, empty, white space) have an empty set and are linked
    with nothing. Rows that share a doc_id are one document: a link of any of them
    counts for it. A null doc_id is linked with nothing, has a null component and is
    kept. Other columns, whatever their names, are not read. An empty table gives an
    empty result.
    """
    docs = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text")
    signed = written(
        docs.mapInArrow(partial(_sign, width=width, bands=bands, rows=rows), _SIGNED),
        "minhash-signed",
    )
    held = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets are one node, under the smallest doc_id that has the set
    nodes = written(
        held.groupBy("set_id").agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "minhash-classes",
    )
    copies = held.select("set_id", "doc_id").join(
        nodes.select("set_id", "id").hint("merge"), "set_id"
    )
    copies = copies.where("doc_id != id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    rows_of = nodes.select("id", "n", "sketch", F.explode("bands").alias("bucket"))
    shared = rows_of.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(
        rows_of.join(shared.select("bucket").hint("merge"), "bucket").select("bucket", "id", "n", "sketch"),
        "minhash-buckets",
    )
    labels = _star_labels(docs, copies, buckets, width, percent).withColumnRenamed("id", "doc_id")
    return (
        signed.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"))
        .join(labels.hint("merge"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.expr("component_id <=> doc_id"))
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest doc_id.

    All its columns stay as they are. Rows that share a doc_id stay or go together,
    rows with a null doc_id stay.
    """
    found = near_duplicates(docs, width, percent)
    own = free_name(docs.columns, "_gone")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(own), "left_anti")

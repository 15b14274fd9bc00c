"""Counting frequent keys by their hash first, so that rare texts are never shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerwise.operators.top_terms import COUNT, WEIGHT, term_counts
from headerwise.sources.scratch import Stored, stored

_HASH = "_hash"


def key_hash(keys: Sequence[str]) -> Column:
    """64 bits of all keys; NULLs count as a place of their own."""
    return F.xxhash64(*[part for k in keys for part in (F.col(k), F.isnull(k))])


def frequent_hashes(rows: DataFrame, keys: Sequence[str], least: int) -> Stored:
    """Hashes of the keys that have ``least`` rows or more: 16 bytes a key are shuffled.

    Keys that share a hash are counted together, so none that is frequent is missing.
    """
    weight = [WEIGHT] if WEIGHT in rows.columns else []
    counts = term_counts(rows.select(key_hash(keys).alias(_HASH), *weight), [_HASH])
    return stored(counts.where(F.col(COUNT) >= least).select(_HASH), "frequent-hashes")


def frequent_counts(
    rows: DataFrame, parents: Sequence[str], column: str, frequent: Stored
) -> DataFrame:
    """Exact counts per ``parents`` and ``column``, where rows of rare values count
    under NULL, so that the parents' counts are those of all rows.

    A value is rare when the hash of its key is not among the ``frequent`` ones. Those
    that share a hash with a frequent one keep their own count.
    """
    keys = [*parents, column]
    rows = rows.withColumn("_key", key_hash(keys))
    known = F.broadcast(frequent.table)
    rows = rows.join(known, F.col("_key") == F.col(_HASH), "left")
    value = F.when(F.col(_HASH).isNotNull(), F.col(column)).alias(column)
    weight = [WEIGHT] if WEIGHT in rows.columns else []
    return term_counts(rows.select(*parents, value, *weight), keys)

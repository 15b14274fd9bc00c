"""Counting the rows whose keys occur in a small table, without shuffling raw rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerwise.operators.joins import measured_join
from headerwise.operators.top_terms import term_counts
from headerwise.sources.scratch import Stored, written

#: 64-bit groups of the filter for many keys: 1 << 20 of them take under 64 MB.
SLOTS = 1 << 20


def hash_members(rows: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose keys occur in ``members``, and a few strangers that share a hash."""
    hashes = F.broadcast(members.select(F.xxhash64(*on).alias("_hash")))
    return rows.join(hashes, F.xxhash64(*on) == F.col("_hash"), "left_semi")


def filtered_members(rows: DataFrame, members: Stored, on: Sequence[str]) -> DataFrame:
    """The rows whose keys occur in ``members``, and strangers.

    Hashes that are measured to fit are broadcast; few strangers share one. Of more keys
    each sets one bit of a filter of bounded size: as many strangers get through as bits
    are set. With more keys than bits all rows are left to the join that follows.
    """
    if members.number_fits_broadcast():
        return hash_members(rows, members.table, on)
    if members.rows > 64 * SLOTS:
        return rows
    key = F.xxhash64(*on)
    slot = F.pmod(F.shiftright(key, 6), F.lit(SLOTS))
    keys = members.table.select(key.alias("_hash"), slot.alias("_slot"))
    bit = F.expr("shiftleft(1L, CAST(_hash & 63 AS INT))")
    bits = written(keys.groupBy("_slot").agg(F.bit_or(bit).alias("_bits")), "members")
    found = rows.withColumns({"_hash": key, "_slot": slot}).join(F.broadcast(bits), "_slot")
    return found.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def member_counts(
    rows: DataFrame, by: Sequence[str], members: Stored, on: Sequence[str]
) -> DataFrame:
    """``term_counts`` of the rows whose ``on`` columns occur in ``members``.

    A member table that was measured to be small filters each task's rows by a
    broadcast semi join. If only 64-bit hashes of its keys are small enough, these
    are broadcast: the few strangers that share a hash fall out in the exact join
    after the aggregation. A bigger table is joined after the aggregation only, so
    that neither raw rows nor a hot key's rows are ever shuffled for a join.
    """
    keys = members.table.select(*on)
    if members.fits_broadcast():
        return term_counts(measured_join(rows, keys, on, "left_semi", True), by)
    if members.number_fits_broadcast():
        rows = hash_members(rows, keys, on)
    return measured_join(term_counts(rows, by), keys, on, "left_semi", False)

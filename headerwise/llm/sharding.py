"""Shards that all have the corpus's mixture of sources, by stratified interleaving.

The rows of each source get ranks in a seeded shuffled order. Their fractional ranks
spread every source evenly over 0 to 1, so sorting all rows by it interleaves the
sources in proportion, and equal cuts of that order are the shards. Ranks come from
small ordered cells, each sorted by a task of its own, plus the sizes of the cells
before: no source, however large, is sorted or held in one place.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerwise.llm.common import free_name, joined
from headerwise.sources.scratch import stored, written

#: Fewest rows per cell, on average. A cell is what one task sorts at a time; with the
#: square root of all rows neither the cells nor their number grow out of hand.
CELL_ROWS = 1000
_FRACTION = 1 << 52
#: Seed of the sources' offsets, which keep small sources from meeting in one cell.
OFFSET_SEED = 1


def shuffle_key(seed: int, *columns: str) -> Column:
    """Hexadecimal text that orders rows at random, the same in every run."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _fraction_of(key: Column) -> Column:
    """The first 52 bits of the key as a number from 0 to below 1; keeps its order."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(_FRACTION))


def _fraction(key: str) -> Column:
    return _fraction_of(F.col(key))


def _numbered(rows: DataFrame, group: list[str], cell: str, order: list, out: str) -> DataFrame:
    """Adds ``out``: the number of rows of the group before the row, in cell order and
    then in ``order``, counted from 0."""
    by = [*group, cell]
    keys = [free_name(rows.columns, f"_k{i}") for i in range(len(by))]
    sum_before, size = free_name(rows.columns, "_before"), free_name(rows.columns, "_size")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(sum_before, F.coalesce(F.sum(size).over(before), F.lit(0)))
    sizes = sizes.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], sum_before)
    ranked = rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    return (
        ranked.join(sizes.hint("merge"), same, "left")
        .withColumn(out, F.col(out) - 1 + F.col(sum_before))
        .drop(sum_before, *keys)
    )


def interleaved_shards(
    docs: DataFrame,
    shards: int,
    key: Column,
    ties: list[str],
    source: str = "source",
    cell_rows: int | None = None,
) -> DataFrame:
    """Adds ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, gapless from 0 in
    each shard) to ``docs``.

    ``key`` is the seeded shuffle order as hexadecimal text, such as ``shuffle_key``;
    rows of equal keys go by ``ties``. The numbers of rows of two shards differ by at
    most one, and so do, but for rounding at both cuts, those of each source. A null
    source is a source of its own. Rows that agree in key and ties are alike, and it
    does not matter which of them gets which place. Columns of the names ``shard`` and
    ``slot`` are replaced, all others stay. An empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot")
    stratum, order_by, part, cell, rank, total, place = (
        free_name(docs.columns, f"_{n}")
        for n in ("stratum", "key", "part", "cell", "rank", "total", "place")
    )
    rows = docs.withColumn(stratum, F.col(source)).withColumn(order_by, key)
    rows = rows.withColumn(part, _fraction(order_by))
    counted = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias(total))
    strata = stored(counted, "strata")
    n = strata.table.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]
    own = free_name([*rows.columns, total], "_s")
    sizes = strata.table.withColumnRenamed(stratum, own)
    cell_rows = cell_rows or max(CELL_ROWS, isqrt(n))
    # texts of source names count, too
    row_bytes = 100 + strata.text_bytes // max(1, strata.rows)
    rows = joined(
        rows, sizes, F.col(stratum).eqNullSafe(F.col(own)), "inner", strata.rows, row_bytes
    ).drop(own)
    cells = F.ceil(F.col(total) / F.lit(cell_rows))
    rows = rows.withColumn(cell, F.floor(F.col(part) * cells).cast("long"))
    rows = _numbered(rows, [stratum], cell, [order_by, *ties], rank)
    # a place in each row's share of its source, another for each source
    offset = _fraction_of(shuffle_key(OFFSET_SEED, stratum))
    rows = rows.withColumn(part, (F.col(rank) + offset) / F.col(total))
    rows = rows.withColumn(
        cell, F.floor(F.col(part) * F.lit(max(1, -(-n // cell_rows)))).cast("long")
    )
    rows = _numbered(rows, [], cell, [part, order_by, F.col(stratum).asc_nulls_first(), *ties], place)
    shard = F.expr(f"{place} * {shards} div {max(1, n)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return (
        rows.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col(place) - first).cast("long"))
        .drop(stratum, order_by, part, cell, rank, total, place)
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order over its files."""
    shards = sharded.select(F.max("shard")).first()[0] or 0
    placed = sharded.repartitionByRange(max(8, 8 * (shards + 1)), "shard", "slot")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digests(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """Where each document goes: ``doc_id``, ``size`` (UTF-8 bytes of the text, none for
    null, plus 1), ``text_crc32``, ``law`` (``rows``: the numbers of rows of two shards
    differ by at most one), ``shard``, ``slot``, ``grown_shard`` (null: the law says
    nothing about more shards), ``source``.

    The text itself is not moved, only what is returned. Null texts have the checksum
    of no bytes. Repeated rows each get a place. Other columns are not read.
    """
    binary = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(binary) + 1).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
        F.col("source").cast("string").alias("source"),
    )
    # read once: the places depend on counts of the same rows
    rows = written(rows, "shard-rows")
    key = shuffle_key(seed, "doc_id", "text_crc32")
    placed = interleaved_shards(rows, shards, key, ["doc_id", "size"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )

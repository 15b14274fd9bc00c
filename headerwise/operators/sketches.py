"""A first look at frequent terms: bounded counters per task, with an error bound.

Each task keeps at most ``counters`` terms. When it has more, the count of the first
one too many, by size, is taken from all, and the terms that reach zero go (the batch
form of the Misra-Gries summary, whose parts can be added up). So a term's count is too
low by at most what its tasks took away, together at most rows / (counters + 1).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.operators.top_terms import COUNT, WEIGHT

#: Terms that a task keeps. One in 10,000 rows is then found for certain.
COUNTERS = 10_000
LOST = "lost"


def _added(parts: Sequence[pa.Table], keys: list[str]) -> pa.Table:
    """One row per term, the counts of all parts added up."""
    table = pa.concat_tables(parts).group_by(keys).aggregate([(COUNT, "sum")])
    return table.rename_columns([COUNT if c == f"{COUNT}_sum" else c for c in table.column_names])


def _reduced(table: pa.Table, counters: int) -> tuple[pa.Table, int]:
    """At most ``counters`` terms, and what was taken from each count."""
    if table.num_rows <= counters:
        return table, 0
    counts = table.column(COUNT)
    first_out = pc.select_k_unstable(counts, counters + 1, [("x", "descending")])[counters]
    taken = counts[first_out.as_py()].as_py()
    left = pc.subtract(counts, taken)
    table = table.set_column(table.column_names.index(COUNT), COUNT, left)
    return table.filter(pc.greater(left, 0)), taken


def _count(batches: Iterator[pa.RecordBatch], keys: list[str], counters: int, weighted: bool):
    kept, lost = None, 0
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not weighted:
            part = part.append_column(COUNT, pa.array([1] * len(part), pa.int64()))
        both = _added([part] if kept is None else [kept, part], keys)
        kept, taken = _reduced(both, counters)
        lost += taken
    if kept is not None:
        fields = [pa.field(k, kept.schema.field(k).type) for k in keys]
        schema = pa.schema([*fields, pa.field(COUNT, pa.int64()), pa.field(LOST, pa.int64())])
        columns = [kept.column(c).combine_chunks() for c in [*keys, COUNT]]
        none = pa.nulls(len(kept), pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, none], schema=schema)
        # one more row says what this task took from each count
        blank = [pa.nulls(1, f.type) for f in fields]
        row = [*blank, pa.nulls(1, pa.int64()), pa.array([lost], pa.int64())]
        yield pa.RecordBatch.from_arrays(row, schema=schema)


def term_sketch(rows: DataFrame, by: Sequence[str], counters: int = COUNTERS) -> DataFrame:
    """The sketch as a table: ``by``, ``count``, and rows with only ``lost``.

    Sketches of parts of the log, such as days, are merged by ``unionAll``. NULL is a
    term of its own; rows that stand for several count as many times.
    """
    if counters < 1:
        raise ValueError("counters must be at least 1")
    keys, weighted = list(by), WEIGHT in rows.columns
    weight = [F.col(WEIGHT).cast("long").alias(COUNT)] if weighted else []
    rows = rows.select(*keys, *weight)
    numbers = [T.StructField(c, T.LongType()) for c in (COUNT, LOST)]
    schema = T.StructType([*[rows.schema[k] for k in keys], *numbers])
    count = partial(_count, keys=keys, counters=counters, weighted=weighted)
    return rows.mapInArrow(count, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def sketched_terms(sketch: DataFrame, by: Sequence[str], min_count: int = 1) -> DataFrame:
    """``by, count, error`` of the terms that may have ``min_count`` rows or more.

    The true number of rows is from ``count`` to ``count + error``; ``error`` is the same
    for all. Every term of more than ``error`` rows is among them. The error is added up
    by a job of its own: pass a written sketch.
    """
    error = sketch.agg(F.coalesce(F.sum(LOST), F.lit(0))).first()[0]
    counts = sketch.where(F.col(COUNT).isNotNull()).groupBy(*by).agg(F.sum(COUNT).alias(COUNT))
    found = counts.where(F.col(COUNT) + F.lit(error) >= min_count)
    return found.withColumn("error", F.lit(error).cast("long"))

"""Frequent terms: one level, or nested levels with a top-K and a minimum each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNT = "count"
#: A column of this name says how many rows of the log a row stands for.
WEIGHT = "_rows"
_SALTS = 64


def term_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per combination of values; NULL is a value of its own."""
    count = F.sum(WEIGHT) if WEIGHT in rows.columns else F.count(F.lit(1))
    return rows.groupBy(*by).agg(count.alias(COUNT))


def top_terms(rows: DataFrame, column: str, size: int, min_count: int) -> DataFrame:
    """The ``size`` most frequent values with at least ``min_count`` rows."""
    return (
        term_counts(rows.where(F.col(column).isNotNull()), [column])
        .where(F.col(COUNT) >= min_count)
        .orderBy(F.desc(COUNT), F.asc(column))
        .limit(size)
    )


def missing_counts(rows: DataFrame, column: str, by: Sequence[str], more_than: int) -> DataFrame:
    """Rows without a value in ``column`` per combination, where there are more
    than ``more_than`` (strictly) of them."""
    lacking = rows.where(F.col(column).isNull())
    for key in by:
        lacking = lacking.where(F.col(key).isNotNull())
    return term_counts(lacking, by).where(F.col(COUNT) > more_than)


@dataclass(frozen=True)
class Level:
    """One nesting level: its column, how many terms each parent keeps, and the
    least count of a term. Both numbers may be names of columns of the input."""

    column: str
    size: int | str
    min_count: int | str
    # last level only: keep the count of rows without a value, if above min_count
    missing: bool = False

    def __post_init__(self) -> None:
        for value in (self.size, self.min_count):
            if isinstance(value, int) and value < 1:
                raise ValueError("size and min_count must be at least 1")


def _number(value: int | str) -> Column:
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _with_rank(
    nodes: DataFrame, group: list[str], order: list[Column], largest: int | None
) -> DataFrame:
    """Keep ``_rank <= _size`` per group without gathering a group in one task.

    With a literal limit Spark ranks inside each task first (window group limit)
    and only shuffles the survivors. Beyond the limit that rule accepts, the same
    is done by ranking salted slices of each group before ranking the group.
    """
    spark = nodes.sparkSession
    threshold = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))

    def ranked(rows: DataFrame, by: list[str], within: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_rank", place).where(within)

    within = F.col("_rank") <= F.col("_size")
    if largest is not None and largest <= threshold:
        return ranked(nodes, group, within & (F.col("_rank") <= largest))
    sliced = nodes.withColumn("_salt", F.pmod(F.xxhash64("_term"), F.lit(_SALTS)))
    return ranked(ranked(sliced, [*group, "_salt"], within), group, within).drop("_salt")


def nested_top_terms(
    counts: DataFrame,
    parents: Sequence[str],
    levels: Sequence[Level],
    largest: int | None = None,
    ranks: bool = False,
) -> DataFrame:
    """Frequent terms of each level inside the surviving terms of the level above.

    ``counts`` has one row per distinct (parents, level columns) with its
    ``count``; NULLs included, because a term counts all its rows, also those that
    lack a value further down. A term survives when its count reaches the level's
    minimum and it ranks among the ``size`` most frequent of its parent (ties:
    smaller term first), and its parent survives. Returns the last level's rows;
    with ``ranks`` also the rank of every level as ``<column>_rank``.

    ``largest`` bounds the sizes that come from columns, if the caller knows it.

    All levels are built from the one pre-aggregated input in one pass: each row
    becomes a contribution to every level, last-level rows below the minimum are
    dropped before anything is shuffled, and upper levels collapse map-side.
    Ranking and the survival of parents then only see frequent terms.
    """
    path = [level.column for level in levels]
    depth = len(levels)
    types = {f.name: f.dataType for f in counts.schema}
    literal = [level.size for level in levels if isinstance(level.size, int)]
    if len(literal) < depth:
        largest = None if largest is None else max([largest, *literal])
    else:
        largest = max(literal)

    def contribution(i: int) -> Column:
        level = levels[i]
        terms = [
            (F.col(c) if j <= i else F.lit(None).cast(types[c])).alias(c)
            for j, c in enumerate(path)
        ]
        missing = F.col(level.column).isNull() if level.missing else F.lit(False)
        return F.struct(
            F.lit(i + 1).alias("_level"),
            *terms,
            missing.alias("_missing"),
            _number(level.size).cast("long").alias("_size"),
            _number(level.min_count).cast("long").alias("_floor"),
        )

    frequent = F.when(F.col("_missing"), F.col(COUNT) > F.col("_floor")).otherwise(
        F.col(COUNT) >= F.col("_floor")
    )
    has_terms = [
        (F.col("_level") <= i) | F.col(c).isNotNull() | (F.col("_missing") & F.lit(i == depth - 1))
        for i, c in enumerate(path)
    ]
    useful = reduce(lambda a, b: a & b, has_terms) & ((F.col("_level") < depth) | frequent)
    above = {
        f"_above_{c}": F.when(F.col("_level") > i + 1, F.col(c)) for i, c in enumerate(path[:-1])
    }
    nodes = (
        counts.select(
            *parents, COUNT, F.inline(F.array(*[contribution(i) for i in range(depth)]))
        )
        .where(useful)
        .groupBy(*parents, "_level", *path, "_missing", "_size", "_floor")
        .agg(F.sum(COUNT).alias(COUNT))
        .where(frequent)
        .withColumns({**above, "_term": F.coalesce(*[F.col(c) for c in reversed(path)])})
    )
    nodes = _with_rank(
        nodes,
        [*parents, "_level", *above, "_missing"],
        [F.desc(COUNT), F.asc("_term")],
        largest,
    )

    # Survival of the parents, lowest parent first: by then a group holds one
    # parent and its few ranked descendants.
    kept = [F.when(F.col("_missing"), 0).otherwise(F.col("_rank")).alias(f"{path[-1]}_rank")]
    for i in range(depth - 1, 0, -1):
        family = Window.partitionBy(*parents, *path[:i])
        own_rank = F.max(F.when(F.col("_level") == i, F.col("_rank"))).over(family)
        name = f"{path[i - 1]}_rank"
        nodes = nodes.withColumn(name, own_rank).where(
            (F.col("_level") < i) | ((F.col("_level") > i) & F.col(name).isNotNull())
        )
        kept.insert(0, F.col(name))
    return nodes.select(*parents, *path, COUNT, *(kept if ranks else []))

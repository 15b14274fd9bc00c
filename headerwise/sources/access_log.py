"""The access-log table: one row per request, partitioned by ``index_date``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headerwise.functions.index_names import (
    as_names,
    default_index,
    has_wildcard,
    in_index,
    index_day,
    matches_day,
)
from headerwise.schemas import ACCESS_LOG


def select_index(
    logs: DataFrame, index: str | Sequence[str] | None = None, as_of: dt.date | None = None
) -> DataFrame:
    """Rows of the named daily indices; yesterday's when none is named."""
    return logs.where(in_index(index or default_index(as_of), F.col("index_date")))


def check_index(
    logs: DataFrame, index: str | Sequence[str] | None = None, as_of: dt.date | None = None
) -> None:
    """An error unless every named day, and at least one day of all patterns, has rows.

    One job for all names; it reads no column, only the numbers of rows.
    """
    names = as_names(index or default_index(as_of))
    days = days_of(logs.where(in_index(names, F.col("index_date"))))
    absent = [n for n in names if not has_wildcard(n) and index_day(n) not in days]
    patterns = [n for n in names if has_wildcard(n)]
    if patterns and not any(matches_day(n, d) for n in patterns for d in days):
        absent += patterns
    if absent:
        raise ValueError(f"no such index: {', '.join(absent)}")


def days_of(logs: DataFrame) -> list[dt.date]:
    """The days that have rows, in order."""
    return sorted(row[0] for row in logs.select("index_date").distinct().collect())


def read_access_log(
    spark: SparkSession,
    root: str,
    index: str | Sequence[str] | None = None,
    as_of: dt.date | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    logs = spark.read.schema(ACCESS_LOG).format(fmt).load(root)
    return select_index(logs, index, as_of)

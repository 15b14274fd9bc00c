"""Daily rollups of the access log: exact counts per day, so that a selection of many
days reads raw rows only for the days that are not rolled up yet.

Counts of all keys are kept, so results from them equal those from the raw rows. A day
counts as rolled up once its mark is there; a run that was lost on the way leaves files
without a mark, which nobody reads, and the day is counted again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.operators.top_terms import WEIGHT
from headerwise.schemas import REQUEST_KEYS, URL_KEYS
from headerwise.settings import INDEX_PREFIX
from headerwise.sources.access_log import days_of, read_access_log, select_index
from headerwise.sources.marks import mark_names, put_mark

#: The counted keys by the name of their level.
LEVELS = {"requests": REQUEST_KEYS, "urls": URL_KEYS}

_MARKS, _COUNTS = "_days", "counts"


def rolled_days(spark: SparkSession, path: str) -> dict[dt.date, str]:
    """The days that are rolled up, each with the run that has its counts."""
    found = {}
    for name in mark_names(spark, f"{path}/{_MARKS}"):  # a later run of a day comes later
        day, _, run = name.split(".")
        found[dt.date.fromisoformat(day)] = run
    return found


def _level_path(path: str, run: str, level: str) -> str:
    return f"{path}/{_COUNTS}/run={run}/level={level}"


def _write_level(counts: DataFrame, path: str, run: str, level: str) -> None:
    """Laid out by day and domain, so that later scans skip files and row groups."""
    keys = ["index_date", "domain", "request", "method", "ipport"]
    counts.repartitionByRange(*keys[:3]).sortWithinPartitions(*keys).write.partitionBy(
        "index_date"
    ).parquet(_level_path(path, run, level))


def roll_up(
    spark: SparkSession,
    root: str,
    path: str,
    index: str | Sequence[str] = INDEX_PREFIX + "*",
    before: dt.date | None = None,
    redo: bool = False,
) -> list[dt.date]:
    """Count the days of the log at ``root`` that the rollup at ``path`` lacks.

    All of them are counted by one job, whose shuffle carries counts. Days from
    ``before`` on (today in UTC when not given) are left out, as rows may still come.
    With ``redo`` the days are counted anew and replace what was there. Returns the
    days that were counted.
    """
    before = before or dt.datetime.now(dt.timezone.utc).date()
    logs = read_access_log(spark, root, index)
    known = {} if redo else rolled_days(spark, path)
    days = [d for d in days_of(logs) if d < before and d not in known]
    if not days:
        return []
    run = uuid.uuid4().hex
    counts = logs.where(F.col("index_date").isin(days)).groupBy("index_date", *REQUEST_KEYS)
    _write_level(counts.agg(F.count(F.lit(1)).alias(WEIGHT)), path, run, "requests")
    # the second level comes from the first, which is on disk by now
    counts = _read_level(spark, path, dict.fromkeys(days, run), "requests")
    counts = counts.groupBy("index_date", *URL_KEYS).agg(F.sum(WEIGHT).alias(WEIGHT))
    _write_level(counts, path, run, "urls")
    marks = mark_names(spark, f"{path}/{_MARKS}")
    number = 1 + max((int(name.split(".")[1]) for name in marks), default=0)
    for day in days:
        put_mark(spark, f"{path}/{_MARKS}", f"{day.isoformat()}.{number:010d}.{run}")
    return days


def _read_level(
    spark: SparkSession, path: str, days: dict[dt.date, str], level: str
) -> DataFrame:
    text = [T.StructField(c, T.StringType()) for c in LEVELS[level]]
    schema = T.StructType(
        [*text, T.StructField(WEIGHT, T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("run", "level")]
        + [T.StructField("index_date", T.DateType())]
    )
    folders = [
        f"{_level_path(path, run, level)}/index_date={day.isoformat()}" for day, run in days.items()
    ]
    rows = spark.read.schema(schema).option("basePath", f"{path}/{_COUNTS}").parquet(*folders)
    return rows.select(*LEVELS[level], WEIGHT, "index_date")


def rolled_log(
    spark: SparkSession,
    root: str,
    path: str,
    index: str | Sequence[str] | None = None,
    as_of: dt.date | None = None,
    level: str = "requests",
) -> DataFrame:
    """The selected days as rows that each stand for a number of raw rows.

    Days that are rolled up come as their counts, the others from the raw log, whose
    folders are the only ones that are listed and read. The result can be given to
    ``domain_list``, ``top_urls``, ``top_requests`` and ``missing_counts`` in the place
    of the log; ``level`` ``urls`` has fewer rows and lacks agents and referers.
    """
    logs = read_access_log(spark, root, index, as_of)
    days = rolled_days(spark, path)
    if days:
        logs = logs.where(~F.col("index_date").isin(list(days)))
    rows = logs.select(*LEVELS[level], F.lit(1).cast("long").alias(WEIGHT), "index_date")
    if not days:
        return rows
    # names and patterns select the days of the rollup by the same predicate
    rolled = _read_level(spark, path, days, level)
    return rows.unionByName(select_index(rolled, index, as_of))

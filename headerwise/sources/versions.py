"""A folder that is replaced in one step: versions, and a mark that names the current one.

A new version is written beside the others and counts once its mark is there. Until
then, and after an error on the way, readers see the version before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from headerwise.sources.marks import mark_names, put_mark, remove_mark
from headerwise.sources.scratch import remove_folder

_CURRENT = "_current"


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the complete versions, the current one last."""
    return [f"{path}/version={name}" for name in mark_names(spark, f"{path}/{_CURRENT}")]


def current_version(spark: SparkSession, path: str) -> str | None:
    return (versions(spark, path) or [None])[-1]


def write_version(
    df: DataFrame, path: str, write: Callable[[DataFrame, str], None], keep: int = 1
) -> str:
    """Write a version with ``write(df, folder)`` and make it the current one.

    ``df`` may read the version it replaces. Of the earlier ones the last ``keep`` stay
    for readers that have begun; what unfinished writers left is not removed, as they
    may still be at work. Of writers at the same time the higher name wins.
    """
    spark, folder = df.sparkSession, f"{path}/{_CURRENT}"
    before = mark_names(spark, folder)
    number = int(before[-1].split("-")[0]) + 1 if before else 1
    name = f"{number:010d}-{uuid.uuid4().hex}"
    write(df, f"{path}/version={name}")
    put_mark(spark, folder, name)
    for old in before[: max(0, len(before) - keep)]:
        remove_mark(spark, folder, old)
        remove_folder(spark, f"{path}/version={old}")
    return f"{path}/version={name}"

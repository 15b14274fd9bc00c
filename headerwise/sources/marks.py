"""Commit marks: empty files whose names say what is complete.

Creating an empty file is one step in every store, so a reader sees a mark or does not;
it never sees half of one. Data is written first, under a name that nobody knows yet.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from headerwise.sources.scratch import file_system


def put_mark(spark: SparkSession, folder: str, name: str) -> None:
    files, at = file_system(spark, f"{folder}/{name}")
    files.mkdirs(at.getParent())
    files.create(at, True).close()


def remove_mark(spark: SparkSession, folder: str, name: str) -> None:
    files, at = file_system(spark, f"{folder}/{name}")
    files.delete(at, False)


def mark_names(spark: SparkSession, folder: str) -> list[str]:
    """The marks of a folder in the order of their names, by one listing."""
    files, at = file_system(spark, folder)
    if not files.exists(at):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isFile())

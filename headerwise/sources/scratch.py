"""Intermediate tables in the shared folder of the cluster, and their size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.settings import BROADCAST_BYTES


_RUN: ContextVar[str] = ContextVar("headerwise_run", default="")


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="headerwise-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_folder(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of the block are removed at its end, also after an error.

    What the block returns must be written or read before that.
    """
    folder = f"{shared_folder(spark)}/headerwise/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        remove_folder(spark, folder)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


def new_path(spark: SparkSession, name: str) -> str:
    folder = _RUN.get() or f"{shared_folder(spark)}/headerwise"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Stored:
    """A written table with its measured number of rows and bytes of text."""

    table: DataFrame
    rows: int
    text_bytes: int

    def fits_broadcast(self, limit: int = BROADCAST_BYTES) -> bool:
        # per row: the text itself and about 100 bytes of row and hash-map overhead
        return self.text_bytes + 100 * self.rows <= limit

    def number_fits_broadcast(self, limit: int = BROADCAST_BYTES) -> bool:
        # per row: one 64-bit key in a compact map, less than 64 bytes in all
        return 64 * self.rows <= limit


def measured(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` once, taking the aggregates ``measures`` on the way, and read it
    back: later jobs neither recompute it nor depend on the executors that did.

    A task that is repeated may be measured twice, so sizes are upper bounds.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    seen = Observation()
    (df.observe(seen, *measures) if measures else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if measures else {}


def written(df: DataFrame, name: str) -> DataFrame:
    return measured(df, name)[0]


def stored(df: DataFrame, name: str) -> Stored:
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    table, size = measured(
        df,
        name,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(length.cast("long")), F.lit(0)).alias("text_bytes"),
    )
    return Stored(table, size["rows"], size["text_bytes"])

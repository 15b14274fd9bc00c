"""What several operators share: small joins, positions, random numbers, batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.settings import BROADCAST_BYTES
from headerwise.sources.scratch import new_path, scratch_run

#: Python words an interpreter keeps for reuse before it starts over.
CACHE_WORDS = 400_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(left: DataFrame, right: DataFrame, on, how: str, rows: int, row_bytes: int) -> DataFrame:
    """Join with the small side broadcast only when its counted rows are known to fit;
    otherwise both sides are shuffled, whatever the optimizer would guess."""
    small = rows * row_bytes <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def lasting(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes, as a written table; tables written on the way are removed."""
    path = new_path(spark, name)
    with scratch_run(spark):
        rows = build()
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def shipped(spark: SparkSession, value) -> Broadcast:
    """A value of bounded size for the Python workers, with its class if it is ours."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(value: Broadcast):
    return pickle.loads(value.value)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column_text(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def text_column(docs: DataFrame, name: str) -> DataFrame:
    """The column as text, whatever it is called or typed."""
    if not isinstance(docs.schema[name].dataType, T.StringType):
        docs = docs.withColumn(name, F.col(name).cast("string"))
    return docs


def extended(rows: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``rows`` with the columns of ``ddl`` added."""
    return T.StructType([*rows.schema.fields, *T.StructType.fromDDL(ddl).fields])


def free_name(taken: Sequence[str], wish: str) -> str:
    """``wish``, or it with underscores put before it, so that it clashes with no column."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish = f"_{wish}"
    return wish


def by_batch(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, to bound what a step holds."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def releasing(step: Callable) -> Callable:
    """``step`` over batches that gives Arrow's memory back at its end: an idle worker
    would otherwise keep that of its largest batches beside the stages that follow."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch], *args, **named) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches, *args, **named)
        finally:
            pa.default_memory_pool().release_unused()

    return run

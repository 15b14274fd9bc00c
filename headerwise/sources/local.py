"""Small driver-side rows as a table whose size the optimizer knows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(
    spark: SparkSession, schema: T.StructType, rows: Iterable[Sequence[object]]
) -> DataFrame:
    """Arrow input becomes a local relation: no Python worker runs, and joins see
    the true size instead of the default of an unknown RDD."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(values, field.type) for values, field in zip(columns, arrow, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)

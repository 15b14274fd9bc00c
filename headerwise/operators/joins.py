"""Joins whose broadcasts are decided by measured sizes only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measured_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str, fits: bool
) -> DataFrame:
    """Broadcast ``right`` if it was measured to fit; otherwise shuffle both sides.

    Without the second hint Spark would decide by compressed file sizes, which say
    little about the rows.
    """
    right = F.broadcast(right) if fits else right.hint("merge")
    return left.join(right, on if isinstance(on, str) else list(on), how)

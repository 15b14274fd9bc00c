"""From single captured responses to one row per request with both sides' headers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column of a header set: the side it comes from and the round.
SLOTS = {
    "headers_prod_1st": ("prod", 1),
    "headers_test_1st": ("test", 1),
    "headers_prod": ("prod", 2),
    "headers_test": ("test", 2),
}
COMPARED = ("headers_prod", "headers_test")
REQUEST = ("domain", "url", "method")
_ALL = (1 << len(SLOTS)) - 1
_FAILED = 1 << len(SLOTS)


def _by_request(
    captures: DataFrame,
    slots: Sequence[str],
    request: Sequence[str],
    value: Column,
) -> DataFrame:
    """One aggregation: captures are read and shuffled once, whatever the slots.

    Each response sets a bit; a request is complete when exactly the four bits of
    fine responses are set. Responses combine map-side. Of repeated captures the one
    with the greatest hash of its headers wins, so they collapse early and always to
    the same one. Values are cut out before the aggregation, which sorts and carries
    nothing else.
    """
    at = {
        slot: (F.col("side") == side) & (F.col("round") == turn)
        for slot, (side, turn) in SLOTS.items()
    }
    fine = (F.col("status") == "ok") & F.col("headers").isNotNull()
    bit = reduce(
        lambda rest, i: F.when(at[list(SLOTS)[i]], F.lit(1 << i)).otherwise(rest),
        range(len(SLOTS)),
        F.lit(0),
    )
    wanted = reduce(lambda a, b: a | b, [at[slot] for slot in slots])
    responses = captures.where(F.col("req_id").isNotNull()).select(
        "req_id",
        F.when(at["headers_prod"], F.struct(*request)).alias("_request"),
        F.when(fine, bit).otherwise(F.lit(_FAILED)).alias("_bit"),
        F.when(wanted, value).alias("_value"),
        F.when(wanted, F.xxhash64(F.map_entries("headers"))).alias("_hash"),
    )

    def best(slot: str) -> Column:
        here = F.col("_bit") == 1 << list(SLOTS).index(slot)
        return F.max_by(F.when(here, F.col("_value")), F.when(here, F.col("_hash")))

    return (
        responses.groupBy("req_id")
        .agg(
            F.max("_request").alias("_request"),
            F.bit_or("_bit").alias("_seen"),
            *[best(slot).alias(slot) for slot in slots],
        )
        .where(F.col("_seen") == _ALL)
        .select("req_id", "_request.*", *slots)
    )


def header_struct(column: Column, headers: Sequence[str]) -> Column:
    """The named headers of a header map as a struct; each is looked up once."""
    return F.struct(*[F.element_at(column, F.lit(name)).alias(name) for name in headers])


def pair_captures(captures: DataFrame) -> DataFrame:
    """One row per request with its four header sets; requests that lack one of the
    four responses, or have a failed one, are dropped."""
    return _by_request(captures, list(SLOTS), REQUEST, F.col("headers"))


def pair_compared(
    captures: DataFrame, headers: Sequence[str], request: Sequence[str] = REQUEST
) -> DataFrame:
    """Like :func:`pair_captures` with the named headers of the second round only, as
    structs, and the named ``request`` columns: nothing else is shuffled."""
    values = header_struct(F.col("headers"), headers)
    return _by_request(captures, COMPARED, request, values)

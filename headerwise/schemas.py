"""Explicit schemas of the tables the jobs read and exchange."""

from __future__ import annotations

from pyspark.sql import types as T

URL_KEYS = ["domain", "method", "ipport", "request"]
REQUEST_KEYS = [*URL_KEYS, "agent", "referer"]

_HEADERS = T.MapType(T.StringType(), T.StringType())

# One access-log record; index_date is the partition column of the table.
ACCESS_LOG = T.StructType(
    [T.StructField(name, T.StringType()) for name in REQUEST_KEYS]
    + [T.StructField("ts", T.TimestampType()), T.StructField("index_date", T.DateType())]
)

# One row of the collected top requests: what collect writes and replay reads.
TOP_REQUEST = T.StructType(
    [T.StructField(name, T.StringType()) for name in REQUEST_KEYS]
    + [T.StructField("count", T.LongType())]
)

# The response (or failure) of one proxy to one replayed request in one round.
CAPTURE = T.StructType(
    [
        T.StructField("req_id", T.LongType()),
        T.StructField("domain", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("side", T.StringType()),  # 'prod' or 'test'
        T.StructField("round", T.IntegerType()),  # 1 warms the caches, 2 is compared
        T.StructField("status", T.StringType()),  # 'ok' or the reason of the failure
        T.StructField("headers", _HEADERS),
    ]
)

# The answer to the size probe sent before a GET is replayed.
PROBE = T.StructType(
    [
        T.StructField("req_id", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("headers", _HEADERS),
    ]
)

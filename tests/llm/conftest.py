import random

import pytest
from pyspark.sql import types as T

CLASHING = [
    "score", "shard", "slot", "n_words", "n_tokens", "ids", "spans", "longest", "items", "pii",
    "secrets", "kept", "label", "bucket", "component", "print", "gone", "lines", "ends", "tail",
    "_tail", "_part", "_key", "_stratum", "_id", "_print", "_clean", "_email", "_gone", "_blank", "_s", "_k0", "_before", "_size",
    "features", "grade", "n_removed", "round_trip", "parity", "id", "n", "value", "codes",
]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def sentence(rng, n=12):
    return " ".join("".join(rng.choices("abcdehilnorst", k=rng.randint(2, 8))) for _ in range(n))


def odd_texts():
    """Null, empty, blank, very long, without spaces, odd signs, repeated."""
    rng = random.Random(5)
    long = " ".join(sentence(rng) for _ in range(4000))
    plain = [sentence(rng, 80) for _ in range(6)]
    texts = [None, "", " \t\r\n", "x", "\x00\x01a\x02 ￾\U0001f600 ▁ ▁▁x", "a" * 60_000, long]
    return [*texts, long, *plain, plain[0], plain[0] + " more", "É ß\x0b\x1c KKİ"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with null and repeated ids and columns of every name that is used inside."""
    rest = ["clash"] * len(CLASHING)
    rows = [(i, t, "en", "s", 1, *rest) for i, t in enumerate(odd_texts())]
    rows += [rows[8], rows[8], (None, odd_texts()[8], None, None, None, *rest)]
    rows += [(None, None, None, None, None, *[None] * len(CLASHING)), (3, "other", "de", None, 2, *rest)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(0, None, None), (7, 1, 0), (7, 0, 1), (8, 1, 1), (9, 0, 0), (10, 1, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

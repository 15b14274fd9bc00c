"""Sketches of frequent terms: their intervals hold, whatever the parts."""

import random
from collections import Counter

import pytest

from headerwise.operators.sketches import sketched_terms, term_sketch
from headerwise.operators.top_terms import WEIGHT


def skewed(rng, n):
    return [(rng.choice("ab"), None if rng.random() < 0.1 else f"t{int(rng.paretovariate(0.7)) % 5000}") for _ in range(n)]


@pytest.mark.parametrize("counters", [1, 20, 300, 100_000])
def test_intervals_hold_and_no_frequent_term_is_missing(spark, counters):
    rows = skewed(random.Random(counters), 20_000)
    table = spark.createDataFrame(rows, "domain string, request string").repartition(6)
    keys = ["domain", "request"]
    found = sketched_terms(term_sketch(table, keys, counters), keys).collect()
    true = Counter(rows)
    got = {(r.domain, r.request): (r["count"], r.error) for r in found}
    error = {e for _, e in got.values()}
    assert len(got) == len(found) and len(error) <= 1
    bound = max(error, default=len(rows))
    assert bound <= len(rows) / (counters + 1)
    assert all(low <= true[k] <= low + e for k, (low, e) in got.items())
    assert got.keys() >= {k for k, n in true.items() if n > bound}
    if counters == 100_000:
        assert bound == 0 and {k: low for k, (low, _) in got.items()} == true


def test_merged_sketches_of_days_and_weights(spark):
    rng = random.Random(9)
    days = [skewed(rng, 3000) for _ in range(3)]
    keys = ["domain", "request"]
    tables = [spark.createDataFrame(d, "domain string, request string").repartition(3) for d in days]
    weighted = tables[2].groupBy(*keys).count().withColumnRenamed("count", WEIGHT)
    parts = [term_sketch(t, keys, 100) for t in (tables[0], tables[1], weighted)]
    found = sketched_terms(parts[0].unionAll(parts[1]).unionAll(parts[2]), keys, 50).collect()
    true = Counter(row for d in days for row in d)
    assert all(r["count"] <= true[r.domain, r.request] <= r["count"] + r.error for r in found)
    bound = max(r.error for r in found)
    assert bound <= 9000 / 101
    names = {(r.domain, r.request) for r in found}
    assert names >= {k for k, n in true.items() if n >= 50 and n > bound}


def test_empty_log(spark):
    none = spark.createDataFrame([], "domain string")
    assert sketched_terms(term_sketch(none, ["domain"]), ["domain"]).collect() == []
    with pytest.raises(ValueError):
        term_sketch(none, ["domain"], 0)

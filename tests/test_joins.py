"""Broadcasts follow measured sizes, with automatic broadcasts left on."""

from pyspark.sql import functions as F

from headerwise.operators.members import member_counts
from headerwise.operators.rules import Rule, RuleSet, TimeTolerance, rules_from_rows
from headerwise.functions.http_dates import parse_http_date
from headerwise.plans.options import Options, Scope, resolve_options
from headerwise.sources.scratch import stored

import pytest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_small_keys_are_not_broadcast(spark):
    keys = spark.range(1_200_000).select(F.concat(F.lit("/"), F.col("id")).alias("request"))
    members = stored(keys, "keys")
    assert not members.fits_broadcast() and not members.number_fits_broadcast()
    found = member_counts(keys, ["request"], members, ["request"])
    assert found.count() == 1_200_000
    assert "BroadcastHashJoin" not in plan_of(found)


def test_long_option_lists_are_joined_by_size(spark):
    names = spark.range(2000).select(F.concat(F.lit("d"), F.col("id")).alias("domain"))
    scope = Scope.of(resolve_options(names, Options(min_count=1)))
    assert scope.size.fits_broadcast()
    assert "BroadcastHashJoin" in plan_of(scope.attach(names, ["min_count"]))


def test_rules_from_rows():
    row = lambda header, kind, param=None, seq=1: {
        "domain": "d", "seq": seq, "header": header, "kind": kind, "param": param,
    }
    rules = rules_from_rows(
        [row("a", "time_tolerance", "0"), row("b", "time_tolerance_both", "5", 2),
         row("a", "skip", None, 3), row("c", "time_tolerance", None, 4)]
    )
    own = [r for r in rules.effective("d") if r.header in "abc"]
    assert own == [Rule("b", TimeTolerance(5, True)), Rule("c", TimeTolerance(3600))]
    assert rules_from_rows([row("a", "time_tolerance", "0")]).effective("d")[0].check.seconds == 0
    twice = RuleSet(default=(Rule("x", None), Rule("y"), Rule("x")))
    assert [r.header for r in twice.effective(None)] == ["x", "y"]


@pytest.mark.parametrize(
    ("text", "seconds"),
    [
        ("Sun, 06 Nov 1994 08:49:37 GMT", 784111777),
        ("Sun, 06 Nov 1994 08:49:37 +0000", 784111777),
        ("Sun, 06 Nov 1994 09:49:37 +0100", 784111777),
        ("Sunday, 06-Nov-94 08:49:37 GMT", 784111777),
        ("Sun Nov  6 08:49:37 1994", 784111777),
        ("123, 06 Nov 1994 08:49:37 GMT", None),
        ("garbage", None),
    ],
)
def test_http_dates(spark, text, seconds):
    row = spark.range(1).select(F.unix_timestamp(parse_http_date(F.lit(text))))
    assert row.first()[0] == seconds


def test_large_top_k_is_cut_before_the_shuffle(spark):
    with pytest.raises(ValueError):
        Options(top_urls=10_001)
    from headerwise.operators.top_terms import Level, nested_top_terms, term_counts

    rows = spark.range(20_000).select(F.lit("p").alias("parent"), (F.col("id") % 9000).alias("term"))
    level = [Level("term", 5000, 1)]
    found = nested_top_terms(term_counts(rows, ["parent", "term"]), ["parent"], level)
    assert "WindowGroupLimit" in plan_of(found)
    top = found.collect()
    assert len(top) == 5000 and {r["count"] for r in top} == {2, 3}

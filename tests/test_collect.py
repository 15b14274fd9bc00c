import datetime as dt
import random
from collections import Counter

import hypothesis
import hypothesis.strategies as st
import pytest
from hypothesis import given
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise import settings
from headerwise.operators import members
from headerwise.operators.top_terms import Level, nested_top_terms, term_counts
from headerwise.plans.collect import domain_list, index_inventory, top_requests, top_urls
from headerwise.plans.options import Options, resolve_options
from headerwise.schemas import REQUEST_KEYS
from headerwise.sources import scratch
from headerwise.sources.local import small_table
from headerwise.sources.request_files import domain_names
from tests import brute
from workload import views

LOG = T.StructType([T.StructField(c, T.StringType()) for c in REQUEST_KEYS])


def log(spark, rows):
    return small_table(spark, LOG, rows)


def resolved(spark, params):
    """Options frame from {domain: (min_count, top_urls, top_agents, top_referers)}."""
    entries = [(d, Options(*values)) for d, values in params.items()]
    return resolve_options(domain_names(spark, list(params)), per_domain=entries)


def urls_of(df):
    return {tuple(r)[:4]: r["count"] for r in df.collect()}


def requests_of(df):
    return sorted(tuple(r) for r in df.collect())


def random_log(seed, n=3000):
    """Few values per column with many ties and NULLs; a third of the rows are alike."""
    rng = random.Random(seed)

    def pick(values, *weights):
        return rng.choices(values, weights or None)[0]

    rows = []
    for i in range(n):
        if i % 3 == 0:
            agent = pick(["hot", "cold"], 9, 1)
            rows.append(("a.example", "get", "80", "/", agent, pick([None, "", "/x"])))
            continue
        rows.append(
            (
                pick(["a.example", "b.example", "c.example", "-", None]),
                pick(["get", "head", "post", "put", None]),
                pick(["80", "443", "8080", None]),
                pick([f"/{j}" for j in range(6)] + [None]),
                pick(["u1", "u2", "u3", None]),
                pick([None, "", "/x", "/y", "/z"]),
            )
        )
    return rows


PARAMS = {
    "a.example": (9, 4, 2, 2),
    "b.example": (7, 2, 3, 1),
    "c.example": (12, 100, 50, 100),
    "nope.example": (1, 1, 1, 1),
}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = random_log(seed)
    logs, opts = log(spark, rows), resolved(spark, PARAMS)
    expected = brute.top_urls(rows, PARAMS)
    assert expected and urls_of(top_urls(logs, opts)) == expected
    expected = brute.top_requests(rows, PARAMS)
    assert expected and requests_of(top_requests(logs, opts)) == expected


@hypothesis.settings(max_examples=8, deadline=None, derandomize=True, database=None)
@given(
    rows=st.lists(
        st.tuples(
            st.sampled_from(["a", "b"]),
            st.sampled_from(["get", "post", None]),
            st.sampled_from(["80", "443", "81", None]),
            st.sampled_from(["/", "/x", None]),
            st.sampled_from(["u", "v", None]),
            st.sampled_from([None, "", "/r"]),
        ),
        min_size=20,
        max_size=120,
    ),
    minimum=st.integers(1, 6),
    sizes=st.tuples(*[st.integers(1, 2)] * 3),
)
def test_any_log_matches_brute_force(spark, rows, minimum, sizes):
    params = {"a": (minimum, *sizes), "b": (1, 2, 2, 2)}
    found = top_requests(log(spark, rows), resolved(spark, params))
    assert requests_of(found) == brute.top_requests(rows, params)


@pytest.mark.parametrize("hashes", [False, True])
def test_long_lists_and_big_tables_give_the_same(spark, monkeypatch, hashes):
    """No list inlined and no member table broadcast: its hashes are, or nothing is."""
    rows = random_log(4)
    monkeypatch.setattr(settings, "INLINE_DOMAINS", 1)
    monkeypatch.setattr(scratch.Stored, "fits_broadcast", lambda self: False)
    monkeypatch.setattr(scratch.Stored, "number_fits_broadcast", lambda self: hashes)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = top_requests(log(spark, rows), resolved(spark, PARAMS))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == hashes
        assert plan.count("xxhash64(domain") == 2 * hashes
        assert requests_of(found) == brute.top_requests(rows, PARAMS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_strangers_with_a_member_hash_fall_out(spark, monkeypatch):
    """Even if all hashes are equal, the exact join after the aggregation decides."""
    rows = random_log(9)
    monkeypatch.setattr(scratch.Stored, "fits_broadcast", lambda self: False)
    monkeypatch.setattr(members.F, "xxhash64", lambda *_: F.lit(7))
    found = top_requests(log(spark, rows), resolved(spark, PARAMS))
    assert requests_of(found) == brute.top_requests(rows, PARAMS)


@pytest.mark.parametrize("largest", [None, 5000])
def test_sizes_beyond_the_window_limit(spark, largest):
    """The salted ranking keeps exactly the terms the plain one keeps."""
    rows = [(f"d{i % 2}", f"/{i % 700:03d}") for i in range(5000)]
    schema = T.StructType().add("domain", "string").add("request", "string")
    counts = term_counts(small_table(spark, schema, rows), ["domain", "request"])
    counts = counts.withColumn("k", F.lit(123))
    found = nested_top_terms(counts, ["domain"], [Level("request", "k", 2)], largest=largest)
    got = {(r.domain, r.request): r["count"] for r in found.collect()}
    expected = {}
    for d in ("d0", "d1"):
        mine = Counter(r[1] for r in rows if r[0] == d)
        expected |= {(d, t): n for t, n in brute.best(mine, 123, 2)}
    assert got == expected and len(got) == 246


def test_ranking_prunes_inside_tasks(spark):
    rows = random_log(5)
    plan = top_urls(log(spark, rows), resolved(spark, PARAMS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text
    assert text.count("LocalTableScan") == 2  # the log is read once, the options once
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_a_page_frequent_overall_but_in_a_pruned_port_is_dropped(spark):
    rows = [("a", "get", "80", f"/{i % 3}", "u", None) for i in range(30)]
    rows += [("a", "get", "443", f"/{i % 3}", "u", None) for i in range(27)]
    rows += [("a", "get", "8080", "/big", "u", None)] * 20
    found = urls_of(top_urls(log(spark, rows), resolved(spark, {"a": (5, 10, 1, 1)})))
    assert {k[2] for k in found} == {"80", "443"} and len(found) == 6


def test_counts_include_rows_without_lower_values(spark):
    """The port and agent levels reach the minimum through rows without URL or referer."""
    rows = [("a", "get", "80", None, "u", None)] * 6 + [("a", "get", "80", "/", "u", None)] * 4
    rows += [("a", "get", "443", "/", "u", None)] * 9 + [("a", "get", "8080", "/", "u", None)] * 8
    found = urls_of(top_urls(log(spark, rows), resolved(spark, {"a": (4, 10, 1, 1)})))
    assert found == {("a", "get", "80", "/"): 4, ("a", "get", "443", "/"): 9}


def test_ten_methods_two_ports_and_put_is_not_filtered(spark):
    rows = [("a", f"m{i:02d}", "80", "/", "u", None) for i in range(11) for _ in range(20 - i)]
    rows += [("b", "put", port, "/", "u", None) for port in ("1", "2", "3") for _ in range(5)]
    opts = resolved(spark, {"a": (1, 9, 9, 9), "b": (1, 9, 9, 9)})
    found = urls_of(top_urls(log(spark, rows), opts))
    assert {k[1] for k in found if k[0] == "a"} == {f"m{i:02d}" for i in range(10)}
    assert {k[2] for k in found if k[1] == "put"} == {"1", "2"}  # tie: smaller term first
    only = urls_of(top_urls(log(spark, rows), opts, methods=["m03", "m10"]))
    assert {k[1] for k in only} == {"m03", "m10"}


def test_minimum_is_inclusive_for_terms_and_exclusive_for_missing(spark):
    base = ("a", "get", "80", "/", "u")
    opts = resolved(spark, {"a": (8, 9, 9, 9)})  # second minimum 2
    rows = [(*base, None)] * 2 + [(*base, "")] * 2 + [(*base, "/x")] * 4
    assert requests_of(top_requests(log(spark, rows), opts)) == [
        (*base, "", 2),
        (*base, "/x", 4),
    ]
    rows += [(*base, None)]
    assert requests_of(top_requests(log(spark, rows), opts)) == [
        (*base, "", 2),  # the empty text
        (*base, "", 3),  # no referer at all
        (*base, "/x", 4),
    ]
    rows = rows[:7]
    assert requests_of(top_requests(log(spark, rows), opts)) == []  # 7 < 8


def test_missing_rows_do_not_use_up_a_place(spark):
    base = ("a", "get", "80", "/", "u")
    rows = [(*base, None)] * 9 + [(*base, "/x")] * 5 + [(*base, "/y")] * 4
    found = requests_of(top_requests(log(spark, rows), resolved(spark, {"a": (4, 9, 9, 1)})))
    assert found == [(*base, "", 9), (*base, "/x", 5)]


def test_ties_at_the_edge_take_the_smaller_term(spark):
    rows = [("a", "get", "80", f"/{c}", "u", None) for c in "dcba" for _ in range(3)]
    found = urls_of(top_urls(log(spark, rows), resolved(spark, {"a": (1, 2, 1, 1)})))
    assert {k[3] for k in found} == {"/a", "/b"}


def test_ranks_give_the_report_order(spark):
    rows = [("a", "post", "80", "/1", "u", None)] * 5 + [("a", "get", "80", "/2", "u", None)] * 3
    rows += [("a", "get", "443", "/3", "u", None)] * 4
    opts = resolved(spark, {"a": (1, 9, 9, 9)})
    ranked = top_urls(log(spark, rows), opts, ranks=True)
    ordered = ranked.orderBy("method_rank", "ipport_rank", "request_rank").collect()
    assert [r.request for r in ordered] == ["/3", "/2", "/1"]


def test_result_does_not_depend_on_partitioning(spark):
    logs = log(spark, random_log(6))
    opts = resolved(spark, PARAMS)
    one = requests_of(top_requests(logs.repartition(1), opts))
    assert one == requests_of(top_requests(logs.repartition(13), opts))


def test_child_counts_never_exceed_their_parent(spark):
    rows = random_log(7)
    opts = resolved(spark, PARAMS)
    urls = urls_of(top_urls(log(spark, rows), opts))
    for row in requests_of(top_requests(log(spark, rows), opts)):
        assert row[-1] <= urls[row[:4]]


@pytest.mark.parametrize(("methods", "expected"), [(None, 36), (["get", "post"], 24)])
def test_known_first_level_numbers(spark, methods, expected):
    logs = views.access_log(spark, "/root/testdata/sf0.01")
    opts = resolve_options(
        domain_names(spark, ["d0.example.com", "d1.example.com"]),
        Options(min_count=250, top_urls=3, top_agents=50, top_referers=2),
    )
    counts = urls_of(top_urls(logs, opts, methods=methods)).values()
    assert len(counts) == expected
    if methods is None:
        assert (min(counts), max(counts)) == (272, 318)
        found = requests_of(top_requests(logs, opts))
        assert Counter(r[5] for r in found) == {"": 32, "/r/0": 16, "/r/1": 2}


def test_known_domain_list(spark):
    rows = domain_list(views.access_log(spark, "/root/testdata/sf0.01"), 3).collect()
    assert [tuple(r) for r in rows] == [
        ("d1.example.com", 10284),
        ("d0.example.com", 10246),
        ("d2.example.com", 10199),
    ]


def test_domain_list_defaults_and_order(spark):
    rows = [("b",) + (None,) * 5] * 1000 + [("a",) + (None,) * 5] * 1000
    rows += [("-",) + (None,) * 5] * 2000 + [(None,) * 6] * 2000 + [("c",) + (None,) * 5] * 999
    found = [tuple(r) for r in domain_list(log(spark, rows), 0, 0).collect()]
    assert found == [("a", 1000), ("b", 1000)]
    plan = domain_list(log(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_options_layers(spark):
    entries = [
        ("x", Options(min_count=10, top_urls=7)),
        ("x", Options(top_agents=1)),  # a second entry of the same name is ignored
        ("y", Options(min_count=5)),
    ]
    frame = resolve_options(
        domain_names(spark, ["x", "y", "z", "x"]), Options(top_urls=3), entries
    )
    got = {r.domain: tuple(r)[1:] for r in frame.collect()}
    assert got == {
        "x": (10, 3, 50, 100, 3),
        "y": (5, 3, 50, 100, 2),
        "z": (100, 3, 50, 100, 25),
    }
    part = resolve_options(domain_names(spark, ["x"]), defaults=Options(min_count=9)).first()
    assert tuple(part) == ("x", 9, 100, 50, 100, 3)
    for minimum, second in ((1, 1), (4, 1), (5, 2), (250, 63)):
        row = resolve_options(domain_names(spark, ["x"]), Options(min_count=minimum)).first()
        assert row.min_count_2 == second
    for bad in ({"min_count": 0}, {"top_urls": 0}):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.raises(ValueError):
        Level("method", 0, 1)


def test_no_domains_no_rows(spark):
    logs = log(spark, random_log(8, 100))
    none = resolve_options(domain_list(logs, 5, 10**6))
    assert requests_of(top_requests(logs, none)) == []
    unknown = resolve_options(domain_names(spark, ["nope.example", None]))
    assert requests_of(top_requests(logs, unknown)) == []


def test_index_inventory(spark):
    schema = T.StructType().add("index_date", "date").add("ts", "timestamp")
    rows = [(dt.date(2015, 10, d), dt.datetime(2015, 10, d, h)) for d in (9, 10) for h in (1, 5)]
    logs = small_table(spark, schema, rows)
    found = index_inventory(logs).orderBy("index").collect()
    assert [(r["index"], r.docs_count) for r in found] == [
        ("logstash-2015.10.09", 2),
        ("logstash-2015.10.10", 2),
    ]
    assert index_inventory(logs, "logstash-2015.10.1?").count() == 1

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.functions.text import leading_number, url_domain
from headerwise.operators.replay import build_requests, guard_content, shuffled
from headerwise.schemas import PROBE, TOP_REQUEST
from headerwise.sources.local import small_table
from workload import views

TEXT = T.StructType().add("x", "string")


def one(spark, value, function):
    return small_table(spark, TEXT, [(value,)]).select(function(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("url", "domain"),
    [
        ("http://a.example/x", "a.example"),
        ("https://a.example", "a.example"),
        ("a.example/x/y", "a.example"),
        ("http://u:p@a.example:8080/x", "u:p@a.example:8080"),
        ("http://a.example?q=1", "a.example?q=1"),
        ("ftp://a/b", "ftp:"),
        ("HTTP://A/", "HTTP:"),
        ("http://", "http:"),
        (" a.example/", "a.example"),
        ("two words/x", "words"),
        (" a/", "a"),
        ("a\nb", "b"),
        ("", "-"),
        ("   ", "-"),
        (None, "-"),
    ],
)
def test_url_domain(spark, url, domain):
    assert one(spark, url, url_domain) == domain


@pytest.mark.parametrize(
    ("text", "number"),
    [("14666abc", 14666), (" 12", 12), ("-5", -5), ("+7", 7), ("1.9", 1), ("abc", None),
     ("", None), (None, None), ("9" * 30, 1e30)],
)
def test_leading_number(spark, text, number):
    assert one(spark, text, leading_number) == number


def test_build_requests(spark):
    rows = [
        ("s.example", "get", "80", "/a?b=1", "UA", "", 252),
        ("s.example", "Head", "443", "/", "UA", "http://r/", 1),
        ("s.example", "put", "8443", "/x", "UA", "/r", 9),
    ]
    plan = build_requests(small_table(spark, TOP_REQUEST, rows)).collect()
    assert [(r.url, r.method) for r in plan] == [
        ("http://s.example/a?b=1", "GET"),
        ("https://s.example/", "HEAD"),
        ("http://s.example/x", "PUT"),
    ]
    assert plan[0].headers == {"User-Agent": "UA", "Referer": ""}
    assert (plan[0].tunnel, plan[0].follow_redirect, plan[0].timeout) == (False, False, 15000)
    assert "count" not in plan[0]


GUARD = [
    ("GET", "ok", {"content-length": "999"}, "keep"),
    ("GET", "ok", {"content-length": "1048576"}, "keep"),
    ("GET", "ok", {"content-length": "1048577"}, "too_big"),
    ("get", "ok", {"content-length": "1048577"}, "too_big"),
    ("GET", "ok", {"content-length": "2000000xyz"}, "too_big"),
    ("GET", "ok", {"content-length": "9" * 25}, "too_big"),
    ("GET", "ok", {"content-length": "abc", "content-type": "video/mp4"}, "keep"),
    ("GET", "ok", {"content-length": "5", "content-type": "video/mp4"}, "keep"),
    ("GET", "ok", {"content-type": "video/mp4"}, "video_unknown_length"),
    ("GET", "ok", {"content-type": "Video/mp4"}, "keep"),
    ("GET", "ok", {"content-type": "text/html"}, "keep"),
    ("GET", "ok", {}, "keep"),
    ("GET", "timeout", {}, "probe_error"),
    ("GET", None, None, "probe_error"),
    ("HEAD", "ok", {"content-length": "99999999"}, "keep"),
    ("POST", None, None, "keep"),
]


def test_content_guard(spark):
    rows = [
        (i, method, status, None if headers is None else list(headers.items()))
        for i, (method, status, headers, _) in enumerate(GUARD)
    ]
    found = guard_content(small_table(spark, PROBE, rows)).collect()
    assert {r.req_id: r.verdict for r in found} == {i: g[-1] for i, g in enumerate(GUARD)}


def test_known_guard_numbers(spark):
    found = guard_content(views.probes(spark, "/root/testdata/sf0.01"))
    counts = {r.verdict: r["count"] for r in found.groupBy("verdict").count().collect()}
    assert counts == {
        "keep": 9470, "too_big": 4650, "video_unknown_length": 556, "probe_error": 324,
    }


def test_shuffle_is_random_complete_and_reproducible(spark):
    rows = [(f"d{i // 200}", "get", "80", f"/{i}", "ua", "", i) for i in range(1000)]
    frame = small_table(spark, TOP_REQUEST, rows)
    first = [tuple(r) for r in shuffled(frame, 1).collect()]
    assert sorted(first) == sorted(rows) and first != rows
    assert first == [tuple(r) for r in shuffled(frame.repartition(13), 1).collect()]
    assert first != [tuple(r) for r in shuffled(frame, 2).collect()]
    # the load is spread: neighbours rarely hit the same domain
    assert sum(a[0] == b[0] for a, b in zip(first, first[1:])) < 350
    assert shuffled(build_requests(frame)).count() == 1000

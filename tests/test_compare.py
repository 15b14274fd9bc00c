import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.functions.http_dates import parse_http_date
from headerwise.operators.difference import label_differences
from headerwise.operators import members
from headerwise.operators.members import filtered_members
from headerwise.operators.pairing import pair_captures
from headerwise.operators.replay import request_plan
from headerwise.operators.rules import (
    Exact,
    Rule,
    RuleSet,
    Suffix,
    TimeTolerance,
    WeakETag,
    default_rules,
    rules_from_rows,
)
from headerwise.plans.compare import (
    compare_captures,
    compare_run,
    compare_url,
    differing,
    error_histogram,
    pass_ratio,
)
from headerwise.schemas import CAPTURE, TOP_REQUEST
from headerwise.sources.local import small_table
from headerwise.sources.scratch import Stored, stored
from workload import catalog, views

DAY = "Wed, 16 Sep 2015 12:40:52 GMT"


def later(seconds, base=DAY):
    moment = dt.datetime.strptime(base, "%a, %d %b %Y %H:%M:%S GMT")
    return (moment + dt.timedelta(seconds=seconds)).strftime("%a, %d %b %Y %H:%M:%S GMT")


def check(spark, rule, prod, test):
    schema = T.StructType().add("p", "string").add("t", "string")
    frame = small_table(spark, schema, [(prod, test)])
    return frame.select(F.coalesce(rule(F.col("p"), F.col("t")), F.lit(False))).first()[0]


@pytest.mark.parametrize(
    ("rule", "prod", "test", "expected"),
    [
        (Exact(), "a", "a", True),
        (Exact(), "a", "A", False),
        (WeakETag(), 'W/"a"', 'W/"b"', True),
        (WeakETag(), 'W/"a"', '"b"', False),
        (WeakETag(), '"a"', '"a"', True),
        (WeakETag(), 'w/"a"', 'w/"b"', False),
        (Suffix(), '"88f94-32183"', '"ebad6-32183"', True),
        (Suffix(), '"88f94-32183"', '"88f94-32184"', False),
        (Suffix(), "abc", "xyzxyz", True),
        (Suffix(), "abc", "xyzxyzq", False),
        (TimeTolerance(), DAY, later(2), True),
        (TimeTolerance(), DAY, later(-3599), True),
        (TimeTolerance(), DAY, later(-3600), False),
        (TimeTolerance(), DAY, later(10**7), True),
        (TimeTolerance(symmetric=True), DAY, later(3600), False),
        (TimeTolerance(symmetric=True), DAY, later(3599), True),
        (TimeTolerance(60), DAY, later(-60), False),
        (TimeTolerance(), "garbage", "garbage", False),
        (TimeTolerance(), DAY, "garbage", False),
    ],
)
def test_checks(spark, rule, prod, test, expected):
    assert check(spark, rule, prod, test) is expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Sun, 06 Nov 1994 08:49:37 GMT", "1994-11-06 08:49:37"),
        ("Sun, 6 Nov 1994 08:49:37 GMT", "1994-11-06 08:49:37"),
        ("06 Nov 1994 08:49:37 GMT", "1994-11-06 08:49:37"),
        ("Sunday, 06-Nov-94 08:49:37 GMT", "1994-11-06 08:49:37"),
        ("Friday, 06-Nov-49 08:49:37 GMT", "2049-11-06 08:49:37"),
        ("Sunday, 06-Nov-50 08:49:37 GMT", "1950-11-06 08:49:37"),
        ("Sun Nov  6 08:49:37 1994", "1994-11-06 08:49:37"),
        ("Thu, 01 Jan 1970 00:00:00 GMT", "1970-01-01 00:00:00"),
        ("1994-11-06T08:49:37Z", None),
        ("Sun, 32 Nov 1994 08:49:37 GMT", None),
        ("", None),
        (None, None),
    ],
)
def test_http_dates(spark, text, expected):
    frame = small_table(spark, T.StructType().add("x", "string"), [(text,)])
    got = frame.select(F.date_format(parse_http_date(F.col("x")), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == expected


def test_rule_order_and_merge():
    rules = RuleSet(
        by_domain={
            "a": [Rule("etag", Suffix(6))],
            "b": [Rule("x-new"), Rule("content-length", None)],
            "c": [Rule("etag", Suffix(6))],
            "d": [Rule("etag", WeakETag())],
        }
    )
    assert [r.header for r in rules.effective("a")] == [
        "etag", "content-type", "content-length", "last-modified", "x-cache",
    ]
    assert [r.header for r in rules.effective("b")] == [
        "x-new", "content-type", "etag", "last-modified", "x-cache",
    ]
    assert rules.effective("unknown") == default_rules()
    assert ["a", "c"] in rules.groups().values()
    assert rules.headers()[:2] == ["content-type", "content-length"] and "x-new" in rules.headers()


def test_rules_from_rows():
    rows = [
        {"domain": "a", "seq": 2, "header": "etag", "kind": "suffix", "param": "3"},
        {"domain": "a", "seq": 1, "header": "age", "kind": "skip"},
        {"domain": "b", "seq": 1, "header": "last-modified", "kind": "time_tolerance"},
        {"domain": "b", "seq": 2, "header": "etag", "kind": "weak_etag", "param": None},
    ]
    rules = rules_from_rows(rows)
    assert rules.by_domain["a"] == [Rule("age", None), Rule("etag", Suffix(3))]
    assert rules.by_domain["b"] == [
        Rule("last-modified", TimeTolerance(3600)),
        Rule("etag", WeakETag()),
    ]
    assert rules.default == default_rules()
    only = rules_from_rows([{"domain": "default", "seq": 1, "header": "via", "kind": "exact"}])
    assert only.effective("x") == (Rule("via"),)
    with pytest.raises(ValueError):
        rules_from_rows([{"domain": "a", "seq": 1, "header": "x", "kind": "eval"}])


def plain_label(rules, domain, prod, test):
    """The first failing rule, header by header."""
    def same(rule, p, t):
        if isinstance(rule, WeakETag):
            return p == t or (p[:2] == "W/" and t[:2] == "W/")
        if isinstance(rule, Suffix):
            return p[rule.skip :] == t[rule.skip :]
        if isinstance(rule, TimeTolerance):
            try:
                parsed = [dt.datetime.strptime(x, "%a, %d %b %Y %H:%M:%S GMT") for x in (p, t)]
            except ValueError:
                return False
            return (parsed[0] - parsed[1]).total_seconds() < rule.seconds
        return p == t

    for rule in rules.effective(domain):
        p, t = prod.get(rule.header), test.get(rule.header)
        if p is None and t is None:
            continue
        if p is None or t is None:
            return f"{rule.header} existence"
        if not same(rule.check, p, t):
            return rule.header
    return ""


RULES = RuleSet(
    by_domain={
        "a": [Rule("etag", Suffix(6))],
        "b": [Rule("last-modified", TimeTolerance())],
        "c": [Rule("content-length", None)],
        "d": [Rule("etag", Suffix(6))],
    }
)
CHOICES = {
    "content-type": [None, "text/html", "text/html", "text/html"],
    "content-length": [None, "7", "7", "7", "8"],
    "etag": [None, '"88f94-1"', '"ebad6-1"', 'W/"x"', 'W/"y"', "ab"],
    "last-modified": [None, DAY, DAY, later(-4000), later(4000), "garbage"],
    "x-cache": ["HIT", "HIT", "HIT", "MISS"],
    "age": [None, "1", "2"],
}


def random_pairs(seed, n=400):
    rng = random.Random(seed)

    def one():
        values = {h: rng.choice(options) for h, options in CHOICES.items()}
        return {h: v for h, v in values.items() if v is not None}

    return [(rng.choice(["a", "b", "c", "d", "e", None]), one(), one()) for _ in range(n)]


def test_first_difference_matches_brute_force(spark):
    pairs = random_pairs(1)
    headers = T.MapType(T.StringType(), T.StringType())
    schema = T.StructType().add("domain", "string")
    schema = schema.add("headers_prod", headers).add("headers_test", headers)
    frame = small_table(spark, schema, [(d, list(p.items()), list(t.items())) for d, p, t in pairs])
    for row in label_differences(frame, RULES).collect():
        assert row.error == plain_label(RULES, row.domain, row.headers_prod, row.headers_test)


def test_known_numbers(spark):
    sf = "/root/testdata/sf0.01"
    labelled = label_differences(views.header_pairs(spark, sf), catalog.RULES)
    total, diffs, ratio, failing = pass_ratio(labelled).first()
    assert (total, diffs, round(ratio, 4), failing) == (15000, 7342, 51.0533, True)
    passed = labelled.where("error = ''").groupBy("domain").count().collect()
    assert {r.domain[:2]: r["count"] for r in passed} == {
        "d0": 1577, "d1": 2498, "d2": 1865, "d3": 1718,
    }
    assert error_histogram(labelled).count() == 6

    paired = pair_captures(views.captures(spark, sf))

    def cache(column):
        return F.element_at(column, F.lit("x-cache"))

    second = paired.where(cache("headers_prod") != cache("headers_test")).count()
    first = paired.where(cache("headers_prod_1st") != cache("headers_test_1st")).count()
    assert (paired.count(), second, first) == (14516, 501, 0)


def captures(spark, rows):
    full = [
        (i, domain, f"http://{domain}/{i}", "GET", side, turn, status, headers and list(headers.items()))
        for i, domain, side, turn, status, headers in rows
    ]
    return small_table(spark, CAPTURE, full)


def quad(i, domain, prod, test, **status):
    for side, turn in itertools.product(("prod", "test"), (1, 2)):
        headers = dict(prod if side == "prod" else test, round=str(turn))
        yield (i, domain, side, turn, status.get(f"{side}{turn}", "ok"), headers)


def test_pairing_drops_incomplete_and_failed_requests(spark):
    a, b = {"etag": "1"}, {"etag": "2"}
    rows = [*quad(1, "x", a, b), *quad(2, "x", a, b, test1="timeout")]
    rows += [r for r in quad(3, "x", a, b) if r[2:4] != ("prod", 1)]  # one never arrived
    rows += [(*r[:5], None) if r[2:4] == ("test", 2) else r for r in quad(4, "x", a, b)]
    rows += [(*r[:4], None, r[5]) if r[2:4] == ("prod", 2) else r for r in quad(5, "x", a, b)]
    rows += [*quad(6, "x", {}, {})]
    found = {r.req_id: r for r in pair_captures(captures(spark, rows)).collect()}
    assert set(found) == {1, 6}
    assert found[1].headers_prod == {"etag": "1", "round": "2"}
    assert found[1].headers_test_1st == {"etag": "2", "round": "1"}
    assert found[1].url == "http://x/1" and found[1].method == "GET"


def test_hot_request_captured_many_times_collapses(spark):
    a, b = {"etag": "1", "x-cache": "HIT"}, {"etag": "1", "x-cache": "HIT"}
    rows = list(quad(1, "x", a, b)) * 300
    rows += [r for i in range(2, 50) for r in quad(i, "x", a, b)]
    frame = captures(spark, rows).repartition(7)
    labelled = compare_captures(frame, RULES)
    assert pass_ratio(labelled).first().total == 49
    assert labelled.where("req_id = 1").count() == 1


def test_repeated_captures_that_differ(spark, tmp_path):
    """Whatever the order they arrive in, label and saved headers belong together."""
    rows = []
    for i in range(60):
        for age in range(4):
            etag = "m" if age % 2 else "z"
            rows += quad(i, "x", {"etag": "m"}, {"etag": etag, "age": f"{i}-{age}"})
    seen = []
    for parts in (1, 9):
        frame = captures(spark, rows).repartition(parts)
        labels = {r.req_id: r.error for r in compare_captures(frame, RULES).collect()}
        diffs = compare_run(frame, RULES, str(tmp_path / str(parts))).diffs.collect()
        assert {r.req_id for r in diffs} == {i for i, label in labels.items() if label}
        assert all(r.error == "etag" and r.headers_test["etag"] == "z" for r in diffs)
        one = compare_url(frame, "http://x/1", RULES).first()
        assert one.error == labels[1]
        seen.append((labels, sorted((r.req_id, r.headers_test["age"]) for r in diffs)))
    assert seen[0] == seen[1] and 0 < len(seen[0][1]) < 60


def run_pairs(seed):
    rows, expected = [], {}
    for i, (domain, prod, test) in enumerate(random_pairs(seed, 200)):
        if domain is None:
            continue
        failed = {"prod1": "timeout"} if i % 10 == 0 else {}
        rows += quad(i, domain, prod, test, **failed)
        if not failed:
            expected[i] = plain_label(RULES, domain, prod, test)
    return rows, expected


def test_batch_compare(spark, tmp_path):
    rows, expected = run_pairs(2)
    frame = captures(spark, rows)
    labelled = compare_captures(frame, RULES)
    assert {r.req_id: r.error for r in labelled.collect()} == expected

    report = compare_run(frame, RULES, str(tmp_path), as_of=dt.datetime(2015, 10, 11, 23, 1, 17))
    failing = {i: e for i, e in expected.items() if e}
    assert {r.req_id: r.error for r in report.diffs.collect()} == failing
    assert {r.error: r.n for r in report.errors.collect()} == Counter(failing.values())
    summary = report.summary.first()
    assert (summary.total, summary.diffs) == (len(expected), len(failing))
    assert summary.ratio == pytest.approx(100 * (1 - len(failing) / len(expected)))
    assert summary.failing is True
    assert report.diff_path == f"{tmp_path}/2015-10-11-23-01.diff.json"
    saved = spark.read.json(report.diff_path)
    assert saved.count() == len(failing)
    assert {"headers_prod", "headers_test_1st", "error", "url"} <= set(saved.columns)
    assert sum(r.n for r in report.errors.collect()) == len(failing)


def test_many_failing_rows_take_the_other_way(spark, tmp_path, monkeypatch):
    rows, expected = run_pairs(3)
    monkeypatch.setattr(Stored, "number_fits_broadcast", lambda self: False)
    report = compare_run(captures(spark, rows), RULES, str(tmp_path), name="x.json")
    assert {r.req_id: r.error for r in report.diffs.collect()} == {
        i: e for i, e in expected.items() if e
    }


def test_many_failing_rows_filter_the_captures(spark, tmp_path, monkeypatch):
    """beyond the hashes that fit, header sets of passing requests are not shuffled."""
    rows = [r for i in range(400) for r in quad(i, "x", {"etag": "1"}, {"etag": "12"[i % 4 == 0]})]
    monkeypatch.setattr(Stored, "number_fits_broadcast", lambda self: False)
    failing = stored(small_table(spark, T.StructType().add("req_id", "long"), [[i] for i in range(0, 400, 4)]), "failing")
    left = filtered_members(captures(spark, rows), failing, ["req_id"])
    found = Counter(r.req_id for r in left.collect())
    assert all(found[i] == 4 for i in range(0, 400, 4)) and len(found) < 110
    assert left.columns == captures(spark, rows).columns
    report = compare_run(captures(spark, rows), RULES, str(tmp_path), name="many")
    assert sorted(r.req_id for r in report.diffs.collect()) == list(range(0, 400, 4))
    monkeypatch.setattr(members, "SLOTS", 1)
    assert filtered_members(captures(spark, rows), failing, ["req_id"]).count() == 1600


def test_saved_header_sets_are_compressed(spark, tmp_path):
    """four sets of nearly the same headers a row are most of what a run writes."""
    rows = [r for i in range(200) for r in quad(i, "x", {"etag": "1", "a": "b" * 99}, {"etag": "2", "a": "b" * 99})]
    report = compare_run(captures(spark, rows), RULES, str(tmp_path), name="packed")
    files = [p for p in tmp_path.rglob("part-*")]
    assert report.diffs.count() == 200 and files and all(p.suffix == ".gz" for p in files)
    assert sum(p.stat().st_size for p in files) < 200 * 4 * 99 / 4


def test_failing_rows_tell_the_request_that_was_sent(spark, tmp_path):
    row = ("x.example", "get", "80", "/a", "UA", "/r", 7)
    plan = request_plan(small_table(spark, TOP_REQUEST, [row, row, (*row[:3], "/b", *row[4:])]))
    ids = {r.req_id: r.url for r in plan.collect()}
    assert len(ids) == 3  # equal requests are requests of their own
    rows = [r for i, url in ids.items() for r in quad(i, "x.example", {"etag": "1"}, {"etag": url})]
    report = compare_run(captures(spark, rows), RULES, str(tmp_path), plan=plan)
    saved = spark.read.json(report.diff_path).collect()
    assert {r.req_id: r.request.url for r in saved} == ids
    assert {tuple(r.request.headers) for r in saved} == {("/r", "UA")}


def test_nothing_differs_nothing_is_written(spark, tmp_path):
    rows = [r for i in range(20) for r in quad(i, "x", {"etag": "1"}, {"etag": "1"})]
    report = compare_run(captures(spark, rows), RULES, str(tmp_path))
    assert report.diff_path is None and not list(tmp_path.iterdir())
    assert tuple(report.summary.first()) == (20, 0, 100.0, False)
    assert report.errors.count() == 0


def test_gate(spark):
    rows = [r for i in range(20) for r in quad(i, "x", {"etag": "1"}, {"etag": "12"[i == 7]})]
    labelled = compare_captures(captures(spark, rows), RULES)
    assert tuple(pass_ratio(labelled).first()) == (20, 1, 95.0, False)
    assert pass_ratio(labelled, 95.01).first().failing is True
    empty = labelled.where("req_id < 0")
    assert tuple(pass_ratio(empty).first()) == (0, 0, None, False)
    assert differing(labelled).count() == 1 and error_histogram(labelled).first().n == 1


def test_single_url(spark):
    rows = [*quad(1, "a", {"etag": '"88f94-1"'}, {"etag": '"ebad6-1"'})]
    rows += [*quad(2, "b", {"etag": "1"}, {"etag": "2"}), *quad(3, "b", {}, {}, test2="error")]
    frame = captures(spark, rows)
    one = compare_url(frame, "http://a/1", RULES, "get").first()
    assert one.error == "" and one.headers_prod_1st["round"] == "1" and one.domain == "a"
    assert compare_url(frame, "http://b/2", RULES).first().error == "etag"
    assert compare_url(frame, "http://b/3", RULES).count() == 0
    assert compare_url(frame, "http://b/2", RULES, "HEAD").count() == 0


def test_only_compared_headers_are_shuffled(spark):
    rows, _ = run_pairs(4)
    plan = compare_captures(captures(spark, rows), RULES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(req_id") == 1
    assert "Python" not in text

"""Daily rollups, hash-first counting, versioned folders, rules and options in tables."""

import datetime as dt
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from headerwise.operators import heavy_hitters, rule_tables
from headerwise.operators.difference import label_differences
from headerwise.operators.rule_tables import label_by_table, rules_from_table
from headerwise.operators.rules import rules_from_rows
from headerwise.plans import collect as collecting
from headerwise.plans import rollups
from headerwise.plans.collect import collect, domain_counts, domain_list, top_requests, top_urls
from headerwise.plans.options import Options, resolve_options
from headerwise.plans.rollups import roll_up, rolled_days, rolled_log
from headerwise.schemas import ACCESS_LOG, TOP_REQUEST
from headerwise.sources import versions
from headerwise.sources.access_log import check_index, read_access_log
from headerwise.sources.local import small_table
from headerwise.sources.request_files import broken_request_files, domain_names, read_diffs, write_diffs
from headerwise.sources.scratch import Stored
from tests.test_collect import log, random_log, requests_of, urls_of

PARAMS = Options(min_count=20, top_urls=3, top_agents=3, top_referers=3)
DAYS = [dt.date(2015, 10, day) for day in range(11, 16)]


@pytest.fixture
def daily(spark, tmp_path):
    """Five days of a random log, as a partitioned table."""
    root = str(tmp_path / "log")
    rng = random.Random(8)
    rows = [(*r, dt.datetime(2015, 10, 11), rng.choice(DAYS)) for r in random_log(3)]
    small_table(spark, ACCESS_LOG, rows).write.partitionBy("index_date").parquet(root)
    return root


def options(spark, rows):
    return resolve_options(rows.select("domain").distinct().where("domain IS NOT NULL"), PARAMS)


def files_read(df, part):
    """How many files the scans of the plan read whose location holds ``part``."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(
        scan.metrics().get("numFiles").get().value() for scan in scans if part in scan.toString()
    )


def test_rollup_equals_the_raw_log(spark, daily, tmp_path):
    path = str(tmp_path / "rollup")
    assert roll_up(spark, daily, path, before=DAYS[3]) == DAYS[:3]
    assert roll_up(spark, daily, path, before=DAYS[3]) == []
    days = [f"logstash-{d:%Y.%m.%d}" for d in DAYS[1:]]
    raw = read_access_log(spark, daily, days)
    rolled = rolled_log(spark, daily, path, days)
    wanted = options(spark, raw)
    assert requests_of(top_requests(rolled, wanted)) == requests_of(top_requests(raw, wanted))
    assert urls_of(top_urls(rolled, wanted, hashed=True)) == urls_of(top_urls(raw, wanted))
    urls = rolled_log(spark, daily, path, days, level="urls")
    assert urls_of(top_urls(urls, wanted)) == urls_of(top_urls(raw, wanted))
    assert domain_list(urls, 9, 1).collect() == domain_list(raw, 9, 1).collect()
    # the raw folders of rolled-up days are not read
    left = [f for d in DAYS[3:] for f in glob.glob(f"{daily}/index_date={d}/*.parquet")]
    assert files_read(rolled, "log]") == len(left) > 0
    assert files_read(raw, "log]") > len(left)
    pattern = rolled_log(spark, daily, path, "logstash-2015.10.1?")
    assert pattern.agg(F.sum("_rows")).first()[0] == read_access_log(spark, daily, "logstash-2015*").count()


def test_a_lost_run_is_not_read_and_done_again(spark, daily, tmp_path, monkeypatch):
    path = str(tmp_path / "rollup")

    def lost(*args):
        raise OSError("lost")

    # the first level is written, the second one is not, and no day has a mark
    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(rollups, "_read_level", lost)
        roll_up(spark, daily, path, before=DAYS[4])
    assert list((tmp_path / "rollup" / "counts").iterdir()) and rolled_days(spark, path) == {}
    raw = read_access_log(spark, daily, "logstash-*")
    assert rolled_log(spark, daily, path, "logstash-*").count() == raw.count()
    # then one of the days is marked, and the other ones are lost once more
    put, marked = rollups.put_mark, []

    def once(*args):
        if marked:
            lost()
        marked.append(put(*args))

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(rollups, "put_mark", once)
        roll_up(spark, daily, path, before=DAYS[4])
    assert list(rolled_days(spark, path)) == DAYS[:1]
    assert roll_up(spark, daily, path, before=DAYS[4]) == DAYS[1:4]
    total = rolled_log(spark, daily, path, "logstash-*").agg(F.sum("_rows")).first()[0]
    assert total == raw.count()


def test_redo_replaces_days_and_collect_uses_the_rollup(spark, daily, tmp_path):
    path = str(tmp_path / "rollup")
    roll_up(spark, daily, path, before=DAYS[2])
    more = small_table(spark, ACCESS_LOG, [("late.example", "get", "80", "/", "ua", None, dt.datetime(2015, 10, 11), DAYS[0])] * 9)
    more.write.mode("append").partitionBy("index_date").parquet(daily)
    run = lambda out: collect(
        spark, daily, ["late.example"], str(tmp_path / out), "logstash-2015.10.11", Options(min_count=9), rollup=path
    ).collect()
    assert run("one") == []
    assert roll_up(spark, daily, path, "logstash-2015.10.11", before=DAYS[2], redo=True) == DAYS[:1]
    assert [r["count"] for r in run("two")] == [9]
    with pytest.raises(ValueError, match="2015.10.20"):
        collect(spark, daily, ["x"], str(tmp_path / "no"), "logstash-2015.10.20", rollup=path)


def test_one_job_checks_all_names(spark, daily):
    logs = read_access_log(spark, daily, "logstash-*")
    names = [f"logstash-{d:%Y.%m.%d}" for d in DAYS] + ["logstash-2015.10.1?"]
    spark.sparkContext.setJobGroup("names", "")
    check_index(logs, names)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("names")
    spark.sparkContext.setJobGroup("", "")
    # the stages of one query, whatever the number of names
    assert len(jobs) <= 2
    with pytest.raises(ValueError, match=r"2015.10.16, logstash-2014\*"):
        check_index(logs, [*names[:5], "logstash-2015.10.16", "logstash-2014*"])


@pytest.mark.parametrize("seed", [1, 2])
def test_hashed_equals_plain(spark, seed, monkeypatch):
    rows = log(spark, random_log(seed))
    wanted = options(spark, rows)
    expected = urls_of(top_urls(rows, wanted))
    assert expected
    assert urls_of(top_urls(rows, wanted, hashed=True)) == expected
    # all keys share a few hashes: strangers keep their own counts and fall out
    with monkeypatch.context() as patch:
        patch.setattr(heavy_hitters, "key_hash", lambda keys: F.pmod(F.xxhash64(*keys), F.lit(3)))
        assert urls_of(top_urls(rows, wanted, hashed=True)) == expected
    # hashes that do not fit, and domains that are no literals
    with monkeypatch.context() as patch:
        patch.setattr(Stored, "number_fits_broadcast", lambda self: False)
        assert urls_of(top_urls(rows, wanted, hashed=True)) == expected
    monkeypatch.setattr(collecting.settings, "INLINE_DOMAINS", 0)
    assert urls_of(top_urls(rows, wanted, hashed=True)) == expected


def test_no_text_in_the_first_exchange(spark, daily, monkeypatch):
    seen = []

    def kept(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return Stored(df, 0, 0)

    monkeypatch.setattr(heavy_hitters, "stored", kept)
    logs = read_access_log(spark, daily, "logstash-*")
    top_urls(logs, options(spark, logs), hashed=True)
    exchange = [line for line in seen[0].splitlines() if "Exchange" in line]
    assert len(exchange) == 1 and "_hash" in exchange[0]
    below = seen[0][seen[0].index("Exchange") :]
    partial = next(line for line in below.splitlines() if "HashAggregate" in line)
    assert "keys=[_hash" in partial and "request" not in partial


def test_counts_of_a_group_of_domains(spark):
    rows = [("a.example", "get", "80", f"/{i}", "ua", None) for i in range(250)] * 4
    rows += [("a.example", "put", str(port), "/", "ua", None) for port in range(5)]
    names = domain_names(spark, ["a.example", "a.example", "none.example"])
    found = domain_counts(log(spark, rows), names, methods=["get"]).collect()
    assert [tuple(r) for r in found] == [("a.example", 1000)]
    assert domain_counts(log(spark, rows), names).first()["count"] == 1005


ROW = ("s.example", "get", "443", "/", "ua", "", 252)


def test_an_error_between_the_steps_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    old = small_table(spark, TOP_REQUEST, [ROW])
    path = write_diffs(old, str(tmp_path), "same")
    new = small_table(spark, TOP_REQUEST, [ROW, ROW])

    def lost(*args):
        raise OSError("lost")

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(versions, "put_mark", lost)
        write_diffs(new, str(tmp_path), "same")
    assert len(list((tmp_path / "same").glob("version=*"))) == 2
    assert read_diffs(spark, path, TOP_REQUEST).count() == 1
    reading = read_diffs(spark, path, TOP_REQUEST)
    write_diffs(new, str(tmp_path), "same")
    # who began before the replacement can go on, and the next one sees the new rows
    assert reading.count() == 1 and read_diffs(spark, path, TOP_REQUEST).count() == 2
    write_diffs(new, str(tmp_path), "same")
    assert len(versions.versions(spark, path)) == 2


RULES = [
    ("a0", 2, "etag", "suffix", None),
    ("a0", 1, "last-modified", "time_tolerance", "60"),
    ("a1", 1, "content-type", "skip", None),
    ("a2", 1, "etag", "suffix", None),
    ("default", 1, "etag", "exact", None),
    ("default", 2, "content-type", "exact", None),
]
RULE_TYPE = "domain string, seq int, header string, kind string, param string"


def test_rules_of_a_table_equal_those_of_rows(spark, monkeypatch):
    rng = random.Random(3)
    pick = lambda: {h: v for h in ("etag", "content-type", "last-modified")
                    if (v := rng.choice([None, "aaaaaax", "bbbbbbx", "c"])) is not None}
    rows = [(i, rng.choice(["a0", "a1", "a2", "a3", None]), pick(), pick()) for i in range(300)]
    kind = "req_id int, domain string, headers_prod map<string,string>, headers_test map<string,string>"
    pairs = spark.createDataFrame(rows, kind)
    names = RULE_TYPE.replace(" string", "").replace(" int", "").split(", ")
    plain = label_differences(pairs, rules_from_rows([dict(zip(names, r, strict=True)) for r in RULES]))
    expected = sorted(map(str, plain.select("req_id", "error").collect()))
    table = rules_from_table(spark.createDataFrame(RULES, RULE_TYPE))
    assert table.headers() == ["etag", "content-type", "last-modified"]
    assert sorted(map(str, label_by_table(pairs, table).select("req_id", "error").collect())) == expected
    monkeypatch.setattr(Stored, "fits_broadcast", lambda self: False)
    assert sorted(map(str, label_by_table(pairs, table).select("req_id", "error").collect())) == expected
    assert label_by_table(pairs, table).columns == plain.columns
    monkeypatch.setattr(rule_tables, "MOST_LISTS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        rules_from_table(spark.createDataFrame(RULES, RULE_TYPE))


def test_the_plan_does_not_grow_with_the_domains(spark):
    pairs = spark.createDataFrame(
        [(1, "h1", {"etag": "x"}, {"etag": "y"})],
        "req_id int, domain string, headers_prod map<string,string>, headers_test map<string,string>",
    )
    sizes = []
    for domains in (10, 10_000):
        rows = spark.range(domains).selectExpr(
            "concat('h', id) AS domain", "1 AS seq", "'etag' AS header",
            "if(id % 2 = 0, 'suffix', 'skip') AS kind", "CAST(NULL AS STRING) AS param",
        )
        found = label_by_table(pairs, rules_from_table(rows))
        assert [r.error for r in found.collect()] == [""]
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 100


def test_options_from_a_table(spark):
    rows = [("a", 2, 1, 5), ("a", 1, 7, None), ("b", 1, None, 9), (None, 1, 3, 3)]
    table = spark.createDataFrame(rows, "domain string, seq int, min_count int, top_urls int")
    found = resolve_options(domain_names(spark, ["a", "b", "c"]), Options(top_agents=4), table, PARAMS)
    got = {r.domain: (r.min_count, r.top_urls, r.top_agents, r.min_count_2) for r in found.collect()}
    assert got == {"a": (7, 3, 4, 2), "b": (20, 9, 4, 5), "c": (20, 3, 4, 5)}
    bad = spark.createDataFrame([("a", 1, 0)], "domain string, seq int, min_count int")
    with pytest.raises(Exception, match="min_count out of range for domain a"):
        resolve_options(domain_names(spark, ["a"]), per_domain=bad).collect()


def test_good_rows_of_a_file_with_a_cut_one_count(spark, tmp_path):
    row = json.dumps(dict(zip(TOP_REQUEST.names, ROW, strict=True)))
    (tmp_path / "cut.json").write_text("\n".join([row] * 5 + [row[:-9]]))
    found = broken_request_files(spark, str(tmp_path)).collect()
    assert [(r.file.split("/")[-1], r.rows) for r in found] == [("cut.json", 5)]

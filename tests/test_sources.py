import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.functions.index_names import check_no_wildcard, default_index, in_index
from headerwise.plans.collect import collect
from headerwise.plans.options import Options
from headerwise.schemas import ACCESS_LOG, TOP_REQUEST
from headerwise.sources import scratch
from headerwise.sources.access_log import read_access_log
from headerwise.sources.local import small_table
from headerwise.sources.request_files import (
    broken_request_files,
    diff_name,
    domain_names,
    read_diffs,
    read_requests,
    write_by_domain,
    write_diffs,
)

ROW = {
    "domain": "s.example.com",
    "method": "get",
    "ipport": "80",
    "request": "/x.png",
    "agent": "UA (a; b)",
    "referer": "",
    "count": 252,
}


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2))
    return str(path)


def top_rows(spark, *rows):
    return small_table(spark, TOP_REQUEST, [tuple(r.values()) for r in rows])


@pytest.fixture(scope="module")
def log_root(spark, tmp_path_factory):
    """Three days; the second one has the rows the collect run should find."""
    root = str(tmp_path_factory.mktemp("logs") / "log")
    rows = []
    for day, hits in ((13, 1), (14, 12), (15, 2)):
        date = dt.date(2015, 10, day)
        moment = dt.datetime(2015, 10, day, 6)
        rows += [("a.example", "get", "443", "/", "ua", None, moment, date)] * hits
        rows += [("b.example", "get", "80", "/b", "ua", "/r", moment, date)] * 3
    small_table(spark, ACCESS_LOG, rows).write.partitionBy("index_date").parquet(root)
    return root


def days_read(df):
    return sorted({r[0].day for r in df.select("index_date").distinct().collect()})


@pytest.mark.parametrize(
    ("index", "days"),
    [
        ("logstash-2015.10.14", [14]),
        ("logstash-2015*", [13, 14, 15]),
        ("logstash-2015.10.1?", [13, 14, 15]),
        (["logstash-*.14", "logstash-2015.10.13"], [13, 14]),
        ("logstash-2016*", []),
        (None, [15]),
    ],
)
def test_index_selection_reads_only_matching_folders(spark, log_root, index, days):
    logs = read_access_log(spark, log_root, index, as_of=dt.date(2015, 10, 16))
    assert days_read(logs) == days
    plan = logs._jdf.queryExecution().executedPlan().toString()
    if days:
        assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
        files = {r[0] for r in logs.select(F.input_file_name()).distinct().collect()}
        assert all(any(f"index_date=2015-10-{d}" in f for d in days) for f in files)


@pytest.mark.parametrize(
    "index", ["other-2015.10.14", "logstash-2015.13.40", ["logstash-2015*", "logstash-2015.10.1"]]
)
def test_malformed_index_is_an_error(spark, log_root, index):
    with pytest.raises(ValueError, match="not a daily index"):
        read_access_log(spark, log_root, index)


@pytest.mark.parametrize("index", ["other-2015.10.14", "logstash-2015.10.20", "logstash-2016*"])
def test_absent_index_keeps_earlier_rows(spark, log_root, tmp_path, index):
    out = str(tmp_path / "top")
    write_by_domain(top_rows(spark, dict(ROW, domain="a.example")), out)
    with pytest.raises(ValueError, match="index"):
        collect(spark, log_root, ["a.example"], out, index, allow_wildcards=True)
    assert [r.domain for r in read_requests(spark, out).collect()] == ["a.example"]


def test_collect_passes_methods_defaults_and_ranks(spark, log_root, tmp_path):
    run = lambda **kw: collect(
        spark, log_root, ["a.example"], str(tmp_path / "top"), "logstash-2015.10.14",
        defaults=Options(min_count=4), **kw
    ).collect()
    assert [r["count"] for r in run()] == [12]
    assert run(methods=["post"]) == []
    assert run(ranks=True)[0].method_rank == 1


def test_only_named_columns_are_read(spark, log_root):
    logs = read_access_log(spark, log_root, "logstash-2015*").where(F.col("domain") == "a.example")
    plan = logs.select("method")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<domain:string,method:string>" in plan
    assert "EqualTo(domain,a.example)" in plan


def test_pattern_marks_are_literal_elsewhere(spark):
    frame = small_table(spark, T.StructType().add("d", "date"), [(dt.date(2015, 10, 14),)])
    assert frame.where(in_index("logstash-2015.10*", F.col("d"))).count() == 1
    assert frame.where(in_index("logstash-2015+10*", F.col("d"))).count() == 0


def test_default_index_is_yesterday():
    assert default_index(dt.date(2015, 10, 11)) == "logstash-2015.10.10"
    assert default_index(dt.date(2016, 1, 1)) == "logstash-2015.12.31"


def test_wildcard_guard():
    for index in ("logstash-*", "logstash-2015.10.1?", ["logstash-2015.10.10", "logstash-*"]):
        with pytest.raises(ValueError):
            check_no_wildcard(index)
        check_no_wildcard(index, allow_wildcards=True)
    check_no_wildcard("logstash-2015.10.10")


def test_domain_names(spark, tmp_path):
    file = put(tmp_path / "group.json", ["x.example", "y.example"])
    assert [r[0] for r in domain_names(spark, ["a", "@b"]).collect()] == ["a", "@b"]
    replaced = domain_names(spark, ["@" + file, "ignored"])
    assert [r[0] for r in replaced.collect()] == ["x.example", "y.example"]
    with pytest.raises(ValueError):
        domain_names(spark, [])
    broken = put(tmp_path / "broken.json", '["x.example", ')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        domain_names(spark, ["@" + broken]).collect()


def test_array_files_by_glob(spark, tmp_path):
    other = dict(ROW, domain="t.example.com", referer="/r", count=50)
    put(tmp_path / "one.json", [ROW, other])
    put(tmp_path / "two.json", [ROW])
    put(tmp_path / "none.json", [])
    rows = read_requests(spark, str(tmp_path / "*.json"))
    assert rows.schema == TOP_REQUEST
    assert sorted(r["count"] for r in rows.collect()) == [50, 252, 252]
    assert read_requests(spark, [str(tmp_path / "two.json")]).first().asDict() == ROW


def test_broken_file_is_named(spark, tmp_path):
    put(tmp_path / "good.json", [ROW])
    put(tmp_path / "bad.json", '[{"domain": "x", ')
    with pytest.raises(Exception, match=r"bad\.json"):
        read_requests(spark, str(tmp_path / "*.json")).collect()
    found = broken_request_files(spark, str(tmp_path / "*.json")).collect()
    assert [(r.file.split("/")[-1], r.rows) for r in found] == [("bad.json", 0)]


@pytest.mark.parametrize("text", ["[] []", '[{"domain": "x"}]]', "[],[]", '[{"domain": "x"}] and', '{"domain": '])
def test_text_after_the_array_is_an_error(spark, tmp_path, text):
    path = put(tmp_path / "odd.json", "\n" + text)
    with pytest.raises(Exception, match=r"odd\.json"):
        read_requests(spark, path).collect()
    assert [r.file.split("/")[-1] for r in broken_request_files(spark, path).collect()] == ["odd.json"]


def test_both_forms_in_one_call(spark, tmp_path):
    put(tmp_path / "array.json", [ROW, ROW])
    put(tmp_path / "lines.json", json.dumps(ROW) + "\n[]\n\n" + json.dumps(ROW))
    put(tmp_path / "blank.json", "\n")
    assert read_requests(spark, str(tmp_path)).count() == 4
    assert read_requests(spark, str(tmp_path / "blank.json")).count() == 0
    assert broken_request_files(spark, str(tmp_path)).count() == 0


def test_a_closed_run_leaves_no_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    with pytest.raises(KeyError), scratch.scratch_run(spark):
        assert scratch.stored(top_rows(spark, ROW), "kept").rows == 1
        assert list((tmp_path / "headerwise").glob("run-*/kept-*"))
        raise KeyError
    assert not list((tmp_path / "headerwise").iterdir())


def test_diffs_replace_those_they_are_read_from(spark, tmp_path):
    rows = top_rows(spark, ROW, dict(ROW, count=1))
    path = write_diffs(rows, str(tmp_path), "same")
    again = read_diffs(spark, path, TOP_REQUEST).where("count > 1")
    assert write_diffs(again, str(tmp_path), "same") == path
    assert read_diffs(spark, path, TOP_REQUEST).count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["same"]


def test_one_folder_per_domain(spark, tmp_path):
    path = str(tmp_path / "out")
    names = domain_names(spark, ["s.example.com", "empty.example.com"])
    other = dict(ROW, domain="t.example.com", referer='q"uo\nte')
    write_by_domain(top_rows(spark, ROW, other), path, names)
    back = read_requests(spark, path)
    assert back.schema == TOP_REQUEST
    assert sorted(r.domain for r in back.collect()) == ["s.example.com", "t.example.com"]
    assert other in [r.asDict() for r in back.collect()]
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert folders == ["folder=empty.example.com", "folder=s.example.com", "folder=t.example.com"]

    # a rerun for one domain that now has nothing replaces only that domain's rows
    nothing = top_rows(spark, ROW).where("count < 0")
    write_by_domain(nothing, path, domain_names(spark, ["s.example.com"]))
    left = read_requests(spark, path).collect()
    assert [r.domain for r in left] == ["t.example.com"]


def test_diff_name():
    assert diff_name(dt.datetime(2015, 10, 11, 23, 1, 17)) == "2015-10-11-23-01.diff.json"


def test_collect_run(spark, log_root, tmp_path):
    out = str(tmp_path / "top")
    domains = ["a.example", "b.example", "a.example", "nope.example"]
    rows = collect(
        spark, log_root, domains, out, call=Options(min_count=4), as_of=dt.date(2015, 10, 15)
    )
    expected = [("a.example", "get", "443", "/", "ua", "", 12)]
    assert [tuple(r) for r in rows.collect()] == expected
    back = read_requests(spark, out)
    assert [tuple(r) for r in back.collect()] == expected
    with pytest.raises(ValueError):
        collect(spark, log_root, domains, out, index="logstash-*")
    wide = collect(
        spark,
        log_root,
        domains,
        out,
        "logstash-2015*",
        Options(min_count=9),
        allow_wildcards=True,
    )
    assert sorted(r["count"] for r in wide.collect()) == [9, 15]


def test_intermediate_tables_go_to_the_session_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    kept = scratch.stored(top_rows(spark, ROW, ROW), "kept")
    assert list((tmp_path / "headerwise").iterdir())
    assert kept.rows == 2
    text = sum(len(v) for v in ROW.values() if isinstance(v, str))
    assert kept.text_bytes == 2 * text
    assert kept.fits_broadcast() and not kept.fits_broadcast(100)


def test_shared_folder(spark):
    folder = scratch.shared_folder(spark)
    assert folder and folder == scratch.shared_folder(spark)


class _Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default):
            return {"spark.master": "yarn"}.get(key, default)


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        scratch.shared_folder(_Cluster())

"""Every operator as a query over the test tables."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headerwise.functions.index_names import index_name
from headerwise.functions.text import url_domain
from headerwise.operators.difference import header_label, label_differences
from headerwise.operators.pairing import pair_captures
from headerwise.operators.replay import (
    build_requests,
    guard_content,
    guarded_plan,
    shuffled,
)
from headerwise.operators.rule_tables import label_by_table, rules_from_table
from headerwise.operators.rules import (
    Rule,
    RuleSet,
    Suffix,
    TimeTolerance,
    WeakETag,
    rules_from_rows,
)
from headerwise.operators.sketches import sketched_terms, term_sketch
from headerwise.operators.top_terms import missing_counts, term_counts
from headerwise.plans.collect import (
    collect,
    domain_counts,
    domain_list,
    index_inventory,
    top_requests,
    top_urls,
)
from headerwise.plans.compare import (
    compare_captures,
    compare_run,
    compare_url,
    differing,
    error_histogram,
    pass_ratio,
)
from headerwise.plans.options import Options, resolve_options
from headerwise.plans.rollups import roll_up, rolled_log
from headerwise.schemas import URL_KEYS
from headerwise.settings import NO_DOMAIN
from headerwise.sources.access_log import read_access_log, select_index
from headerwise.sources.request_files import (
    broken_request_files,
    domain_names,
    read_diffs,
    read_requests,
    write_by_domain,
)
from headerwise.sources.scratch import new_path, written
from workload import views

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(2024, 1, 15)
GROUP = ["d0.example.com", "d1.example.com", "d1.example.com", "nope.example.com"]


def layers(rows: int) -> tuple[list[tuple[str, Options]], Options]:
    """Domain options and defaults; minimums in proportion to the rows of the log."""

    def least(of_60000: int) -> int:
        return max(1, rows * of_60000 // 60_000)

    per_domain = [
        ("d0.example.com", Options(min_count=least(250))),
        ("d1.example.com", Options(min_count=least(270))),
        ("d1.example.com", Options(min_count=least(10))),
        ("d2.example.com", Options(min_count=least(265), top_urls=5, top_referers=1)),
    ]
    return per_domain, Options(min_count=least(280), top_urls=3, top_agents=10, top_referers=2)


CALL = Options(top_agents=50)
ROLLED = Options(min_count=20, top_urls=3, top_agents=3, top_referers=2)
WIDE = Options(min_count=7, top_urls=40, top_agents=3, top_referers=2)

RULES = RuleSet(
    by_domain={
        "d0.example.com": [Rule("etag", Suffix(6))],
        "d1.example.com": [Rule("last-modified", TimeTolerance(3600))],
    }
)
SKIP_RULES = RuleSet(
    by_domain={"d2.example.com": [Rule("content-length", None), Rule("etag", None)]}
)
RULE_ROWS = [
    {"domain": "d0.example.com", "seq": 1, "header": "etag", "kind": "skip", "param": None},
    {"domain": "d0.example.com", "seq": 2, "header": "etag", "kind": "suffix", "param": None},
    {"domain": "d1.example.com", "seq": 1, "header": "last-modified", "kind": "time_tolerance_both", "param": "3600"},
    {"domain": "d2.example.com", "seq": 1, "header": "last-modified", "kind": "time_tolerance", "param": "0"},
]
CUSTOM_RULES = RuleSet(
    by_domain={"d3.example.com": [Rule("etag", lambda p, t: F.length(p) == F.length(t))]}
)
ONE_URL = "http://d1.example.com/o/33"


def _domains(spark: SparkSession, sf: str) -> DataFrame:
    return domain_list(views.access_log(spark, sf), 3, 1000)


def _index_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _as_text(index_inventory(views.event_log(spark, sf)))


def _index_select(spark: SparkSession, sf: str) -> DataFrame:
    index = ["logstash-2024.01.0*", "logstash-2024.01.2?", "logstash-2024.01.15"]
    return _as_text(index_inventory(select_index(views.event_log(spark, sf), index)))


def _default_index(spark: SparkSession, sf: str) -> DataFrame:
    day = select_index(views.event_log(spark, sf), as_of=AS_OF)
    return day.groupBy(index_name(F.col("index_date")).alias("index")).agg(
        F.count(F.lit(1)).alias("docs_count")
    )


def _as_text(inventory: DataFrame) -> DataFrame:
    return inventory.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")}
    )


def _domain_group(spark: SparkSession, sf: str) -> DataFrame:
    logs = views.access_log(spark, sf).where(F.col("ipport").isNotNull())
    return domain_counts(logs, domain_names(spark, GROUP), methods=["get"])


def _log_options(spark: SparkSession, sf: str) -> DataFrame:
    logs = views.access_log(spark, sf)
    per_domain, defaults = layers(logs.count())
    names = views.domains_of(logs).where(F.col("domain") != NO_DOMAIN)
    return resolve_options(names, CALL, per_domain, defaults)


def _wide_options(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_options(views.domains_of(views.wide_log(spark, sf)), WIDE)


def _options_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same options as ``log_options_resolve``, given as a table of all domains."""
    logs = views.access_log(spark, sf)
    names = views.domains_of(logs).where(F.col("domain") != NO_DOMAIN)
    n = logs.count()
    least = lambda of_60000: F.lit(max(1, n * of_60000 // 60_000))
    number = F.substring("domain", 2, 1)
    first = names.select(
        "domain",
        F.lit(1).alias("seq"),
        F.when(number == "0", least(250)).when(number == "1", least(270)).when(number == "2", least(265)).alias("min_count"),
        F.when(number == "2", 5).alias("top_urls"),
        F.when(number == "2", 1).alias("top_referers"),
    )
    later = first.withColumns({"seq": F.lit(2), "min_count": F.lit(1), "top_urls": F.lit(1)})
    return resolve_options(names, CALL, later.union(first), layers(n)[1])


def _top_urls(spark: SparkSession, sf: str) -> DataFrame:
    return top_urls(views.access_log(spark, sf), _log_options(spark, sf))


def _top_urls_methods(spark: SparkSession, sf: str) -> DataFrame:
    logs = views.access_log(spark, sf)
    return top_urls(logs, _log_options(spark, sf), methods=["get", "post"])


def _top_urls_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return top_urls(views.wide_log(spark, sf), _wide_options(spark, sf), ranks=True)


def _top_requests(spark: SparkSession, sf: str) -> DataFrame:
    return top_requests(views.access_log(spark, sf), _log_options(spark, sf))


def _top_requests_wide(spark: SparkSession, sf: str) -> DataFrame:
    return top_requests(views.wide_log(spark, sf), _wide_options(spark, sf))


def _top_requests_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return top_requests(views.wide_log(spark, sf), _wide_options(spark, sf), ranks=True)


def _missing_referer(spark: SparkSession, sf: str) -> DataFrame:
    return missing_counts(views.access_log(spark, sf), "referer", [*URL_KEYS, "agent"], 63)


def _req_build(spark: SparkSession, sf: str) -> DataFrame:
    plan = build_requests(_top_requests(spark, sf))
    return plan.select(
        "domain",
        "url",
        "method",
        "tunnel",
        F.element_at("headers", F.lit("User-Agent")).alias("user_agent"),
        F.element_at("headers", F.lit("Referer")).alias("referer"),
        "follow_redirect",
        "timeout",
    )


def _req_load(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "requests")
    options = written(_log_options(spark, sf), "options")
    rows = written(top_requests(views.access_log(spark, sf), options), "top-requests")
    write_by_domain(rows, path, options)
    return read_requests(spark, path)


def _array_files(rows: DataFrame, path: str, text: str = "value") -> None:
    """One file with one JSON array per domain; ``text`` may spoil some of them."""
    array = F.to_json(F.collect_list(F.struct(*[F.col(c) for c in rows.columns])))
    arrays = rows.groupBy("domain").agg(array.alias("value"))
    arrays.selectExpr("domain AS folder", f"{text} AS value").write.partitionBy("folder").text(path)


def _req_load_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows from two sets of array files, and a file with an empty array."""
    path = new_path(spark, "arrays")
    rows = written(_top_requests(spark, sf), "top-requests")
    _array_files(rows, f"{path}/one")
    _array_files(rows, f"{path}/two")
    spark.range(1).select(F.lit("[]").alias("value")).write.text(f"{path}/none")
    return read_requests(spark, f"{path}/*")


def _req_broken_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file is cut off, one has more text after its array."""
    path = new_path(spark, "broken")
    spoilt = (
        "CASE domain WHEN 'd1.example.com' THEN left(value, length(value) - 1)"
        " WHEN 'd2.example.com' THEN concat(value, ' and more') ELSE value END"
    )
    _array_files(written(_top_requests(spark, sf), "top-requests"), path, spoilt)
    found = broken_request_files(spark, path)
    return found.select(F.regexp_extract("file", "folder=([^/]+)", 1).alias("domain"), "rows")


def _stored_log(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "log")
    views.daily_log(spark, sf).write.partitionBy("index_date").parquet(path)
    return path


def _scan_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    index = ["logstash-2024.01.02", "logstash-2024.0?.06"]
    logs = read_access_log(spark, _stored_log(spark, sf), index)
    day = index_name(F.col("index_date")).alias("index")
    return logs.groupBy(day, "domain").agg(F.count(F.lit(1)).alias("count"))


def _rollup_top_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Days 1 to 4 are rolled up; of the selected days 3 to 6 only two are read raw."""
    root, path = _stored_log(spark, sf), new_path(spark, "rollup")
    roll_up(spark, root, path, "logstash-2024.01.*", before=dt.date(2024, 1, 5))
    days = [f"logstash-2024.01.0{day}" for day in range(3, 7)]
    logs = rolled_log(spark, root, path, days, level="urls")
    return top_urls(logs, resolve_options(views.domains_of(logs), ROLLED))


def _top_urls_hashed(spark: SparkSession, sf: str) -> DataFrame:
    return top_urls(views.wide_log(spark, sf), _wide_options(spark, sf), hashed=True)


def _domains_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """All requests of more than 200th of the rows, by a sketch of 200 counters a task,
    with the exact count and whether the sketch's interval holds it."""
    logs, keys = views.wide_log(spark, sf).fillna("", ["ipport"]), list(URL_KEYS)
    sketch = written(term_sketch(logs, keys, 200), "sketch")
    exact = term_counts(logs, keys).withColumnRenamed("count", "exact")
    frequent = exact.where(F.col("exact") * 200 > F.lit(logs.count()))
    found = frequent.join(sketched_terms(sketch, keys), keys, "left")
    inside = F.col("exact").between(F.col("count"), F.col("count") + F.col("error"))
    return found.select(*keys, "exact", F.coalesce(inside, F.lit(False)).alias("inside"))


def _collect_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole collect program, its domains from a file, its output read back."""
    root, out, names = _stored_log(spark, sf), new_path(spark, "top"), new_path(spark, "names")
    listed = F.lit(json.dumps([f"d{i}.example.com" for i in range(3)])).alias("value")
    spark.range(1).select(listed).write.text(names)
    per_domain, defaults = layers(spark.read.parquet(root).count())
    index = "logstash-2024.01.*"
    collect(
        spark, root, [f"@{names}"], out, index, CALL, per_domain, True, defaults=defaults
    )
    return read_requests(spark, out)


def _compare_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole compare program, its saved failing rows read back."""
    captures, plan = views.captures(spark, sf), views.replay_plan(spark, sf)
    report = compare_run(captures, RULES, new_path(spark, "diffs"), "saved", plan=plan)
    return report.diffs.select(
        "req_id",
        "error",
        F.col("request.url").alias("url"),
        F.col("request.method").alias("sent"),
        F.element_at("headers_prod", F.lit("etag")).alias("prod_etag"),
    )


def _guarded_plan(spark: SparkSession, sf: str) -> DataFrame:
    probes = views.probes(spark, sf).where("req_id % 43 <> 0")
    return guarded_plan(views.replay_plan(spark, sf), probes).select("req_id", "url", "method")


def _req_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return shuffled(_top_requests(spark, sf), seed=7)


def _content_guard(spark: SparkSession, sf: str) -> DataFrame:
    return guard_content(views.probes(spark, sf)).select("req_id", "verdict")


def _url_domain(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.table(spark, sf, "pages")
    return pages.select("page_id", "url", url_domain(F.col("url")).alias("domain"))


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    sets = {
        "prod_1st": "headers_prod_1st",
        "test_1st": "headers_test_1st",
        "prod": "headers_prod",
        "test": "headers_test",
    }
    return pair_captures(views.captures(spark, sf)).select(
        "req_id",
        "domain",
        "url",
        *[
            F.element_at(column, F.lit(header)).alias(f"{name}_{short}")
            for name, column in sets.items()
            for header, short in views.HEADERS.items()
        ],
    )


def _one_rule(rule: Rule) -> Query:
    short = views.HEADERS[rule.header]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        label = header_label(rule, F.col(f"p_{short}"), F.col(f"t_{short}"))
        return views.header_values(spark, sf).select(
            "req_id", F.coalesce(label, F.lit("")).alias("error")
        )

    return run


def _labelled(rules: RuleSet) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        pairs = views.header_pairs(spark, sf)
        return label_differences(pairs, rules).select("req_id", "domain", "error")

    return run


def _rules_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rules in a table for each of five hundred domains, of three different lists."""
    pairs = views.header_pairs(spark, sf)
    number = F.col("req_id") % 500
    pairs = pairs.withColumn("domain", F.concat(F.lit("h"), number, F.lit(".example.com")))
    def rule(seq: int, header: str, kind: str, param: str | None = None) -> str:
        param = "CAST(NULL AS STRING)" if param is None else f"'{param}'"
        return f"struct({seq} AS seq, '{header}' AS header, '{kind}' AS kind, {param} AS param)"

    kinds = (
        "CASE CAST(regexp_extract(domain, '[0-9]+', 0) AS INT) % 4"
        f" WHEN 0 THEN array({rule(1, 'etag', 'suffix', '6')})"
        f" WHEN 1 THEN array({rule(1, 'last-modified', 'time_tolerance', '3600')})"
        f" WHEN 2 THEN array({rule(2, 'etag', 'skip')}, {rule(1, 'content-length', 'skip')}) END"
    )
    rules = pairs.select("domain").distinct().selectExpr("domain", f"inline({kinds})")
    return label_by_table(pairs, rules_from_table(rules)).select("req_id", "domain", "error")


def _compare_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs under one name: readers get the rows of the second."""
    captures, out = views.captures(spark, sf), new_path(spark, "diffs")
    first = compare_run(captures, SKIP_RULES, out, "saved")
    again = compare_run(captures, RULES, out, "saved")
    found = read_diffs(spark, again.diff_path, first.diffs.schema)
    return found.select("req_id", "domain", "url", "error")


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return compare_captures(views.captures(spark, sf), RULES, ["domain"])


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    return differing(compare_captures(views.captures(spark, sf), RULES))


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return error_histogram(_compared(spark, sf))


def _ratio(spark: SparkSession, sf: str) -> DataFrame:
    return pass_ratio(_compared(spark, sf))


def _by_url(spark: SparkSession, sf: str) -> DataFrame:
    found = compare_url(views.captures(spark, sf), ONE_URL, RULES, "get")
    return found.select(
        "req_id",
        "domain",
        "url",
        F.element_at("headers_prod", F.lit("last-modified")).alias("prod_modified"),
        F.element_at("headers_test", F.lit("last-modified")).alias("test_modified"),
        F.element_at("headers_test_1st", F.lit("x-cache")).alias("test_1st_cache"),
        "error",
    )


QUERIES: dict[str, Query] = {
    "log_domains": _domains,
    "log_index_inventory": _index_inventory,
    "log_index_select": _index_select,
    "log_default_index": _default_index,
    "log_domain_group": _domain_group,
    "log_scan_partitioned": _scan_partitioned,
    "log_collect_run": _collect_run,
    "log_options_resolve": _log_options,
    "log_options_table": _options_table,
    "log_top_urls": _top_urls,
    "log_top_urls_methods": _top_urls_methods,
    "log_top_urls_ranked": _top_urls_ranked,
    "log_top_urls_hashed": _top_urls_hashed,
    "log_domains_sketch": _domains_sketch,
    "log_rollup_top_urls": _rollup_top_urls,
    "log_missing_referer": _missing_referer,
    "log_top_requests": _top_requests,
    "log_top_requests_wide": _top_requests_wide,
    "log_top_requests_ranked": _top_requests_ranked,
    "req_build": _req_build,
    "req_load": _req_load,
    "req_load_arrays": _req_load_arrays,
    "req_broken_files": _req_broken_files,
    "req_shuffle": _req_shuffle,
    "req_guarded_plan": _guarded_plan,
    "req_content_guard": _content_guard,
    "url_domain": _url_domain,
    "cmp_pair": _pair,
    "cmp_exact": _one_rule(Rule("content-type")),
    "cmp_weak_etag": _one_rule(Rule("etag", WeakETag())),
    "cmp_etag_suffix": _one_rule(Rule("etag", Suffix(6))),
    "cmp_time_tolerance": _one_rule(Rule("last-modified", TimeTolerance(3600))),
    "cmp_existence": _one_rule(Rule("content-length")),
    "cmp_skip_rule": _labelled(SKIP_RULES),
    "cmp_first_diff": _labelled(RULES),
    "cmp_rules_rows": _labelled(rules_from_rows(RULE_ROWS)),
    "cmp_rules_table": _rules_table,
    "cmp_run_versions": _compare_versions,
    "cmp_custom_rule": _labelled(CUSTOM_RULES),
    "cmp_run_saved": _compare_run,
    "cmp_diffs": _diffs,
    "cmp_errors": _errors,
    "cmp_ratio": _ratio,
    "cmp_by_url": _by_url,
}

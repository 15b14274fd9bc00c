"""Collecting from access logs: domains, indices, and the most frequent requests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headerwise import settings
from headerwise.functions.index_names import (
    check_no_wildcard,
    default_index,
    in_index,
    index_name,
)
from headerwise.operators.heavy_hitters import frequent_counts, frequent_hashes
from headerwise.operators.joins import measured_join
from headerwise.operators.members import member_counts
from headerwise.operators.top_terms import (
    COUNT,
    Level,
    nested_top_terms,
    term_counts,
    top_terms,
)
from headerwise.plans.options import DEFAULTS, Options, Scope, resolve_options
from headerwise.plans.rollups import rolled_log
from headerwise.schemas import REQUEST_KEYS, URL_KEYS
from headerwise.sources.access_log import check_index, read_access_log
from headerwise.sources.request_files import domain_names, write_by_domain
from headerwise.sources.scratch import stored, written


def domain_list(
    logs: DataFrame, size: int | None = None, min_count: int | None = None
) -> DataFrame:
    """The most frequent domains: ``domain, count``. Zero or None means the default."""
    named = logs.where(F.col("domain") != settings.NO_DOMAIN)
    return top_terms(
        named,
        "domain",
        size or settings.DOMAIN_LIST_SIZE,
        min_count or settings.DOMAIN_LIST_MIN_COUNT,
    )


def index_inventory(
    logs: DataFrame, index: str | Sequence[str] = settings.INDEX_PREFIX + "*"
) -> DataFrame:
    """Every matching daily index with its number of rows and time range."""
    return (
        logs.where(in_index(index, F.col("index_date")))
        .groupBy("index_date")
        .agg(
            F.count(F.lit(1)).alias("docs_count"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .select(index_name(F.col("index_date")).alias("index"), "docs_count", "first_ts", "last_ts")
    )


def _in_scope(logs: DataFrame, scope: Scope, methods: Sequence[str] | None) -> DataFrame:
    if scope.names is not None:
        logs = logs.where(F.col("domain").isin(scope.names))
    if methods is not None:
        logs = logs.where(F.col("method").isin(list(methods)))
    return logs


def _scope_counts(
    logs: DataFrame, scope: Scope, methods: Sequence[str] | None, by: Sequence[str]
) -> DataFrame:
    rows = _in_scope(logs, scope, methods)
    if scope.size is None:
        return term_counts(rows, by)
    return member_counts(rows, by, scope.size, ["domain"])


def _hashed_counts(
    logs: DataFrame, scope: Scope, methods: Sequence[str] | None
) -> DataFrame:
    """Counts of the URLs that can reach the least minimum of all domains; the others
    count under NULL, for the levels above."""
    rows = _in_scope(logs, scope, methods)
    if scope.size is not None:
        if not scope.size.fits_broadcast():
            return _scope_counts(logs, scope, methods, URL_KEYS)
        rows = measured_join(rows, scope.options.select("domain"), "domain", "left_semi", True)
    least = scope.options.agg(F.min("min_count")).first()[0] or 1
    frequent = frequent_hashes(rows, URL_KEYS, least)
    if not frequent.number_fits_broadcast():
        return _scope_counts(logs, scope, methods, URL_KEYS)
    return frequent_counts(rows, URL_KEYS[:-1], URL_KEYS[-1], frequent)


def _top_urls(
    logs: DataFrame,
    scope: Scope,
    methods: Sequence[str] | None,
    ranks: bool,
    hashed: bool = False,
) -> DataFrame:
    if hashed:
        counts = _hashed_counts(logs, scope, methods)
    else:
        counts = _scope_counts(logs, scope, methods, URL_KEYS)
    return nested_top_terms(
        scope.attach(counts, ["min_count", "top_urls"]),
        ["domain"],
        [
            Level("method", settings.TOP_METHODS, "min_count"),
            Level("ipport", settings.TOP_PORTS, "min_count"),
            Level("request", "top_urls", "min_count"),
        ],
        largest=scope.largest["top_urls"],
        ranks=ranks,
    )


def top_urls(
    logs: DataFrame,
    options: DataFrame,
    methods: Sequence[str] | None = None,
    ranks: bool = False,
    hashed: bool = False,
) -> DataFrame:
    """The most frequent (method, port, request) of each domain in ``options``.

    Any method can appear unless ``methods`` names the wanted ones. ``ranks`` adds
    the positions that give the report order: methods, then ports, then requests.

    ``hashed`` reads the log twice: the first time only 64-bit hashes of the URLs are
    shuffled and counted, at once; the second time only URLs whose hash reaches the
    least minimum. The result is the same. It pays where most URLs are long and rare.
    While the frequent hashes do not fit a broadcast, all URLs are counted after all.
    """
    return _top_urls(logs, Scope.of(options), methods, ranks, hashed)


def domain_counts(
    logs: DataFrame, domains: DataFrame, methods: Sequence[str] | None = None
) -> DataFrame:
    """Rows of each of the named ``domains`` that has any: ``domain, count``."""
    return _scope_counts(logs, Scope.of(resolve_options(domains)), methods, ["domain"])


def top_requests(
    logs: DataFrame,
    options: DataFrame,
    methods: Sequence[str] | None = None,
    ranks: bool = False,
) -> DataFrame:
    """The most frequent requests with user agent and referer, for all domains at once.

    Runs the first level right away and keeps it as a small written table: it
    decides which log rows the second level reads, and its size is measured before
    it is broadcast. Requests without a referer come out with referer ``''``, and
    separately from requests whose referer is the empty text. ``ranks`` adds the
    positions that give the report order; a missing referer has position 0.
    """
    scope = Scope.of(options)
    urls = stored(_top_urls(logs, scope, methods, ranks), "top-urls")
    counts = member_counts(_in_scope(logs, scope, methods), REQUEST_KEYS, urls, URL_KEYS)
    nested = nested_top_terms(
        scope.attach(counts, ["min_count_2", "top_agents", "top_referers"]),
        URL_KEYS,
        [
            Level("agent", "top_agents", "min_count_2"),
            Level("referer", "top_referers", "min_count_2", missing=True),
        ],
        largest=max(scope.largest["top_agents"], scope.largest["top_referers"]),
        ranks=ranks,
    ).withColumn("referer", F.coalesce("referer", F.lit("")))
    if not ranks:
        return nested
    return measured_join(nested, urls.table.drop(COUNT), URL_KEYS, "inner", urls.fits_broadcast())


def collect(
    spark: SparkSession,
    root: str,
    domains: Sequence[str],
    out: str,
    index: str | Sequence[str] | None = None,
    call: Options = Options(),
    per_domain: Sequence[tuple[str, Options]] = (),
    allow_wildcards: bool = False,
    as_of: dt.date | None = None,
    methods: Sequence[str] | None = None,
    defaults: Options = DEFAULTS,
    ranks: bool = False,
    rollup: str | None = None,
) -> DataFrame:
    """The whole collect run: read the index, find the top requests of the domains,
    write them as JSON per domain, and return them.

    With ``rollup``, the folder of a rollup of this log, only days that it lacks are
    read from the log.

    An index without rows is an error before anything is written; a domain without
    rows in it gets an empty array. ``ranks`` adds the report order to the returned
    rows, not to the files.
    """
    index = index or default_index(as_of)
    check_no_wildcard(index, allow_wildcards)
    if rollup is None:
        logs = read_access_log(spark, root, index)
    else:
        logs = rolled_log(spark, root, rollup, index)
    check_index(logs, index)
    names = domain_names(spark, domains)
    options = resolve_options(names, call, per_domain, defaults)
    rows = written(top_requests(logs, options, methods, ranks), "top-requests")
    write_by_domain(rows, out, names)
    return rows

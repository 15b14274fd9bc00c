"""The tables of the engine, derived row by row from the given test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEME = "http://"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct values, many rows of each."""
    rows = table(spark, sf_dir, "lineitem")
    return access_log_of(rows.withColumn("index_date", F.col("l_shipdate").cast("date")))


def access_log_of(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "CASE WHEN l_suppkey % 6 = 5 THEN '-' ELSE concat('d', l_suppkey % 6, '.example.com') END"
        " AS domain",
        "CASE l_returnflag WHEN 'A' THEN 'get' WHEN 'N' THEN 'head' ELSE 'post' END AS method",
        "CASE WHEN l_quantity >= 49 THEN NULL WHEN l_linestatus = 'O' THEN '443' ELSE '80' END"
        " AS ipport",
        "concat('/p/', l_partkey % 6) AS request",
        "CASE WHEN l_linenumber <= 5 THEN 'ua-0' ELSE 'ua-1' END AS agent",
        "CASE WHEN l_discount < 0.035 THEN NULL WHEN l_discount < 0.045 THEN ''"
        " WHEN l_discount < 0.075 THEN '/r/0' ELSE '/r/1' END AS referer",
        "index_date",
    )


def wide_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many distinct URLs, agents and referers, and one request with a third of all rows."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 3 = 0 THEN 'hot.example.com'"
        " ELSE concat('d', l_suppkey % 3, '.example.com') END AS domain",
        "CASE WHEN l_orderkey % 3 = 0 OR l_returnflag <> 'R' THEN 'get' ELSE 'post' END AS method",
        "CASE WHEN l_orderkey % 3 = 0 THEN '443' WHEN l_quantity >= 49 THEN NULL"
        " WHEN l_quantity >= 40 THEN '8080' WHEN l_linestatus = 'O' THEN '443' ELSE '80' END"
        " AS ipport",
        "CASE WHEN l_orderkey % 3 = 0 THEN '/' ELSE concat('/p/', l_partkey % 300) END AS request",
        "CASE WHEN l_orderkey % 3 = 0 THEN 'ua-hot' ELSE concat('ua-', l_linenumber) END AS agent",
        "CASE WHEN l_discount < 0.035 THEN NULL WHEN l_orderkey % 3 = 0 THEN '/hot'"
        " ELSE concat('/r/', l_suppkey % 5) END AS referer",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("ts", "CAST(ts AS DATE) AS index_date")


def _http_date(ts: str) -> str:
    # the time is cut from the text, so that no session time zone can shift it
    day = f"date_format(CAST({ts} AS DATE), 'EEE, dd MMM yyyy')"
    return f"concat({day}, ' ', substring(CAST({ts} AS STRING), 12, 8), ' GMT')"


def header_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production (p_) and test (t_) header values of one request per order."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr("o_orderkey AS k", "CAST(o_custkey AS STRING) AS c", "o_orderdate AS d")
        .selectExpr(
            "k AS req_id",
            "concat('d', k % 4, '.example.com') AS domain",
            f"concat('{SCHEME}', 'd', k % 4, '.example.com/o/', k) AS url",
            "'text/html' AS p_type",
            "IF(k % 101 = 0, 'image/png', 'text/html') AS t_type",
            "IF(k % 13 = 0, NULL, c) AS p_length",
            "CASE WHEN k % 13 = 0 AND k % 2 = 0 THEN NULL WHEN k % 17 = 0 THEN '7' ELSE c END"
            " AS t_length",
            "IF(k % 3 = 0, concat('W/\"a', k, '\"'), concat('\"88f94-', c, '\"')) AS p_etag",
            "CASE WHEN k % 3 = 0 THEN 'W/\"b\"' WHEN k % 7 = 0 THEN concat('\"ebad6-', c, '\"')"
            " ELSE concat('\"88f94-', c, '\"') END AS t_etag",
            f"{_http_date('d')} AS p_modified",
            "CASE WHEN k % 23 = 0 THEN 'garbage'"
            f" WHEN k % 5 = 0 THEN {_http_date('d + INTERVAL 2 HOURS')}"
            f" WHEN k % 11 = 0 THEN {_http_date('d - INTERVAL 2 HOURS')}"
            f" WHEN k % 9 = 0 THEN {_http_date('d - INTERVAL 30 MINUTES')}"
            f" ELSE {_http_date('d')} END AS t_modified",
            "'HIT' AS p_cache",
            "IF(k % 29 = 0, 'MISS', 'HIT') AS t_cache",
        )
    )


HEADERS = {
    "content-type": "type",
    "content-length": "length",
    "etag": "etag",
    "last-modified": "modified",
    "x-cache": "cache",
}


def _headers(side: str, cache: str | None = None) -> str:
    pairs = [
        f"'{name}', " + (f"'{cache}'" if cache and short == "cache" else f"{side}_{short}")
        for name, short in HEADERS.items()
    ]
    return f"map({', '.join(pairs)})"  # a NULL value means the header is absent


def header_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_values(spark, sf_dir).selectExpr(
        "req_id",
        "domain",
        "url",
        f"{_headers('p')} AS headers_prod",
        f"{_headers('t')} AS headers_test",
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four responses per request; one of them is a timeout for every 31st request."""
    responses = [
        f"struct('prod' AS side, 1 AS round, 'ok' AS status, {_headers('p', 'MISS')} AS headers)",
        f"struct('test' AS side, 1 AS round, 'ok' AS status, {_headers('t', 'MISS')} AS headers)",
        f"struct('prod' AS side, 2 AS round, 'ok' AS status, {_headers('p')} AS headers)",
        "struct('test' AS side, 2 AS round, IF(req_id % 31 = 0, 'timeout', 'ok') AS status,"
        f" {_headers('t')} AS headers)",
    ]
    return header_values(spark, sf_dir).selectExpr(
        "req_id", "domain", "url", "'GET' AS method", f"inline(array({', '.join(responses)}))"
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = (
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 'abc'"
        " ELSE CAST(CAST(round(o_totalprice * 4) AS BIGINT) AS STRING) END"
    )
    kind = "IF(o_orderkey % 3 = 0, 'video/mp4', 'text/html')"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS req_id",
        "IF(o_orderkey % 5 = 0, 'HEAD', 'GET') AS method",
        "IF(o_orderkey % 37 = 0, 'timeout', 'ok') AS status",
        f"map('content-length', {length}, 'content-type', {kind}) AS headers",
    )


def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``access_log`` over seven days, with all columns of the log table."""
    day = "date_add(DATE'2024-01-01', CAST(l_linenumber - 1 AS INT)) AS index_date"
    days = table(spark, sf_dir, "lineitem").selectExpr(day, "*")
    return access_log_of(days).withColumn("ts", F.col("index_date").cast("timestamp"))


def replay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per order; those of every 43rd have no probe."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS req_id",
        f"concat('{SCHEME}', 'd', o_orderkey % 4, '.example.com/o/', o_orderkey) AS url",
        "IF(o_orderkey % 5 = 0, 'HEAD', 'GET') AS method",
        "map('User-Agent', 'ua') AS headers",
    )


def domains_of(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("domain").isNotNull()).select("domain").distinct()

"""The same queries as SQL on the given tables, written independently of the jobs."""

from __future__ import annotations

ACCESS_LOG = """access_log AS (
  SELECT
    CASE WHEN l_suppkey % 6 = 5 THEN '-'
         ELSE 'd' || CAST(l_suppkey % 6 AS VARCHAR) || '.example.com' END AS domain,
    CASE l_returnflag WHEN 'A' THEN 'get' WHEN 'N' THEN 'head' ELSE 'post' END AS method,
    CASE WHEN l_quantity >= 49 THEN NULL WHEN l_linestatus = 'O' THEN '443' ELSE '80' END AS ipport,
    '/p/' || CAST(l_partkey % 6 AS VARCHAR) AS request,
    CASE WHEN l_linenumber <= 5 THEN 'ua-0' ELSE 'ua-1' END AS agent,
    CASE WHEN l_discount < 0.035 THEN NULL WHEN l_discount < 0.045 THEN ''
         WHEN l_discount < 0.075 THEN '/r/0' ELSE '/r/1' END AS referer
  FROM lineitem)"""

WIDE_LOG = """access_log AS (
  SELECT
    CASE WHEN l_orderkey % 3 = 0 THEN 'hot.example.com'
         ELSE 'd' || CAST(l_suppkey % 3 AS VARCHAR) || '.example.com' END AS domain,
    CASE WHEN l_orderkey % 3 = 0 OR l_returnflag <> 'R' THEN 'get' ELSE 'post' END AS method,
    CASE WHEN l_orderkey % 3 = 0 THEN '443' WHEN l_quantity >= 49 THEN NULL
         WHEN l_quantity >= 40 THEN '8080' WHEN l_linestatus = 'O' THEN '443' ELSE '80' END AS ipport,
    CASE WHEN l_orderkey % 3 = 0 THEN '/' ELSE '/p/' || CAST(l_partkey % 300 AS VARCHAR) END AS request,
    CASE WHEN l_orderkey % 3 = 0 THEN 'ua-hot'
         ELSE 'ua-' || CAST(l_linenumber AS VARCHAR) END AS agent,
    CASE WHEN l_discount < 0.035 THEN NULL WHEN l_orderkey % 3 = 0 THEN '/hot'
         ELSE '/r/' || CAST(l_suppkey % 5 AS VARCHAR) END AS referer
  FROM lineitem)"""

# All named domains, and the parameters the catalog gives them for this many rows.
OPTIONS = """options AS (
  SELECT *, (min_count + 3) // 4 AS min_count_2 FROM (
    SELECT domain,
           greatest(1, n * CASE domain WHEN 'd0.example.com' THEN 250 WHEN 'd1.example.com' THEN 270
                                       WHEN 'd2.example.com' THEN 265 ELSE 280 END // 60000) AS min_count,
           CASE domain WHEN 'd2.example.com' THEN 5 ELSE 3 END AS top_urls,
           50 AS top_agents,
           CASE domain WHEN 'd2.example.com' THEN 1 ELSE 2 END AS top_referers
    FROM (SELECT DISTINCT domain FROM access_log WHERE domain <> '-'),
         (SELECT count(*) AS n FROM access_log)))"""

WIDE_OPTIONS = """options AS (
  SELECT DISTINCT domain, 7 AS min_count, 40 AS top_urls, 3 AS top_agents, 2 AS top_referers,
         2 AS min_count_2
  FROM access_log)"""


def _urls(where: str = "") -> str:
    return f"""logs AS (
  SELECT a.*, o.min_count, o.min_count_2, o.top_urls, o.top_agents, o.top_referers
  FROM access_log a JOIN options o ON a.domain = o.domain {where}),
m AS (
  SELECT * FROM (
    SELECT domain, method, count(*) AS n,
           row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, method) AS rk
    FROM logs WHERE method IS NOT NULL GROUP BY domain, method, min_count
    HAVING count(*) >= min_count) WHERE rk <= 10),
p AS (
  SELECT * FROM (
    SELECT domain, method, ipport, count(*) AS n,
           row_number() OVER (PARTITION BY domain, method ORDER BY count(*) DESC, ipport) AS rk
    FROM logs SEMI JOIN m USING (domain, method)
    WHERE ipport IS NOT NULL GROUP BY domain, method, ipport, min_count
    HAVING count(*) >= min_count) WHERE rk <= 2),
u AS (
  SELECT * FROM (
    SELECT domain, method, ipport, request, count(*) AS n, top_urls,
           row_number() OVER (PARTITION BY domain, method, ipport
                              ORDER BY count(*) DESC, request) AS rk
    FROM logs SEMI JOIN p USING (domain, method, ipport)
    WHERE request IS NOT NULL GROUP BY domain, method, ipport, request, min_count, top_urls
    HAVING count(*) >= min_count) WHERE rk <= top_urls)"""


REQUESTS = """picked AS (SELECT * FROM logs SEMI JOIN u USING (domain, method, ipport, request)),
ag AS (
  SELECT * FROM (
    SELECT domain, method, ipport, request, agent, top_agents,
           row_number() OVER (PARTITION BY domain, method, ipport, request
                              ORDER BY count(*) DESC, agent) AS rk
    FROM picked WHERE agent IS NOT NULL
    GROUP BY domain, method, ipport, request, agent, min_count_2, top_agents
    HAVING count(*) >= min_count_2) WHERE rk <= top_agents),
inside AS (SELECT * FROM picked SEMI JOIN ag USING (domain, method, ipport, request, agent)),
ranked AS (
  SELECT domain, method, ipport, request, agent, '' AS referer, count(*) AS "count", 0 AS rk
  FROM inside WHERE referer IS NULL
  GROUP BY domain, method, ipport, request, agent, min_count_2 HAVING count(*) > min_count_2
  UNION ALL
  SELECT domain, method, ipport, request, agent, referer, n, rk FROM (
    SELECT domain, method, ipport, request, agent, referer, count(*) AS n, top_referers,
           row_number() OVER (PARTITION BY domain, method, ipport, request, agent
                              ORDER BY count(*) DESC, referer) AS rk
    FROM inside WHERE referer IS NOT NULL
    GROUP BY domain, method, ipport, request, agent, referer, min_count_2, top_referers
    HAVING count(*) >= min_count_2) WHERE rk <= top_referers),
top_requests AS (SELECT * EXCLUDE (rk) FROM ranked)"""

TOP_URLS = 'SELECT domain, method, ipport, request, n AS "count" FROM u'
TOP_REQUESTS = f"WITH {ACCESS_LOG}, {OPTIONS}, {_urls()}, {REQUESTS}"

INVENTORY = """SELECT 'logstash-' || strftime(ts, '%Y.%m.%d') AS "index", count(*) AS docs_count,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM events {where} GROUP BY 1"""

_DATE = "'%a, %d %b %Y %H:%M:%S GMT'"

HEADER_VALUES = f"""hv AS (
  SELECT k AS req_id, 'd' || CAST(k % 4 AS VARCHAR) || '.example.com' AS domain,
    'http://d' || CAST(k % 4 AS VARCHAR) || '.example.com/o/' || CAST(k AS VARCHAR) AS url,
    'text/html' AS p_type,
    CASE WHEN k % 101 = 0 THEN 'image/png' ELSE 'text/html' END AS t_type,
    CASE WHEN k % 13 = 0 THEN NULL ELSE c END AS p_length,
    CASE WHEN k % 13 = 0 AND k % 2 = 0 THEN NULL WHEN k % 17 = 0 THEN '7' ELSE c END AS t_length,
    CASE WHEN k % 3 = 0 THEN 'W/"a' || CAST(k AS VARCHAR) || '"'
         ELSE '"88f94-' || c || '"' END AS p_etag,
    CASE WHEN k % 3 = 0 THEN 'W/"b"' WHEN k % 7 = 0 THEN '"ebad6-' || c || '"'
         ELSE '"88f94-' || c || '"' END AS t_etag,
    strftime(d, {_DATE}) AS p_modified,
    CASE WHEN k % 23 = 0 THEN 'garbage'
         WHEN k % 5 = 0 THEN strftime(d + INTERVAL 2 HOUR, {_DATE})
         WHEN k % 11 = 0 THEN strftime(d - INTERVAL 2 HOUR, {_DATE})
         WHEN k % 9 = 0 THEN strftime(d - INTERVAL 30 MINUTE, {_DATE})
         ELSE strftime(d, {_DATE}) END AS t_modified,
    'HIT' AS p_cache,
    CASE WHEN k % 29 = 0 THEN 'MISS' ELSE 'HIT' END AS t_cache
  FROM (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderdate AS d FROM orders))"""

_SAME = {
    "exact": "{p} = {t}",
    "weak": "({p} = {t} OR (substr({p}, 1, 2) = 'W/' AND substr({t}, 1, 2) = 'W/'))",
    "suffix": "({p} = {t} OR substr({p}, 7) = substr({t}, 7))",
    "both": "coalesce(abs(epoch(try_strptime(substr({p}, 6), '%d %b %Y %H:%M:%S GMT'))"
    " - epoch(try_strptime(substr({t}, 6), '%d %b %Y %H:%M:%S GMT'))) < 3600, false)",
    "zero": "coalesce(epoch(try_strptime(substr({p}, 6), '%d %b %Y %H:%M:%S GMT'))"
    " - epoch(try_strptime(substr({t}, 6), '%d %b %Y %H:%M:%S GMT')) < 0, false)",
    "length": "length({p}) = length({t})",
    "time": "coalesce(epoch(try_strptime(substr({p}, 6), '%d %b %Y %H:%M:%S GMT'))"
    " - epoch(try_strptime(substr({t}, 6), '%d %b %Y %H:%M:%S GMT')) < 3600, false)",
}


def _step(header: str, short: str, kind: str = "exact") -> str:
    p, t = f"p_{short}", f"t_{short}"
    same = _SAME[kind].format(p=p, t=t)
    return (
        f"WHEN ({p} IS NULL) <> ({t} IS NULL) THEN '{header} existence' "
        f"WHEN {p} IS NOT NULL AND NOT {same} THEN '{header}' "
    )


_TYPE = _step("content-type", "type")
_LENGTH = _step("content-length", "length")
_WEAK = _step("etag", "etag", "weak")
_SUFFIX = _step("etag", "etag", "suffix")
_TIME = _step("last-modified", "modified", "time")
_MODIFIED = _step("last-modified", "modified")
_CACHE = _step("x-cache", "cache")

FIRST_DIFF = f"""CASE domain
  WHEN 'd0.example.com' THEN CASE {_SUFFIX}{_TYPE}{_LENGTH}{_MODIFIED}{_CACHE} ELSE '' END
  WHEN 'd1.example.com' THEN CASE {_TIME}{_TYPE}{_LENGTH}{_WEAK}{_CACHE} ELSE '' END
  ELSE CASE {_TYPE}{_LENGTH}{_WEAK}{_MODIFIED}{_CACHE} ELSE '' END END"""

_BOTH = _step("last-modified", "modified", "both")
_ZERO = _step("last-modified", "modified", "zero")
ROWS_DIFF = f"""CASE domain
  WHEN 'd0.example.com' THEN CASE {_SUFFIX}{_TYPE}{_LENGTH}{_MODIFIED}{_CACHE} ELSE '' END
  WHEN 'd1.example.com' THEN CASE {_BOTH}{_TYPE}{_LENGTH}{_WEAK}{_CACHE} ELSE '' END
  WHEN 'd2.example.com' THEN CASE {_ZERO}{_TYPE}{_LENGTH}{_WEAK}{_CACHE} ELSE '' END
  ELSE CASE {_TYPE}{_LENGTH}{_WEAK}{_MODIFIED}{_CACHE} ELSE '' END END"""

TABLE_DIFF = f"""CASE req_id % 500 % 4
  WHEN 0 THEN CASE {_SUFFIX}{_TYPE}{_LENGTH}{_MODIFIED}{_CACHE} ELSE '' END
  WHEN 1 THEN CASE {_TIME}{_TYPE}{_LENGTH}{_WEAK}{_CACHE} ELSE '' END
  WHEN 2 THEN CASE {_TYPE}{_MODIFIED}{_CACHE} ELSE '' END
  ELSE CASE {_TYPE}{_LENGTH}{_WEAK}{_MODIFIED}{_CACHE} ELSE '' END END"""

CUSTOM_DIFF = f"""CASE domain
  WHEN 'd3.example.com' THEN CASE {_step("etag", "etag", "length")}{_TYPE}{_LENGTH}{_MODIFIED}{_CACHE} ELSE '' END
  ELSE CASE {_TYPE}{_LENGTH}{_WEAK}{_MODIFIED}{_CACHE} ELSE '' END END"""

SKIP_DIFF = f"""CASE domain
  WHEN 'd2.example.com' THEN CASE {_TYPE}{_MODIFIED}{_CACHE} ELSE '' END
  ELSE CASE {_TYPE}{_LENGTH}{_WEAK}{_MODIFIED}{_CACHE} ELSE '' END END"""

# The long table of responses, and the requests whose four responses are all fine.
CAPTURES = f"""{HEADER_VALUES},
captures AS (
  SELECT req_id, 'prod' AS side, 1 AS round, 'ok' AS status FROM hv UNION ALL
  SELECT req_id, 'test', 1, 'ok' FROM hv UNION ALL
  SELECT req_id, 'prod', 2, 'ok' FROM hv UNION ALL
  SELECT req_id, 'test', 2, CASE WHEN req_id % 31 = 0 THEN 'timeout' ELSE 'ok' END FROM hv),
complete AS (
  SELECT req_id FROM captures GROUP BY req_id
  HAVING count(*) FILTER (WHERE status = 'ok') = 4 AND count(*) = 4),
compared AS (
  SELECT req_id, domain, url, 'GET' AS method, {FIRST_DIFF} AS error
  FROM hv SEMI JOIN complete USING (req_id))"""


def _one_rule(step: str) -> str:
    return f"WITH {HEADER_VALUES} SELECT req_id, CASE {step} ELSE '' END AS error FROM hv"


_PAIR_COLUMNS = ", ".join(
    f"{side}_{short} AS {prefix}_{short}"
    for prefix, side in (("prod", "p"), ("test", "t"))
    for short in ("type", "length", "etag", "modified", "cache")
)
_FIRST_COLUMNS = ", ".join(
    f"'MISS' AS {prefix}_1st_cache"
    if short == "cache"
    else f"{side}_{short} AS {prefix}_1st_{short}"
    for prefix, side in (("prod", "p"), ("test", "t"))
    for short in ("type", "length", "etag", "modified", "cache")
)

ORACLE: dict[str, str] = {
    "log_domains": f"""WITH {ACCESS_LOG}
SELECT domain, count(*) AS "count" FROM access_log WHERE domain <> '-'
GROUP BY domain HAVING count(*) >= 1000 ORDER BY 2 DESC, 1 LIMIT 3""",
    "log_index_inventory": INVENTORY.format(where=""),
    "log_index_select": INVENTORY.format(
        where="WHERE (ts >= '2024-01-01' AND ts < '2024-01-10')"
        " OR (ts >= '2024-01-20' AND ts < '2024-01-30')"
        " OR (ts >= '2024-01-15' AND ts < '2024-01-16')"
    ),
    "log_default_index": """SELECT 'logstash-2024.01.14' AS "index", count(*) AS docs_count
FROM events WHERE ts >= '2024-01-14' AND ts < '2024-01-15' HAVING count(*) > 0""",
    "log_domain_group": f"""WITH {ACCESS_LOG}
SELECT domain, count(*) AS "count" FROM access_log
WHERE domain IN ('d0.example.com', 'd1.example.com', 'nope.example.com')
  AND method = 'get' AND ipport IS NOT NULL GROUP BY domain""",
    "log_scan_partitioned": f"""WITH {ACCESS_LOG.replace("FROM lineitem", ", l_linenumber AS day FROM lineitem")}
SELECT 'logstash-2024.01.0' || day AS "index", domain, count(*) AS "count" FROM access_log
WHERE day IN (2, 6) GROUP BY ALL""",
    "log_collect_run": f"""{TOP_REQUESTS} SELECT * FROM top_requests
WHERE domain IN ('d0.example.com', 'd1.example.com', 'd2.example.com')""",
    "log_options_resolve": f"""WITH {ACCESS_LOG}, {OPTIONS}
SELECT domain, CAST(min_count AS BIGINT) AS min_count, CAST(top_urls AS BIGINT) AS top_urls,
       CAST(top_agents AS BIGINT) AS top_agents, CAST(top_referers AS BIGINT) AS top_referers,
       CAST(min_count_2 AS BIGINT) AS min_count_2 FROM options""",
    "log_options_table": f"""WITH {ACCESS_LOG}, {OPTIONS}
SELECT domain, CAST(min_count AS BIGINT) AS min_count, CAST(top_urls AS BIGINT) AS top_urls,
       CAST(top_agents AS BIGINT) AS top_agents, CAST(top_referers AS BIGINT) AS top_referers,
       CAST(min_count_2 AS BIGINT) AS min_count_2 FROM options""",
    "log_top_urls": f"WITH {ACCESS_LOG}, {OPTIONS}, {_urls()} {TOP_URLS}",
    "log_top_urls_methods": f"""WITH {ACCESS_LOG}, {OPTIONS},
{_urls("WHERE a.method IN ('get', 'post')")} {TOP_URLS}""",
    "log_top_urls_ranked": f"""WITH {WIDE_LOG}, {WIDE_OPTIONS}, {_urls()}
SELECT u.domain, u.method, u.ipport, u.request, u.n AS "count", CAST(m.rk AS INTEGER) AS method_rank,
       CAST(p.rk AS INTEGER) AS ipport_rank, CAST(u.rk AS INTEGER) AS request_rank
FROM u JOIN p ON (u.domain, u.method, u.ipport) = (p.domain, p.method, p.ipport)
       JOIN m ON (u.domain, u.method) = (m.domain, m.method)""",
    "log_top_urls_hashed": f"WITH {WIDE_LOG}, {WIDE_OPTIONS}, {_urls()} {TOP_URLS}",
    "log_domains_sketch": f"""WITH {WIDE_LOG}
SELECT domain, method, coalesce(ipport, '') AS ipport, request, count(*) AS exact, true AS inside
FROM access_log GROUP BY ALL HAVING count(*) * 200 > (SELECT count(*) FROM access_log)""",
    "log_rollup_top_urls": f"""WITH {ACCESS_LOG.replace("FROM lineitem", "FROM lineitem WHERE l_linenumber BETWEEN 3 AND 6")},
options AS (SELECT DISTINCT domain, 20 AS min_count, 3 AS top_urls, 3 AS top_agents, 2 AS top_referers,
         5 AS min_count_2 FROM access_log), {_urls()} {TOP_URLS}""",
    "log_missing_referer": f"""WITH {ACCESS_LOG}
SELECT domain, method, ipport, request, agent, count(*) AS "count" FROM access_log
WHERE referer IS NULL AND ipport IS NOT NULL GROUP BY ALL HAVING count(*) > 63""",
    "log_top_requests": f"{TOP_REQUESTS} SELECT * FROM top_requests",
    "log_top_requests_wide": f"""WITH {WIDE_LOG}, {WIDE_OPTIONS}, {_urls()}, {REQUESTS}
SELECT * FROM top_requests""",
    "log_top_requests_ranked": f"""WITH {WIDE_LOG}, {WIDE_OPTIONS}, {_urls()}, {REQUESTS}
SELECT ranked.* EXCLUDE (rk), CAST(m.rk AS INTEGER) AS method_rank,
       CAST(p.rk AS INTEGER) AS ipport_rank, CAST(u.rk AS INTEGER) AS request_rank,
       CAST(ag.rk AS INTEGER) AS agent_rank, CAST(ranked.rk AS INTEGER) AS referer_rank
FROM ranked JOIN ag USING (domain, method, ipport, request, agent)
     JOIN u USING (domain, method, ipport, request)
     JOIN p USING (domain, method, ipport) JOIN m USING (domain, method)""",
    "req_build": f"""{TOP_REQUESTS}
SELECT domain,
       CASE WHEN ipport = '443' THEN 'https://' ELSE 'http://' END || domain || request AS url,
       upper(method) AS method, false AS tunnel, agent AS user_agent, referer,
       false AS follow_redirect, 15000 AS timeout FROM top_requests""",
    "req_load": f"{TOP_REQUESTS} SELECT * FROM top_requests",
    "req_load_arrays": f"""{TOP_REQUESTS}
SELECT * FROM top_requests UNION ALL SELECT * FROM top_requests""",
    "req_broken_files": f"""{TOP_REQUESTS}
SELECT domain, CASE domain WHEN 'd1.example.com' THEN 0 ELSE count(*) END AS "rows"
FROM top_requests WHERE domain IN ('d1.example.com', 'd2.example.com') GROUP BY domain""",
    "req_guarded_plan": """SELECT k AS req_id,
  'http://d' || CAST(k % 4 AS VARCHAR) || '.example.com/o/' || CAST(k AS VARCHAR) AS url,
  CASE WHEN k % 5 = 0 THEN 'HEAD' ELSE 'GET' END AS method
FROM (SELECT o_orderkey AS k, o_totalprice AS price FROM orders)
WHERE k % 5 = 0
   OR (k % 43 <> 0 AND k % 37 <> 0 AND NOT (k % 7 = 0 AND k % 3 = 0)
       AND (k % 7 = 0 OR k % 41 = 0 OR CAST(round(price * 4) AS BIGINT) <= 1048576))""",
    "req_shuffle": f"{TOP_REQUESTS} SELECT * FROM top_requests",
    "req_content_guard": """SELECT req_id,
  CASE WHEN method <> 'GET' THEN 'keep'
       WHEN req_id % 37 = 0 THEN 'probe_error'
       WHEN length IS NULL THEN CASE WHEN kind = 'video/mp4' THEN 'video_unknown_length' ELSE 'keep' END
       WHEN TRY_CAST(length AS BIGINT) > 1048576 THEN 'too_big' ELSE 'keep' END AS verdict
FROM (SELECT o_orderkey AS req_id,
             CASE WHEN o_orderkey % 5 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 'abc'
                  ELSE CAST(CAST(round(o_totalprice * 4) AS BIGINT) AS VARCHAR) END AS length,
             CASE WHEN o_orderkey % 3 = 0 THEN 'video/mp4' ELSE 'text/html' END AS kind
      FROM orders)""",
    "url_domain": r"""SELECT page_id, url,
  coalesce(nullif(regexp_extract(url, '(http://|https://)?(\S+?)(/|$)', 2), ''), '-') AS domain
FROM pages""",
    "cmp_pair": f"""WITH {CAPTURES}
SELECT req_id, domain, url, {_FIRST_COLUMNS}, {_PAIR_COLUMNS}
FROM hv SEMI JOIN complete USING (req_id)""",
    "cmp_exact": _one_rule(_TYPE),
    "cmp_weak_etag": _one_rule(_WEAK),
    "cmp_etag_suffix": _one_rule(_SUFFIX),
    "cmp_time_tolerance": _one_rule(_TIME),
    "cmp_existence": _one_rule(_LENGTH),
    "cmp_skip_rule": f"WITH {HEADER_VALUES} SELECT req_id, domain, {SKIP_DIFF} AS error FROM hv",
    "cmp_first_diff": f"WITH {HEADER_VALUES} SELECT req_id, domain, {FIRST_DIFF} AS error FROM hv",
    "cmp_rules_rows": f"WITH {HEADER_VALUES} SELECT req_id, domain, {ROWS_DIFF} AS error FROM hv",
    "cmp_rules_table": f"""WITH {HEADER_VALUES}
SELECT req_id, 'h' || CAST(req_id % 500 AS VARCHAR) || '.example.com' AS domain, {TABLE_DIFF} AS error FROM hv""",
    "cmp_run_versions": f"WITH {CAPTURES} SELECT req_id, domain, url, error FROM compared WHERE error <> ''",
    "cmp_custom_rule": f"WITH {HEADER_VALUES} SELECT req_id, domain, {CUSTOM_DIFF} AS error FROM hv",
    "cmp_run_saved": f"""WITH {CAPTURES}
SELECT req_id, error, url, CASE WHEN req_id % 5 = 0 THEN 'HEAD' ELSE 'GET' END AS sent,
       p_etag AS prod_etag
FROM compared JOIN hv USING (req_id, domain, url) WHERE error <> ''""",
    "cmp_diffs": f"WITH {CAPTURES} SELECT * FROM compared WHERE error <> ''",
    "cmp_errors": f"""WITH {CAPTURES}
SELECT error, count(*) AS n FROM compared WHERE error <> '' GROUP BY error""",
    "cmp_ratio": f"""WITH {CAPTURES}
SELECT total, diffs, 100e0 * (total - diffs) / total AS ratio,
       coalesce(100e0 * (total - diffs) / total < 95, false) AS failing
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE error <> '') AS diffs FROM compared)""",
    "cmp_by_url": f"""WITH {HEADER_VALUES}
SELECT req_id, domain, url, p_modified AS prod_modified, t_modified AS test_modified,
       'MISS' AS test_1st_cache, {FIRST_DIFF} AS error
FROM hv WHERE url = 'http://d1.example.com/o/33' AND req_id % 31 <> 0""",
}

"""The replay plan: requests to send, their order, and the content-size guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerwise import settings
from headerwise.functions.text import leading_number
from headerwise.sources.scratch import written


def build_requests(rows: DataFrame, timeout_ms: int = settings.REQUEST_TIMEOUT_MS) -> DataFrame:
    """One request instruction per top-request row; its count plays no part."""
    scheme = F.when(F.col("ipport") == "443", F.lit("https://")).otherwise(F.lit("http://"))
    return rows.select(
        "domain",
        F.concat(scheme, F.col("domain"), F.col("request")).alias("url"),
        F.upper("method").alias("method"),
        F.lit(False).alias("tunnel"),
        F.create_map(
            F.lit("User-Agent"), F.col("agent"), F.lit("Referer"), F.col("referer")
        ).alias("headers"),
        F.lit(False).alias("follow_redirect"),
        F.lit(timeout_ms).alias("timeout"),
    )


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The rows in a random order that spreads each domain's load.

    The order comes from a seeded hash of each row, not from a random number, so a
    recomputed task or another partitioning gives the same order.
    """
    plain = [f.name for f in rows.schema if f.dataType.typeName() != "map"]
    return rows.orderBy(F.xxhash64(F.lit(seed), *plain))


def request_plan(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The requests in replay order with a ``req_id`` each, as a written table.

    Writing it fixes the ids: captures refer to them, also those of equal requests.
    """
    plan = build_requests(shuffled(rows, seed))
    return written(plan.withColumn("req_id", F.monotonically_increasing_id()), "request-plan")


def guard_verdict(
    method: Column,
    content_length: Column,
    content_type: Column,
    probe_ok: Column | None = None,
    limit: int = settings.TOO_BIG_CONTENT,
) -> Column:
    """``keep``, or why a request is not replayed. Only GET is probed."""
    is_get = F.upper(method) == "GET"
    verdict = F.when(
        is_get & content_length.isNull() & content_type.startswith("video"),
        F.lit("video_unknown_length"),
    ).when(is_get & (leading_number(content_length) > limit), F.lit("too_big"))
    if probe_ok is not None:
        failed = is_get & ~F.coalesce(probe_ok, F.lit(False))
        verdict = F.when(failed, F.lit("probe_error")).otherwise(verdict)
    return F.coalesce(verdict, F.lit("keep"))


def guarded_plan(
    plan: DataFrame, probes: DataFrame, limit: int = settings.TOO_BIG_CONTENT
) -> DataFrame:
    """``plan`` without the requests that the size probes speak against.

    A GET needs a probe that was answered; other methods are not probed and stay.
    Of several probes of one request the worst counts. Both sides meet by ``req_id``
    and only the verdicts are shuffled.
    """
    refused = guard_content(probes, limit).groupBy("req_id").agg(
        F.max(F.col("verdict") != "keep").alias("_refused")
    )
    joined = plan.join(refused.hint("merge"), "req_id", "left")
    needed = F.upper("method") == "GET"
    keep = ~needed | ~F.coalesce(F.col("_refused"), F.lit(True))
    return joined.where(F.coalesce(keep, F.lit(True))).drop("_refused")


def guard_content(probes: DataFrame, limit: int = settings.TOO_BIG_CONTENT) -> DataFrame:
    """Add ``verdict`` to probe rows (``method, status, headers``)."""
    headers = F.col("headers")
    return probes.withColumn(
        "verdict",
        guard_verdict(
            F.col("method"),
            F.element_at(headers, F.lit("content-length")),
            F.element_at(headers, F.lit("content-type")),
            F.col("status") == "ok",
            limit,
        ),
    )

"""Comparing captured responses: failing rows, error histogram, pass ratio and gate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerwise import settings
from headerwise.functions.text import url_domain
from headerwise.operators.difference import label_differences
from headerwise.operators.joins import measured_join
from headerwise.operators.members import filtered_members
from headerwise.operators.pairing import REQUEST, pair_captures, pair_compared
from headerwise.operators.rules import RuleSet
from headerwise.operators.rule_tables import RuleTable, label_by_table
from headerwise.sources.request_files import read_diffs, write_diffs
from headerwise.sources.scratch import Stored, stored, written


def compare_captures(
    captures: DataFrame, rules: RuleSet | RuleTable, request: Sequence[str] = REQUEST
) -> DataFrame:
    """``req_id``, the ``request`` columns (``domain`` at least) and ``error`` of every
    complete request; the label is ``''`` when both sides agree. Failed captures are
    gone before anything is counted. Only these columns and the compared headers of
    the second round are shuffled.
    """
    paired = pair_compared(captures, rules.headers(), request)
    label = label_by_table if isinstance(rules, RuleTable) else label_differences
    return label(paired, rules).select("req_id", *request, "error")


def differing(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("error") != "")


def error_histogram(labelled: DataFrame) -> DataFrame:
    """``error, n`` over the failing rows."""
    counts = labelled.groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    # tied to the count, so the filter stays above the aggregation: pushed below it,
    # Spark would evaluate all rules a second time to compute the label
    return counts.where(F.when(F.col("error") != "", F.col("n")) > 0)


def reported_ratio(summary: DataFrame) -> DataFrame:
    """The row of ``pass_ratio`` with ``report``, the ratio with two decimals as text."""
    return summary.withColumn("report", F.format_string("%.2f", "ratio"))


def pass_ratio(labelled: DataFrame, threshold: float = settings.PASSED_RATIO) -> DataFrame:
    """One row ``total, diffs, ratio, failing``.

    Without any response the ratio is NULL and the gate passes; see ``total``.
    """
    return (
        labelled.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("error") != "").alias("diffs"),
        )
        .withColumn(
            "ratio", F.try_divide(100.0 * (F.col("total") - F.col("diffs")), F.col("total"))
        )
        .withColumn("failing", F.coalesce(F.col("ratio") < threshold, F.lit(False)))
    )


def compare_url(captures: DataFrame, url: str, rules: RuleSet, method: str = "GET") -> DataFrame:
    """All header sets and the label of one URL; no row when a response is missing.

    The domain whose rules apply is read from the URL.
    """
    wanted = captures.where((F.col("url") == url) & (F.upper("method") == method.upper()))
    paired = pair_captures(wanted).withColumn("domain", url_domain(F.col("url")))
    return label_differences(paired, rules)


def with_header_sets(failing: Stored, captures: DataFrame) -> DataFrame:
    """The failing rows with all four header sets.

    The captures are filtered by the failing ids first, so that full header sets are
    shuffled for failing requests and few others; the join at the end is exact.
    """
    captures = filtered_members(captures, failing, ["req_id"])
    return measured_join(
        pair_captures(captures), failing.table, "req_id", "inner", failing.fits_broadcast()
    )


@dataclass(frozen=True)
class Report:
    diffs: DataFrame
    errors: DataFrame
    summary: DataFrame
    diff_path: str | None


def compare_run(
    captures: DataFrame,
    rules: RuleSet | RuleTable,
    out: str,
    name: str | None = None,
    threshold: float = settings.PASSED_RATIO,
    as_of: dt.datetime | None = None,
    plan: DataFrame | None = None,
) -> Report:
    """The whole compare run. The labels are written once and every report reads
    them; the failing rows are saved with their headers under ``out`` if there are
    any. With the replay ``plan`` they also get the ``request`` that was sent."""
    labels = compare_captures(captures, rules, ["domain"]).select("req_id", "error")
    labelled = written(labels, "compared")
    failing = stored(differing(labelled), "failing")
    diffs = with_header_sets(failing, captures)
    if plan is not None:
        request = F.struct("url", "method", "headers").alias("request")
        # the plan's header maps are not measured, so it is never broadcast
        diffs = measured_join(diffs, plan.select("req_id", request), "req_id", "left", False)
    path = write_diffs(diffs, out, name, as_of, failing.rows)
    if path is not None:
        diffs = read_diffs(captures.sparkSession, path, diffs.schema)
    return Report(diffs, error_histogram(labelled), pass_ratio(labelled, threshold), path)

"""The first difference between two header sets, as one column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.operators.pairing import header_struct
from headerwise.operators.rules import Rule, RuleSet


def header_label(rule: Rule, prod: Column, test: Column) -> Column:
    """NULL when the header passes the rule or is absent on both sides; else
    ``<header>``, or ``<header> existence`` when one side lacks it."""
    same = F.coalesce(rule.check(prod, test), F.lit(False))
    return (
        F.when(prod.isNull() & test.isNull(), F.lit(None))
        .when(prod.isNull() | test.isNull(), F.lit(f"{rule.header} existence"))
        .when(~same, F.lit(rule.header))
    )


def first_difference(rules: RuleSet, domain: Column, labels: Mapping[Rule, Column]) -> Column:
    """Label of the first rule that fails in the domain's order, ``''`` when none does.

    Domains with the same effective rules share one branch, so the expression grows
    with the number of different rule lists, not with the number of domains.
    """

    def first(sequence: Sequence[Rule]) -> Column:
        return F.coalesce(*[labels[rule] for rule in sequence], F.lit(""))

    default = first(rules.effective(None))
    branches = None
    for sequence, domains in rules.groups().items():
        chain = F if branches is None else branches
        branches = chain.when(domain.isin(domains), first(sequence))
    return default if branches is None else branches.otherwise(default)


def label_differences(
    rows: DataFrame,
    rules: RuleSet,
    prod: str = "headers_prod",
    test: str = "headers_test",
    domain: str = "domain",
) -> DataFrame:
    """Add ``error`` for two columns with header maps, or structs of header values.

    Every different rule is evaluated once per row, whatever the number of lists it
    is in, and rules of single domains only on rows of these domains. This keeps
    the generated code small enough for the JVM to compile.
    """
    headers = rules.headers()
    sides = {"_prod": F.col(prod), "_test": F.col(test)}
    if isinstance(rows.schema[prod].dataType, T.MapType):
        sides = {name: header_struct(column, headers) for name, column in sides.items()}
    labels = {}
    for i, (rule, domains) in enumerate(rules.uses().items()):
        label = header_label(rule, F.col("_prod")[rule.header], F.col("_test")[rule.header])
        if domains is not None:
            label = F.when(F.col(domain).isin(domains), label)
        labels[f"_rule{i}"] = label
    by_rule = dict(zip(rules.uses(), map(F.col, labels), strict=True))
    return (
        rows.withColumns(sides)
        .withColumns(labels)
        .withColumn("error", first_difference(rules, F.col(domain), by_rule))
        .drop(*sides, *labels)
    )

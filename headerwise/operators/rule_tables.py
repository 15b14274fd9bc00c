"""Rules of any number of domains, kept in a table.

Many domains share few different rule lists. Only these lists are compiled; each domain
is mapped to the number of its list by a join, so the plan does not grow with the number
of domains.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.operators.difference import label_differences
from headerwise.operators.rules import RuleSet, rules_from_rows
from headerwise.sources.local import small_table
from headerwise.sources.scratch import Stored, stored

#: The most different rule lists that are compiled into one plan.
MOST_LISTS = 500
#: The domain of rows that replace the built-in defaults.
DEFAULT = "default"

_RULE = ("header", "kind", "param")
_LIST = "_list"
_LISTS = T.StructType([T.StructField("rules", T.StringType()), T.StructField(_LIST, T.StringType())])


@dataclass(frozen=True)
class RuleTable:
    """The different rule lists by their numbers, and the number of each domain."""

    lists: RuleSet
    numbers: Stored

    def headers(self) -> list[str]:
        return self.lists.headers()


def rules_from_table(rows: DataFrame) -> RuleTable:
    """Rules from a table ``domain, seq, header, kind, param`` of any number of domains.

    Meanings and kinds are those of ``rules_from_rows``; rules with the same ``seq`` are
    taken by their header. Domains without rows have the defaults. More than MOST_LISTS
    different lists are an error, as each is compiled.
    """
    entry = F.struct("seq", "header", "kind", F.col("param").cast("string").alias("param"))
    own = rows.where(F.col("domain").isNotNull()).groupBy("domain")
    rules = F.transform(
        F.array_sort(F.collect_set(entry)), lambda e: F.struct(*[e[c].alias(c) for c in _RULE])
    )
    # as text, lists can be compared
    own = own.agg(F.to_json(rules, {"ignoreNullFields": "false"}).alias("rules"))
    own = stored(own, "rule-lists").table
    named = F.col("domain") != DEFAULT
    found = own.where(named).select("rules").distinct().limit(MOST_LISTS + 1).collect()
    if len(found) > MOST_LISTS:
        raise ValueError(f"more than {MOST_LISTS} different rule lists")
    lists = {str(i): row.rules for i, row in enumerate(sorted(found))}
    lists |= {DEFAULT: row.rules for row in own.where(~named).select("rules").collect()}
    compiled = rules_from_rows(
        {"domain": number, "seq": i, **rule}
        for number, text in lists.items()
        for i, rule in enumerate(json.loads(text))
    )
    numbered = small_table(
        rows.sparkSession, _LISTS, [(text, n) for n, text in lists.items() if n != DEFAULT]
    )
    # at most MOST_LISTS rows, which the driver has held
    numbers = own.where(named).join(F.broadcast(numbered), "rules").select("domain", _LIST)
    return RuleTable(compiled, stored(numbers, "rule-numbers"))


def label_by_table(
    rows: DataFrame,
    table: RuleTable,
    prod: str = "headers_prod",
    test: str = "headers_test",
    domain: str = "domain",
) -> DataFrame:
    """``label_differences`` with the rules of a table; the same ``error`` column.

    While the numbers were measured to fit, they are broadcast and no row is shuffled.
    Beyond that, rows meet them by domain, where Spark splits the rows of a hot domain.
    """
    numbers = table.numbers.table.withColumnRenamed("domain", "_domain")
    numbers = F.broadcast(numbers) if table.numbers.fits_broadcast() else numbers.hint("merge")
    rows = rows.join(numbers, F.col(domain) == F.col("_domain"), "left").drop("_domain")
    return label_differences(rows, table.lists, prod, test, _LIST).drop(_LIST)

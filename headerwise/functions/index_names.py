"""Daily index names (``logstash-YYYY.MM.DD``) as expressions on a date column."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from headerwise.settings import INDEX_PREFIX

_WILDCARDS = ("*", "?")
_EXACT = re.compile(re.escape(INDEX_PREFIX) + r"(\d{4})\.(\d{2})\.(\d{2})")


def index_name(date: Column) -> Column:
    return F.concat(F.lit(INDEX_PREFIX), F.date_format(date, "yyyy.MM.dd"))


def default_index(as_of: dt.date | None = None) -> str:
    """The index of the day before ``as_of`` (today in UTC when not given)."""
    as_of = as_of or dt.datetime.now(dt.timezone.utc).date()
    return INDEX_PREFIX + (as_of - dt.timedelta(days=1)).strftime("%Y.%m.%d")


def as_names(index: str | Sequence[str]) -> list[str]:
    return [index] if isinstance(index, str) else list(index)


def has_wildcard(index: str | Sequence[str]) -> bool:
    return any(mark in name for name in as_names(index) for mark in _WILDCARDS)


def check_no_wildcard(index: str | Sequence[str], allow_wildcards: bool = False) -> None:
    """Refuse patterns before anything is planned: they read every matching day."""
    if not allow_wildcards and has_wildcard(index):
        raise ValueError(f"index patterns with wildcards are not allowed here: {index!r}")


def index_day(name: str) -> dt.date:
    """The day of an exact index name; an error for anything else."""
    exact = _EXACT.fullmatch(name)
    try:
        return dt.date(*(int(part) for part in exact.groups()))
    except (AttributeError, ValueError):
        raise ValueError(f"not a daily index name or a pattern: {name!r}") from None


def _pattern(name: str) -> str:
    return "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in name)


def _matches(name: str, date: Column) -> Column:
    if has_wildcard(name):
        return index_name(date).rlike(f"^{_pattern(name)}$")
    return date == F.lit(index_day(name))


def matches_day(name: str, day: dt.date) -> bool:
    """Whether a pattern stands for the index of this day."""
    return re.fullmatch(_pattern(name), INDEX_PREFIX + day.strftime("%Y.%m.%d")) is not None


def in_index(index: str | Sequence[str], date: Column) -> Column:
    """Predicate on the date column: exact names, patterns, or several of both.

    It refers to the partition column only, so Spark lists just the matching
    folders whichever form is used.
    """
    return reduce(lambda a, b: a | b, (_matches(n, date) for n in as_names(index)), F.lit(False))

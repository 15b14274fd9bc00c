"""Text expressions: the domain part of a URL and leading integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headerwise.settings import NO_DOMAIN

# White space a URL's host may not contain, beyond the ASCII kind.
_SPACE = r"\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_HOST = rf"(http://|https://)?([^{_SPACE}]+?)(/|\z)"


def url_domain(url: Column) -> Column:
    """Host part of a URL, port and user info included; ``-`` when there is none."""
    host = F.regexp_extract(url, _HOST, 2)
    return F.when(host != "", host).otherwise(F.lit(NO_DOMAIN))


def leading_number(text: Column) -> Column:
    """Value of the whole number a text starts with, NULL when it starts with none.

    A double, so that digits beyond 64 bits still compare as big numbers.
    """
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("double")

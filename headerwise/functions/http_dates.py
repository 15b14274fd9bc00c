"""HTTP dates in their three standard text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = "d MMM yyyy HH:mm:ss z"
_OFFSET_FORM = "d MMM yyyy HH:mm:ss xx"


def parse_http_date(text: Column) -> Column:
    """Timestamp of an HTTP date, NULL when the text has none of the three forms.

    ``Sun, 06 Nov 1994 08:49:37 GMT``, ``Sunday, 06-Nov-94 08:49:37 GMT`` and
    ``Sun Nov  6 08:49:37 1994`` (UTC). Two-digit years from 50 on are 19xx.

    The zone may also be a numeric offset (``+0100``). The first form is parsed as it
    is; only texts that are not in it are rewritten, so that one more parse does.
    """
    text = F.trim(text)
    usual = F.when(
        text.rlike("^[A-Za-z]{3}, "), F.try_to_timestamp(F.substring(text, 6, 100), F.lit(_FORM))
    )
    return F.coalesce(usual, _rewritten(text))


def _rewritten(text: Column) -> Column:
    date = F.regexp_replace(text, r"^[A-Za-z]+,?\s+", "")
    date = F.regexp_replace(date, r"^(\d{1,2})-([A-Za-z]{3})-(?=[5-9]\d )", "$1 $2 19")
    date = F.regexp_replace(date, r"^(\d{1,2})-([A-Za-z]{3})-(?=[0-4]\d )", "$1 $2 20")
    date = F.regexp_replace(
        date, r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\S+)\s+(\d{4})$", "$2 $1 $4 $3 GMT"
    )
    offset = F.when(date.rlike(r"[+-]\d{4}$"), F.try_to_timestamp(date, F.lit(_OFFSET_FORM)))
    return F.coalesce(F.try_to_timestamp(date, F.lit(_FORM)), offset)

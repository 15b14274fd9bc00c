"""Personal data: patterns propose spans, validators confirm them, context scores them.

All of it is column expressions over one row at a time. A pattern's matches are
wrapped in two marks and the text is split at them, so the lengths of the pieces give
the positions. Patterns take runs whole (possessively, from where the run starts), so
none of them backtracks over a long text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerwise.llm.common import free_name, text_column

#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 20
#: A span of a kind that is not always reported needs this score.
THRESHOLD = 0.5
CONTEXT_BONUS = 0.35

_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass the Luhn checksum."""
    places = F.split(F.reverse(digits_of(match)), "")
    doubled = F.transform(
        places,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (d.cast("int") * 2) % 10 + F.when(d.cast("int") > 4, 1).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether letters as 10 to 35, first four characters last, leave 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda s, c: (s * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97,
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def octets(match: Column) -> Column:
    """Whether all dotted numbers are at most 255."""
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits_of(match)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap test that texts with a match pass, the validator, the score
    without context, context words, and whether the score decides."""

    name: str
    pattern: str
    test: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: str
    always: bool = False


def _has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


# The patterns of the four kinds that are always reported, written so
# that they match the same spans without backtracking. A run starts where the one
# before ended (\G) or after a character that cannot be part of it.
_MAIL = "[A-Za-z0-9._%+-]"
KINDS = [
    Kind(
        "email",
        rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda m: F.lit(True),
        0.9,
        "e-?mail|contact|write to|address",
        True,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _has_digit,
        octets,
        0.6,
        r"\bip\b|host|server|address|login",
        True,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        _has_digit,
        lambda m: digit_count(14, 19)(m) & luhn(m),
        0.8,
        "card|visa|credit|debit|payment",
        True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.contains("+"),
        digit_count(10, 15),
        0.7,
        r"phone|\btel|call|mobile|fax",
        True,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        _has_digit,
        mod97,
        0.9,
        "iban|account|bank|transfer",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        _has_digit,
        lambda m: F.lit(True),
        0.3,
        r"\bssn\b|social security",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        _has_digit,
        lambda m: F.lit(True),
        0.2,
        r"phone|\btel|call|mobile|fax",
    ),
]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(numbers: Column, first: Column) -> Column:
    """``first``, and then the sum with each further number."""
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    return F.aggregate(numbers, F.array(first), add)


def running_sum(numbers: Column) -> Column:
    """The sum up to each number of an array that is not empty.

    An array cannot grow in place, so sums are made for blocks of about the cube root
    of its length, and for the totals of the blocks.
    """

    def over(values: Column) -> Column:
        step = F.ceil(F.cbrt(F.size(values))).cast("int")
        starts = F.sequence(F.lit(1), F.size(values), step)
        blocks = F.transform(starts, lambda at: F.slice(values, at, step))
        return _bound(blocks, joined_up)

    def joined_up(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        before = F.slice(_sums(totals, F.lit(0)), F.lit(1), F.size(blocks))
        inside = lambda b, at: F.slice(_sums(b, at), F.lit(2), F.size(b))
        return F.flatten(F.zip_with(blocks, before, inside))

    return _bound(numbers, over)


def _spans(pieces: str, kind: Kind, rank: int) -> Column:
    """Confirmed spans from the pieces of a text: matches are at odd places."""
    none = F.array().cast(f"array<{_SPAN}>")

    def span(end: Column, i: Column) -> Column:
        lead, match = F.get(pieces, i - 1), F.get(pieces, i)
        near = F.concat_ws(
            " ", F.right(lead, F.lit(BEFORE)), F.left(F.get(pieces, i + 1), F.lit(AFTER))
        )
        score = F.lit(kind.score) + F.when(
            F.lower(near).rlike(kind.context), F.lit(CONTEXT_BONUS)
        ).otherwise(F.lit(0.0))
        score = F.least(score, F.lit(1.0))
        found = F.struct(
            (end - F.length(match)).cast("int").alias("start"),
            F.lit(rank).alias("rank"),
            end.cast("int").alias("end"),
            F.lit(kind.name).alias("kind"),
            score.alias("score"),
        )
        keep = kind.valid(match) if kind.always else kind.valid(match) & (score >= THRESHOLD)
        return F.when((i % 2 == 1) & (i < F.size(pieces) - 1) & keep, found)

    ends = running_sum(F.transform(pieces, lambda piece: F.length(piece)))
    found = F.filter(F.transform(ends, span), lambda s: s.isNotNull())
    return F.when(F.size(pieces) >= 3, found).otherwise(none)


def pii_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``: the spans of personal data in ``text``, as an array of ``(start,
    rank, end, kind, score)`` by start and then kind.

    Positions are code points from 0, the end is exclusive. Matches of one kind do not
    overlap; those of different kinds may. ``email``, ``ip``, ``card`` (Luhn) and
    ``phone`` are always reported, ``iban`` (modulo 97), ``ssn`` and ``local_phone``
    when pattern, validator and context words nearby give a score of 0.5. A null or
    empty text has no spans. A column called ``out`` is replaced; all other columns
    and all rows stay, repeated ones too. An empty table gives an empty result.
    """
    docs = text_column(docs.drop(out), text)
    clean, *parts = (free_name(docs.columns, f"_{n}") for n in ("clean", *(k.name for k in KINDS)))
    value = F.coalesce(F.col(text), F.lit(""))
    marked = value.contains(_OPEN) | value.contains(_CLOSE)
    # the marks cannot be part of any match, and neither can their stand-in
    safe = F.translate(value, _OPEN + _CLOSE, _OTHER * 2)
    rows = docs.withColumn(clean, F.when(marked, safe).otherwise(value))
    rows = rows.withColumns(
        {
            part: F.when(
                kind.test(F.col(clean)),
                F.split(
                    F.regexp_replace(clean, kind.pattern, f"{_OPEN}$0{_CLOSE}"),
                    f"[{_OPEN}{_CLOSE}]",
                ),
            ).otherwise(F.array().cast("array<string>"))
            for kind, part in zip(KINDS, parts, strict=True)
        }
    )
    rows = rows.withColumns(
        {part: _spans(part, kind, i) for i, (kind, part) in enumerate(zip(KINDS, parts, strict=True))}
    )
    return rows.withColumn(out, F.array_sort(F.concat(*parts))).drop(clean, *parts)


def _text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","
    )


def pii_digests(docs: DataFrame) -> DataFrame:
    """``pii_spans`` in short: ``doc_id``, the numbers of emails, addresses, cards and
    phones, ``base_sha256`` of those spans as ``kind:start:end,...``, ``spans`` (all
    spans likewise), ``scores`` and the other kinds' number ``n_other``."""
    rows = pii_spans(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = [k.name for k in KINDS if k.always]
    rows = rows.withColumn("base", F.filter("pii", lambda x: x.rank < len(base)))
    count = lambda kind: F.size(F.filter("pii", lambda x: x.kind == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.col("pii")).alias("spans"),
        F.transform("pii", lambda x: F.round(x.score, 2)).alias("scores"),
        (F.size("pii") - F.size("base")).cast("long").alias("n_other"),
    )

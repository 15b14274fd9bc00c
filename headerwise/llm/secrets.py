"""Secrets by assignment-aware lexing.

Three patterns are always reported. Beyond these, texts that name something sensitive
are lexed as source or configuration: names, string literals, assignment signs,
concatenation. Assignments give name-literal pairs, constants are followed through
later assignments, and each literal is scored by the most sensitive name it reaches
and by its own form.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerwise.llm.common import by_batch, column_text, extended, text_column

THRESHOLD = 0.6
MIN_LITERAL = 6

# The patterns that are always reported, with the length that the second
# group (or the whole match) needs.
BASE = (
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.ASCII | re.IGNORECASE,
        ),
        2,
        8,
    ),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]{32,}"), 0, 32),
)
RANK = {"assign": 0, "access": 1, "hex": 2, "literal": 3}

# How much a part of a name says that its value is secret.
SENSITIVE = {
    "password": 0.5, "passwd": 0.5, "pwd": 0.45, "passphrase": 0.5, "secret": 0.5, "token": 0.45,
    "credential": 0.4, "credentials": 0.4, "apikey": 0.5, "privatekey": 0.5, "accesskey": 0.5,
    "auth": 0.35, "bearer": 0.45, "signature": 0.3,
}
KEY_QUALIFIERS = {"api", "access", "private", "secret", "encryption", "signing", "master", "client"}
PLACEHOLDERS = re.compile(
    r"^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|change_?me|your[_-]?.*|example.*|dummy|none|null|true|false|todo.*)$",
    re.IGNORECASE,
)

_TOKEN = re.compile(
    r"""(?P<comment>(?:\#|//)[^\n]*)"""
    r"""|(?P<quote>["'])"""
    r"""|(?P<name>[A-Za-z_][\w.-]*)"""
    r"""|(?P<assign>:=|=>|=(?!=)|:(?!:))"""
    r"""|(?P<plus>\+)"""
    r"""|(?P<end>[\n;,{}])"""
    r"""|(?P<other>[^\s])"""
)
# what is between a quote and the next one of its kind, or the end of the line
_INSIDE = {q: re.compile(rf"(?:[^{q}\\\n]+|\\.)*+") for q in "\"'"}
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SPACES = re.compile(r"\x20*")
_BARE = re.compile(r"[^\s\"',;{}]+")
_HINT = re.compile("pass|pwd|secret|token|key|cred|auth|bearer|signature")


def sensitivity(name: str) -> float:
    """How sensitive a target name is, from 0 to 0.5, by its parts."""
    parts = [p.lower() for p in _PART.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    for left, right in zip(parts, parts[1:]):
        best = max(best, SENSITIVE.get(left + right, 0.0))
        if right in ("key", "keys") and left in KEY_QUALIFIERS:
            best = 0.5
    return best


#: Bits, spaces and characters beyond which a form's score stays the same.
FULL_BITS, MANY_SPACES, MANY = 80, 4, 1 << 40
_KINDS = [re.compile(k) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
_HEAD = 16


@dataclass(frozen=True)
class Form:
    """What the score of a text depends on, of bounded size and additive: a text that is
    put together from parts has the sum of their forms. ``counts`` of the characters are
    kept until they have ``FULL_BITS`` bits, as more text cannot lower these."""

    length: int = 0
    head: str = ""
    last: str = ""
    spaces: int = 0
    kinds: frozenset[int] = frozenset()
    counts: dict[str, int] | None = field(default_factory=dict)

    @staticmethod
    def of(text: str) -> Form:
        kinds = frozenset(i for i, kind in enumerate(_KINDS) if kind.search(text))
        counts = Counter(text)
        full = _bits(counts) >= FULL_BITS
        return Form(
            len(text), text[:_HEAD], text[-1:], text.count(" "), kinds, None if full else counts
        )

    def __add__(self, other: Form) -> Form:
        counts = None
        if self.counts is not None and other.counts is not None:
            both = self.counts.keys() | other.counts.keys()
            counts = {
                c: min(MANY, self.counts.get(c, 0) + other.counts.get(c, 0)) for c in both
            }
            if _bits(counts) >= FULL_BITS:
                counts = None
        return Form(
            min(MANY, self.length + other.length),
            (self.head + other.head)[:_HEAD] if self.length < _HEAD else self.head,
            other.last or self.last,
            min(MANY_SPACES, self.spaces + other.spaces),
            self.kinds | other.kinds,
            counts,
        )

    def strength(self) -> float:
        """How much the text looks like a secret, from 0 to 0.5."""
        if self.length < MIN_LITERAL or self.spaces >= MANY_SPACES:
            return 0.0
        # a longer text is told from a placeholder by its ends and its set of characters
        middle = "ab" if self.counts is None else "".join(self.counts)
        whole = self.head if self.length <= _HEAD else self.head + middle + self.last
        if PLACEHOLDERS.match(whole):
            return 0.0
        bits = FULL_BITS if self.counts is None else _bits(self.counts)
        kinds = len(self.kinds)
        return min(0.4, bits / 200) + (0.1 if kinds >= 3 else 0.05 if kinds == 2 else 0.0)


def _bits(counts: dict[str, int]) -> float:
    n = sum(counts.values())
    return -sum(c * math.log2(c / n) for c in counts.values())


@dataclass
class Assignment:
    """A target and the parts of its value in order: spans of literals, and numbers of
    earlier assignments whose value is taken over."""

    target: str
    parts: list[tuple[int, int] | int]


def lexed(text: str) -> list[Assignment]:
    """Every assignment of the text, by one pass over its tokens.

    A value is a literal, a name assigned before, a bare configuration value, or
    several of the first two joined by ``+``. A quoted name is a name, too. A quote
    without an end on its line is a sign like any other.
    """
    out: list[Assignment] = []
    known: dict[str, int] = {}
    target = value = None
    last, at, limit = "", 0, len(text)
    # a quote of this kind before this place has no end: none there is looked for twice
    endless = {"'": 0, '"': 0}

    def token(at: int) -> tuple[str, int, int] | None:
        m = _TOKEN.search(text, at)
        if not m:
            return None
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "quote":
            sign = m.group()
            if start < endless[sign]:
                return "other", start, end
            inside = _INSIDE[sign].match(text, end).end()
            if text[inside : inside + 1] != sign:
                endless[sign] = inside
                return "other", start, end
            return "string", start, inside + 1
        return kind, start, end

    def close() -> None:
        if value:
            known[target] = len(out)
            out.append(Assignment(target, value))

    while at < limit:
        found = token(at)
        if not found:
            break
        kind, start, at = found
        if value is None:
            if kind == "name":
                target = text[start:at]
            elif kind == "string":
                target = text[start + 1 : at - 1]
            elif kind == "assign" and target and last in ("name", "string"):
                value = []
                follow, begin = token(at), _SPACES.match(text, at).end()
                if not (
                    follow
                    and follow[1] == begin
                    and (follow[0] == "string" or text[begin : follow[2]] in known)
                ):
                    bare = _BARE.match(text, begin)
                    if bare:
                        value.append(bare.span())
                        at = bare.end()
            elif kind in ("end", "other", "comment"):
                target = None
            last = kind
        elif kind == "string" and last in ("assign", "plus"):
            value.append((start + 1, at - 1))
            last = kind
        elif kind == "name" and last in ("assign", "plus") and text[start:at] in known:
            value.append(known[text[start:at]])
            last = kind
        elif kind == "plus" and last in ("string", "name"):
            last = kind
        else:
            close()
            target, value, last = (text[start:at], None, kind) if kind == "name" else (None, None, kind)
    close()
    return out


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Name and distinct literal spans of every assignment, with constants followed.

    For a look at short sources: each list is spelled out, which ``literal_findings``
    never does.
    """
    found = lexed(text)
    spans: list[dict[tuple[int, int], None]] = []
    for one in found:
        own: dict[tuple[int, int], None] = {}
        for part in one.parts:
            own.update(spans[part] if isinstance(part, int) else {part: None})
        spans.append(own)
    return [(one.target, list(own)) for one, own in zip(found, spans, strict=True)]


def literal_findings(text: str) -> list[tuple[int, int, float, str]]:
    """``(start, end, score, name)`` of literals that look secret and reach a
    sensitive name; each literal once, with its best score and the first such name.

    Time and memory are in proportion to the text: forms are added up along the
    constants, and scores go back along them.
    """
    found = lexed(text)
    forms: list[Form] = []
    best: list[tuple[float, int]] = []
    for i, one in enumerate(found):
        form = Form()
        for part in one.parts:
            form = form + (forms[part] if isinstance(part, int) else Form.of(text[slice(*part)]))
        forms.append(form)
        weight, strength = sensitivity(one.target), form.strength()
        score = weight + strength if weight and strength else 0.0
        best.append((score, -i) if score >= THRESHOLD else (0.0, 0))
    out = []
    # whatever takes a value over comes after it
    for i in range(len(found) - 1, -1, -1):
        score, by = best[i]
        if not score:
            continue
        for part in found[i].parts:
            if isinstance(part, int):
                best[part] = max(best[part], best[i])
            elif part[1] > part[0]:
                out.append((*part, score, found[-by].target))
    return out


def secret_spans(text: str | None) -> list[tuple[int, str, int, float, str]]:
    """``(start, kind, end, score, name)`` by start and then kind."""
    if not text:
        return []
    found = []
    low = text.lower()
    for kind, pattern, group, length in BASE:
        if kind == "assign" and not _HINT.search(low):
            continue
        for m in pattern.finditer(text):
            if len(m.group(group)) >= length:
                name = m.group(1) if group else ""
                found.append((m.start(), kind, m.end(), 1.0, name))
    if ("=" in text or ":" in text) and _HINT.search(low):
        found += [(a, "literal", b, s, name) for a, b, s, name in literal_findings(text)]
    return sorted(found, key=lambda f: (f[0], RANK[f[1]], f[2]))


_SPANS = "array<struct<start:int,kind:string,`end`:int,score:double,name:string>>"
_ARROW = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()),
         ("score", pa.float64()), ("name", pa.string())]
    )
)


def _find(batches: Iterator[pa.RecordBatch], text: str, out: str):
    keys = ("start", "kind", "end", "score", "name")
    for batch in by_batch(batches, 500):
        found = [
            [dict(zip(keys, f, strict=True)) for f in secret_spans(t)]
            for t in column_text(batch, text)
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(found, _ARROW)], [*batch.schema.names, out]
        )


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds ``out``: spans of secrets in ``text`` as ``(start, kind, end, score, name)``.

    Positions are code points from 0, the end is exclusive. ``assign``, ``access`` and
    ``hex`` are patterns; ``literal`` is a value that an assignment, directly or
    through constants, gives to a sensitively named target. A null or empty text has
    none. A column called ``out`` is replaced, all other columns and all rows stay,
    repeated ones too. An empty table gives an empty result.
    """
    docs = text_column(docs.drop(out), text)
    schema = extended(docs, f"{out} {_SPANS}")
    return docs.mapInArrow(partial(_find, text=text, out=out), schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """``find_secrets`` in short: ``doc_id``, numbers by pattern, ``base_sha256`` of
    their ``kind:start:end,...``, ``spans`` (all of them likewise), ``n_literal`` and
    the sensitive ``names`` that literals reach."""
    rows = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","
    )
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    literal = F.filter("secrets", lambda s: s.kind == "literal")
    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(said(F.filter("secrets", lambda s: s.kind != "literal")), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
        F.size(literal).cast("long").alias("n_literal"),
        F.transform(literal, lambda s: s["name"]).alias("names"),
    )

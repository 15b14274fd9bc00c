"""Comparison rules for response headers and their per-domain order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from headerwise.functions.http_dates import parse_http_date

# A check gets the production and the test value, both present, and says "equal".
Check = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Exact:
    def __call__(self, prod: Column, test: Column) -> Column:
        return prod == test


@dataclass(frozen=True)
class WeakETag:
    """Equal, or both marked weak."""

    def __call__(self, prod: Column, test: Column) -> Column:
        return (prod == test) | (prod.startswith("W/") & test.startswith("W/"))


@dataclass(frozen=True)
class Suffix:
    """Equal after the first ``skip`` characters."""

    skip: int = 6

    def __call__(self, prod: Column, test: Column) -> Column:
        def rest(text: Column) -> Column:
            return F.substring(text, self.skip + 1, 2**31 - 1)

        return (prod == test) | (rest(prod) == rest(test))


@dataclass(frozen=True)
class TimeTolerance:
    """Production less than ``seconds`` later than test; test may be later by any
    amount unless ``symmetric``. Dates that cannot be read are never equal."""

    seconds: int = 3600
    symmetric: bool = False

    def __call__(self, prod: Column, test: Column) -> Column:
        late = F.unix_timestamp(parse_http_date(prod)) - F.unix_timestamp(parse_http_date(test))
        return (F.abs(late) if self.symmetric else late) < self.seconds


@dataclass(frozen=True)
class Rule:
    """How one header is compared; ``check=None`` means it is not compared at all."""

    header: str
    check: Check | None = field(default_factory=Exact)


# The order of the default rules decides which label is reported.
def default_rules(cache_status: str = "x-cache") -> tuple[Rule, ...]:
    """Default rules; ``cache_status`` is the header in which the proxy tells HIT or MISS."""
    return (
        Rule("content-type"),
        Rule("content-length"),
        Rule("etag", WeakETag()),
        Rule("last-modified"),
        Rule(cache_status),
    )


@dataclass(frozen=True)
class RuleSet:
    """Default rules and the rules of single domains, which come before them."""

    default: tuple[Rule, ...] = field(default_factory=default_rules)
    by_domain: Mapping[str, Sequence[Rule]] = field(default_factory=dict)

    def effective(self, domain: str | None) -> tuple[Rule, ...]:
        """The domain's own rules in their order, then the defaults for other headers."""
        own = _once(self.by_domain.get(domain, ()))
        named = {rule.header for rule in own}
        merged = own + tuple(r for r in _once(self.default) if r.header not in named)
        return tuple(rule for rule in merged if rule.check is not None)

    def groups(self) -> dict[tuple[Rule, ...], list[str]]:
        """Domains that share the same effective rules, default-only ones left out."""
        shared: dict[tuple[Rule, ...], list[str]] = {}
        for domain in self.by_domain:
            rules = self.effective(domain)
            if rules != self.effective(None):
                shared.setdefault(rules, []).append(domain)
        return shared

    def uses(self) -> dict[Rule, list[str] | None]:
        """Every different rule with the domains that use it, None for the default ones."""
        found: dict[Rule, list[str] | None] = dict.fromkeys(self.effective(None))
        for rules, domains in self.groups().items():
            for rule in rules:
                if rule not in found:
                    found[rule] = []
                if found[rule] is not None:
                    found[rule] += domains
        return found

    def headers(self) -> list[str]:
        """All headers any rule looks at."""
        return list(dict.fromkeys(rule.header for rule in self.uses()))


def _tolerance(param: str | None, symmetric: bool) -> TimeTolerance:
    seconds = TimeTolerance.seconds if param is None else int(param)
    return TimeTolerance(seconds, symmetric)


def _once(rules: Iterable[Rule]) -> tuple[Rule, ...]:
    """One rule per header: the last one named, at the place of the first."""
    return tuple({rule.header: rule for rule in rules}.values())


_KINDS: dict[str, Callable[[str | None], Check | None]] = {
    "exact": lambda _: Exact(),
    "weak_etag": lambda _: WeakETag(),
    "suffix": lambda param: Suffix() if param is None else Suffix(int(param)),
    "time_tolerance": lambda param: _tolerance(param, False),
    "time_tolerance_both": lambda param: _tolerance(param, True),
    "skip": lambda _: None,
}


def rules_from_rows(rows: Iterable[Mapping[str, object]]) -> RuleSet:
    """A rule set from rows ``domain, seq, header, kind, param``.

    Rows of domain ``default`` replace the built-in defaults. A null ``param`` means
    the kind's own default; ``time_tolerance_both`` is the symmetric tolerance.
    """
    by_domain: dict[str, list[Rule]] = {}
    for row in sorted(rows, key=lambda r: r["seq"]):
        if row["kind"] not in _KINDS:
            raise ValueError(f"unknown rule kind: {row['kind']!r}")
        check = _KINDS[row["kind"]](row.get("param"))
        by_domain.setdefault(row["domain"], []).append(Rule(row["header"], check))
    default = tuple(by_domain.pop("default", default_rules()))
    return RuleSet(default, by_domain)

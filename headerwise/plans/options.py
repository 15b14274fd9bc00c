"""Parameters of a collect run: call options over per-domain options over defaults."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise import settings
from headerwise.operators.joins import measured_join
from headerwise.sources.local import small_table
from headerwise.sources.scratch import Stored, stored


@dataclass(frozen=True)
class Options:
    """One layer; None means "not set here"."""

    min_count: int | None = None
    top_urls: int | None = None
    top_agents: int | None = None
    top_referers: int | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and value < 1:
                raise ValueError(f"{f.name} must be at least 1")
            if value is not None and f.name != "min_count" and value > settings.LARGEST_TOP:
                raise ValueError(f"{f.name} must be at most {settings.LARGEST_TOP}")


DEFAULTS = Options(
    min_count=settings.MIN_COUNT,
    top_urls=settings.TOP_URLS,
    top_agents=settings.TOP_AGENTS,
    top_referers=settings.TOP_REFERERS,
)
_NAMES = [f.name for f in fields(Options)]
_SCHEMA = T.StructType(
    [T.StructField("domain", T.StringType())] + [T.StructField(n, T.LongType()) for n in _NAMES]
)


def resolve_options(
    domains: DataFrame,
    call: Options = Options(),
    per_domain: Sequence[tuple[str, Options]] | DataFrame = (),
    defaults: Options = DEFAULTS,
) -> DataFrame:
    """One row of resolved parameters per distinct domain name.

    The first ``per_domain`` entry of a name counts, later ones are ignored. It can
    also be a table of any size, from a file or elsewhere (``options_table``). The
    second level's minimum ``min_count_2`` is a quarter of the first, rounded up.
    """
    if isinstance(per_domain, DataFrame):
        own = stored(options_table(per_domain), "domain-options")
        return _resolved(domains, call, own.table, defaults, own.fits_broadcast())
    first: dict[str, Options] = {}
    for name, options in per_domain:
        first.setdefault(name, options)
    own = small_table(
        domains.sparkSession,
        _SCHEMA,
        [[name, *(getattr(o, n) for n in _NAMES)] for name, o in first.items()],
    )
    return _resolved(domains, call, own, defaults, True)


def options_table(rows: DataFrame) -> DataFrame:
    """Options per domain from a table ``domain, seq`` and any of the option columns.

    Of several rows for a domain that with the least ``seq`` counts. Columns that are
    lacking and null values mean "not set here". A value below 1, or a size above the
    largest there is, is an error once the rows are read.
    """
    given = [n for n in _NAMES if n in rows.columns]
    bound = {n: F.lit(None).cast("long") for n in _NAMES}
    for name in given:
        value = F.col(name).cast("long")
        most = 2**63 - 1 if name == "min_count" else settings.LARGEST_TOP
        said = F.concat(F.lit(f"{name} out of range for domain "), F.col("domain"))
        bound[name] = F.when(
            value.isNull() | value.between(1, most), value
        ).otherwise(F.raise_error(said).cast("long"))
    first = F.min(F.struct("seq", *given)).alias("first")
    picked = rows.where(F.col("domain").isNotNull()).groupBy("domain").agg(first)
    return picked.select("domain", "first.*").select(
        "domain", *[bound[n].alias(n) for n in _NAMES]
    )


def _resolved(
    domains: DataFrame, call: Options, own: DataFrame, defaults: Options, fits: bool
) -> DataFrame:
    joined = measured_join(domains.select("domain").distinct(), own, "domain", "left", fits)
    resolved = joined.select(
        "domain",
        *[
            F.coalesce(
                F.lit(getattr(call, n)).cast("long"),
                F.col(n),
                F.lit(getattr(defaults, n) or getattr(DEFAULTS, n)),
            ).alias(n)
            for n in _NAMES
        ],
    )
    return resolved.withColumn("min_count_2", F.ceil(F.col("min_count") / 4))


@dataclass(frozen=True)
class Scope:
    """The resolved parameters of a run, measured once.

    ``names`` is set for lists short enough to become a literal scan filter.
    """

    options: DataFrame
    size: Stored | None
    names: list[str] | None
    largest: dict[str, int]

    @classmethod
    def of(cls, options: DataFrame) -> Scope:
        options = options.where(F.col("domain").isNotNull())
        some = options.limit(settings.INLINE_DOMAINS + 1).collect()
        sizes = ["top_urls", "top_agents", "top_referers"]
        if len(some) <= settings.INLINE_DOMAINS:
            table = small_table(options.sparkSession, options.schema, some)
            largest = {n: max((row[n] for row in some), default=0) for n in sizes}
            return cls(table, None, [row["domain"] for row in some], largest)
        kept = stored(options, "options")
        top = kept.table.agg(*[F.max(n).alias(n) for n in sizes]).first()
        return cls(kept.table, kept, None, top.asDict())

    def attach(self, rows: DataFrame, names: Sequence[str]) -> DataFrame:
        """Add parameters to rows that are already aggregated, dropping other domains.

        Options of known size are broadcast; a longer table that does not fit is joined
        by domain, with Spark's splitting of skewed partitions.
        """
        fits = self.size is None or self.size.fits_broadcast()
        return measured_join(rows, self.options.select("domain", *names), "domain", "inner", fits)

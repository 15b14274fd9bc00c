"""Source divergence audit: how the words of a language's sources differ.

The terms that enough documents of a language hold are found by iceberg prefix
refinement. Each level counts the documents that hold a term with a given first few
bytes; prefixes of too few documents go, with all terms behind them, and the others are
extended at the next level, until only complete terms are left. What survives a level
reaches the next as a bit array of bounded size: a prefix that slips through is counted
and goes then, so the result is exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerwise.llm.common import by_batch, column_bytes, lasting, opened, shipped, text_column
from headerwise.sources.scratch import measured, written

#: Bytes of the prefixes at the first level, and how much longer they are at each next one.
FIRST_BYTES, LONGER = 6, 4
#: Largest bit array of surviving prefixes, in bytes, and the bits for each of them.
FILTER_BYTES, FILTER_BITS = 64 << 20, 16
#: Different keys a task counts before it hands them on.
HELD_KEYS = 300_000
#: The whole of the probabilities, in integers.
WHOLE = 1_000_000_000

_BLOCK = 8192  # bits of the array in one row while it is put together
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of letters and of anything beyond ASCII, with A-Z lowered."""
    return text.translate(_LETTERS).split() if text else []


def prefix_hash(lang: bytes, prefix: bytes) -> int:
    """What ``xxhash64(lang, prefix)`` of Spark gives, without sign."""
    return xxhash.xxh64_intdigest(prefix, xxhash.xxh64_intdigest(lang, 42))


class _Passing(dict):
    """Whether prefixes of one language survived, as far as they were asked for."""

    def __init__(self, lang: bytes, bits: bytes):
        self.lang, self.bits = lang, bits

    def __missing__(self, prefix: bytes) -> bool:
        if len(self) > HELD_KEYS:
            self.clear()
        at = prefix_hash(self.lang, prefix) & (8 * len(self.bits) - 1)
        found = self[prefix] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return found


class _Held:
    """What a task has counted: documents and occurrences of terms, documents of prefixes."""

    def __init__(self):
        self.docs, self.times, self.prefixes = (defaultdict(Counter) for _ in range(3))

    def __len__(self) -> int:
        return sum(len(c) for held in (self.docs, self.prefixes) for c in held.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), docs in self.docs.items():
            times = self.times[lang, source]
            yield _batch(lang, source, docs, list(map(times.__getitem__, docs)), True)
        for lang, docs in self.prefixes.items():
            yield _batch(lang, b"", docs, [0] * len(docs), False)


def _batch(lang: bytes, source: bytes, docs: Counter, times: list[int], done: bool) -> pa.RecordBatch:
    n = len(docs)
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(lang.decode(), pa.string()), n),
            pa.repeat(pa.scalar(source.decode(), pa.string()), n),
            pa.array(list(docs), pa.binary()),
            pa.repeat(done, n),
            pa.array(list(docs.values()), pa.int64()),
            pa.array(times, pa.int64()),
        ],
        names=["lang", "source", "key", "done", "docs", "times"],
    )


def _level(batches: Iterator[pa.RecordBatch], before: int, width: int, shared: Broadcast | None):
    """Documents that hold each prefix of ``width`` bytes, and each term that ends within
    them but not within the ``before`` bytes of the last level, combined in the task."""
    bits = opened(shared).tobytes() if shared else None
    passing: dict[bytes, _Passing] = {}
    held = _Held()
    for batch in by_batch(batches, 200):
        columns = (column_bytes(batch, c) for c in ("lang", "source", "text"))
        for lang, source, text in zip(*columns, strict=True):
            terms = terms_of(text)
            if bits is not None:
                known = passing.get(lang)
                if known is None:
                    known = passing[lang] = _Passing(lang, bits)
                terms = [t for t in terms if len(t) > before and known[t[:before]]]
            done = [t for t in terms if len(t) <= width]
            held.docs[lang, source].update(set(done))
            held.times[lang, source].update(done)
            if len(done) < len(terms):
                held.prefixes[lang].update({t[:width] for t in terms if len(t) > width})
        if len(held) > HELD_KEYS:
            yield from held.batches()
            held = _Held()
    yield from held.batches()


#: ``done`` for a complete term, not for a prefix.
_LEVEL = "lang string, source string, key binary, done boolean, docs long, times long"


def _bits(prefixes: DataFrame, rows: int) -> np.ndarray:
    """The bit array of the prefixes' hashes: at most FILTER_BYTES reach the driver."""
    size = 64
    while size < FILTER_BYTES and 8 * size < FILTER_BITS * rows:
        size *= 2
    at = F.xxhash64("lang", "key").bitwiseAND(F.lit(8 * size - 1))
    found = prefixes.select(
        F.shiftright(at, 13).alias("block"), at.bitwiseAND(F.lit(_BLOCK - 1)).cast("short").alias("at")
    )
    bits = np.zeros(8 * max(size, _BLOCK // 8), bool)
    for row in found.groupBy("block").agg(F.collect_set("at").alias("at")).toLocalIterator():
        bits[np.array(row.at, np.int64) + row.block * _BLOCK] = True
    return np.packbits(bits, bitorder="little")[:size]


def _plain(docs: DataFrame) -> DataFrame:
    for c in ("lang", "source", "text"):
        docs = text_column(docs, c)
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """Rows ``lang, source, term, times``: the terms that at least ``least`` documents of
    their language hold, with their occurrences in each source that has any.

    ``docs`` has ``lang``, ``source`` and ``text``; nulls count as empty texts, repeated
    rows as documents of their own. Terms have no length limit: longer ones take a few
    levels more. An empty table gives an empty result.
    """
    rows, spark = _plain(docs), docs.sparkSession
    before, width, shared, found = 0, FIRST_BYTES, None, []
    while True:
        step = partial(_level, before=before, width=width, shared=shared)
        counts = rows.mapInArrow(step, _LEVEL).groupBy("lang", "source", "key", "done")
        counts = written(
            counts.agg(F.sum("docs").alias("docs"), F.sum("times").alias("times")),
            "prefixes",
        )
        n = F.count(F.lit(1)).alias("rows")
        enough = counts.where("done").groupBy("lang", "key").agg(F.sum("docs").alias("docs"))
        enough = enough.where(F.col("docs") >= least).select("lang", "key")
        terms = counts.where("done").join(enough.hint("merge"), ["lang", "key"])
        found.append(terms.select("lang", "source", F.col("key").cast("string").alias("term"), "times"))
        longer = counts.where(F.col("docs") >= least).where("NOT done").select("lang", "key")
        longer, got = measured(longer, "longer", n)
        if not got["rows"]:
            break
        shared = shipped(spark, _bits(longer, got["rows"]))
        before, width = width, LONGER * width
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _p(times: str, n: str, v: str) -> Column:
    """The smoothed share of a term; decimals, as counts times WHOLE may pass 64 bits."""
    return F.expr(f"1 + (CAST({WHOLE} AS DECIMAL(10, 0)) * ({times} + 1)) DIV ({n} + {v})")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV {q}")


def _sums(value: Column, name: str) -> list[Column]:
    """The sum in two halves of 32 bits, as decimals are slow and 64 bits too few; sums
    of 2^31 rows and more end in an error where they do not fit."""
    low = F.sum(value.bitwiseAND(F.lit((1 << 32) - 1)))
    return [F.sum(F.shiftright(value, 32)).alias(f"{name}_high"), low.alias(f"{name}_low")]


def _whole(name: str) -> Column:
    high = F.col(f"{name}_high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")
    return (high + F.col(f"{name}_low")).cast("decimal(38,0)")


def _groups(docs: DataFrame, kept: DataFrame, langs: DataFrame) -> DataFrame:
    """Every (lang, source) with ``v`` kept terms of its language and the share ``base``
    of those that it lacks."""
    sizes = kept.groupBy("lang", "source").agg(F.sum("times").alias("n"))
    rows = _plain(docs).select("lang", "source").distinct()
    rows = rows.join(sizes, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    rows = rows.fillna(0, ["n", "v"])
    return written(rows.withColumn("base", F.when(F.col("v") > 0, _p("0", "n", "v"))), "groups")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, part, item, value`` of each two sources of a language.

    The sum over all kept terms is that of terms lacking in both, put right for those
    that one of them has (by how often it has them) and those that both have.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("b"))
    both = groups.join(other, "lang").where("source <> item")
    none = both.select(
        "lang", "source", "item", (F.col("v") * F.coalesce(_f("base", "b"), F.lit(0))).cast("decimal(30,0)").alias("x")
    )
    levels = shares.groupBy("lang", "source", "p", "base").agg(F.count(F.lit(1)).alias("k"))
    one = levels.join(other, "lang").where("source <> item")

    def change(value: Column, less: Column) -> Column:
        return F.sum(F.col("k").cast("decimal(10,0)") * (value - less).cast("decimal(20,0)")).alias("x")

    own = one.groupBy("lang", "source", "item").agg(change(_f("p", "b"), _f("base", "b")))
    its = one.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(
        change(_f("b", "p"), _f("b", "base"))
    )
    # terms that both have: every two sources once, with both directions
    right = shares.select("lang", "term", *[F.col(c).alias(f"{c}_o") for c in ("source", "p", "base")])
    met = shares.join(right.hint("merge"), ["lang", "term"]).where("source < source_o")

    def more(p: str, q: str, b: str, c: str) -> Column:
        # each is at most 10^18; only the sums may pass 64 bits
        return _f(p, q) - _f(p, c) - _f(b, q) + _f(b, c)

    met = met.groupBy("lang", "source", "source_o").agg(
        *_sums(more("p", "p_o", "base", "base_o"), "x"),
        *_sums(more("p_o", "p", "base_o", "base"), "y"),
    )
    met = met.select(
        "lang",
        F.inline(
            F.array(
                F.struct(F.col("source"), F.col("source_o").alias("item"), _whole("x").alias("x")),
                F.struct(F.col("source_o").alias("source"), F.col("source").alias("item"), _whole("y").alias("x")),
            )
        ).alias("source", "item", "x"),
    )
    parts = none
    for rows in (own, its, met):
        parts = parts.union(rows.select("lang", "source", "item", F.col("x").cast("decimal(30,0)")))
    value = F.sum("x").cast("long").alias("value")
    return parts.groupBy("lang", "source", "item").agg(value)


def divergences(docs: DataFrame, least: int = 3, terms: int = 200) -> DataFrame:
    """How far each source's words are from other sources' and from its language's.

    ``docs`` has ``lang``, ``source`` and ``text``, where null counts as ``''``; further
    columns are ignored, whatever they are called. Rows ``lang, source, part, item,
    value, rank`` for every (lang, source) that occurs: part ``pair`` has an item for
    each other source of the language, part ``term`` the ``terms`` kept terms (see
    ``kept_terms``) that exceed their share in the language by the highest value. Higher
    values come first, equal ones by the item's bytes. Repeated rows are documents of
    their own; a language without kept terms has pairs of value 0 and no terms. An empty
    table gives an empty result.
    """
    kept = lasting(docs.sparkSession, "kept", lambda: kept_terms(docs, least))
    totals = written(kept.groupBy("lang", "term").agg(F.sum("times").alias("total")), "totals")
    langs = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    langs = written(langs, "langs")
    groups = _groups(docs, kept, langs)
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _p("times", "n", "v"))
    shares = written(shares.select("lang", "source", "term", "p", "base"), "shares")
    usual = totals.join(langs, "lang").withColumn("q", _p("total", "n_lang", "v"))
    above = shares.join(usual.select("lang", "term", "q").hint("merge"), ["lang", "term"]).where("p > q")
    above = above.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    above = above.withColumn("rank", rank).where(F.col("rank") <= terms)
    pairs = _pairs(shares, groups).withColumn("part", F.lit("pair")).withColumn("rank", rank)
    return above.unionByName(pairs).select("lang", "source", "part", "item", "value", "rank")

"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerwise.llm.common import joined
from headerwise.sources.scratch import measured


def _hooked(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``(u, v)`` with the smallest of u's neighbours and u as ``m``.

    The minimum is combined before the shuffle. The join back broadcasts the minima
    while the counted rows bound their size; beyond, it is an equi-join whose hot keys
    adaptive execution splits.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    return joined(rows, least, F.col("u") == F.col("k"), "inner", size, 64)


def _large_star(links: DataFrame, size: int) -> DataFrame:
    """Every neighbour above u hooks to the smallest of u and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hooked = _hooked(both, 2 * size).where("v > u")
    return hooked.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(links: DataFrame, size: int) -> DataFrame:
    """u and its neighbours below u hook to the smallest of them."""
    hooked = _hooked(links, size)
    below = hooked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(hooked.select("u", F.col("m").alias("v")))


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and a mark by which two rounds' tables can be told apart."""
    size = F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("u", "v")).alias("mix")
    table, mark = measured(links.distinct(), "links", *size)
    return table, (mark["size"], mark["mix"])


def components(links: DataFrame) -> DataFrame:
    """``links`` of two columns to rows ``(id, component)`` of every id that has a link.

    ``component`` is the smallest id that can be reached. Links of an id to itself
    and links with a null are ignored; an empty table gives an empty one. Each
    round's links are a table in the shared folder, so no round is ever repeated
    when an executor is lost. The number of rounds grows with the logarithm of the
    longest path; hubs cost nothing extra.
    """
    a, b = links.columns
    links = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    links, now = _kept(links)
    before = None
    while now != before and now[0]:
        before = now
        # a large star makes no more links than there are
        links, now = _kept(_small_star(_large_star(links, now[0]), now[0]))
    # every link now leads from an id to the smallest of its component
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)

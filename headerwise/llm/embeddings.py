"""Embedding near-duplicates by a forest of random-projection trees with spill.

Each tree splits its node's vectors at the median of a random projection, again and
again; vectors near a split go to both sides. The trees are fitted on a bounded sample,
every vector is routed through all of them. Vectors are compared in double precision
within leaves, leaves of any size block by block, and a pair that meets in several
leaves counts at its first meeting only, so links are counted without listing pairs:
each block adds up its vectors' links and gives one link per vector and component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerwise.llm.common import by_batch, opened, shipped
from headerwise.llm.components import components
from headerwise.sources.scratch import measured, written

#: Vectors the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
TREES = 8
#: Vectors in a leaf, about; the rows of a block that are compared at once.
LEAF_ROWS, BLOCK_ROWS = 500, 1000
#: Vectors go to both sides of a split when they are nearer to it than this share of the
#: distance that two linked vectors have, at most, along a random direction. A split
#: that would send more than MOST of a node's sample to both sides is not made: a dense
#: cluster stays in one leaf, whatever its size.
SPILL, MOST = 0.5, 0.4
SEED = 7
#: A leaf's key: the number of the forest, of the tree, of the node; or a mark and the
#: length of vectors that have no forest.
_PLACE, _TREE, _LONE = 48, 40, 1 << 62


@dataclass(frozen=True)
class Tree:
    """Directions by depth; by node number (children of n: 2n, 2n + 1) the range of
    projections that goes to both sides."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` of every leaf that each row of ``x`` reaches."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        projected = x @ self.directions.T
        for depth in range(len(self.directions)):
            at = projected[row, depth]
            left, right = at <= self.high[node], at > self.low[node]
            row = np.concatenate((row[left], row[right]))
            node = np.concatenate((2 * node[left], 2 * node[right] + 1))
        return row, node


def fit_tree(sample: np.ndarray, depth: int, seed: int, threshold: float) -> Tree:
    """Splits at medians, where they part a node's sample; elsewhere all go left."""
    random = np.random.default_rng(seed)
    width = sample.shape[1]
    directions = random.standard_normal((depth, width))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    margin = SPILL * np.sqrt((2 - 2 * threshold) / width)
    low, high = np.full(1 << depth, np.inf), np.full(1 << depth, np.inf)
    inside: dict[int, np.ndarray] = {1: np.arange(len(sample))}
    for level in range(depth):
        at = sample @ directions[level]
        for node in range(1 << level, 2 << level):
            rows = inside.pop(node, np.empty(0, np.int64))
            if not len(rows):
                continue
            own = at[rows]
            middle = np.median(own)
            if np.mean(np.abs(own - middle) <= margin) > MOST:
                inside[2 * node] = rows
                continue
            low[node], high[node] = middle - margin, middle + margin
            inside[2 * node], inside[2 * node + 1] = rows[own <= middle], rows[own > middle]
    return Tree(directions, low, high)


def unit_rows(batch: pa.RecordBatch, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which rows have a direction at all."""
    values = batch.column(batch.schema.get_field_index(name))
    out, good = np.zeros((len(values), width)), np.zeros(len(values), bool)
    for i, v in enumerate(values.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            row = np.array(v, np.float64)
            top = np.abs(row).max(initial=0.0)
            if np.isfinite(top) and top > 0:
                row = row / top
                out[i], good[i] = row / np.sqrt(row @ row), True
    return out, good


def _route(batches: Iterator[pa.RecordBatch], forests):
    """A row for each leaf: ``id, n, x, leaf, seen`` (its leaves of earlier trees).

    Vectors go through the forest of their length. Lengths without one have a leaf each.
    """
    forests = opened(forests)
    for batch in by_batch(batches, 2000):
        lengths = pc.list_value_length(batch.column(batch.schema.get_field_index("v"))).to_numpy()
        for width in np.unique(lengths).tolist():
            rows = batch.take(pa.array(np.nonzero(lengths == width)[0]))
            place, trees = forests.get(width, (None, []))
            yield from _leaf_rows(rows, width, trees, place)


def _leaf_rows(batch: pa.RecordBatch, width: int, trees: list[Tree], place: int | None):
    ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
    copies = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
    x, _ = unit_rows(batch, "v", width)
    if not trees:
        only = np.full(len(ids), _LONE | width)
        yield _routed(ids, copies, x, only, [[]] * len(ids))
    seen: list[list[int]] = [[] for _ in ids]
    for number, tree in enumerate(trees):
        row, leaf = tree.leaves(x)
        leaf = (place << _PLACE) | (number << _TREE) | leaf
        order = np.argsort(row, kind="stable")
        row, leaf = row[order], leaf[order]
        # the leaves of this tree below each row's, then those of earlier trees
        rank: dict[int, list[int]] = {}
        past = []
        for r, l in zip(row.tolist(), leaf.tolist(), strict=True):
            own = rank.setdefault(r, [])
            past.append(seen[r] + own)
            own.append(l)
        for r, own in rank.items():
            seen[r] = seen[r] + own
        yield _routed(ids[row], copies[row], x[row], leaf, past)


def _routed(ids, copies, x, leaf, seen) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids),
            pa.array(copies),
            pa.array(list(x), pa.list_(pa.float64())),
            pa.array(leaf),
            pa.array(seen, pa.list_(pa.int64())),
        ],
        names=["id", "n", "x", "leaf", "seen"],
    )


def _fit_forests(
    classes: DataFrame, threshold: float, trees: int, sample_rows: int, leaf_rows: int
) -> dict[int, tuple[int, list[Tree]]]:
    """By length of the vectors the number of their forest and its trees, from one sample
    of all lengths. A length that is rare in the sample, or fills one leaf, has none."""
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v")
    batch = pa.RecordBatch.from_pandas(sample.toPandas())
    if not batch.num_rows:
        return {}
    lengths = pc.list_value_length(batch.column(0)).to_numpy()
    widths, taken = np.unique(lengths, return_counts=True)
    # at least two leaves of eight vectors of the sample
    widths = widths[taken >= 16].tolist()
    of_width = classes.where(F.size("v").isin(widths)).groupBy(F.size("v").alias("width"))
    forests = {}
    for row in of_width.agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect():
        rows = batch.take(pa.array(np.nonzero(lengths == row.width)[0]))
        wanted = max(0, int(np.ceil(np.log2(row.n / leaf_rows))))
        depth = min(wanted, int(np.log2(rows.num_rows / 8)))
        if depth:
            units, _ = unit_rows(rows, "v", row.width)
            fitted = [fit_tree(units, depth, SEED * 1000 + t, threshold) for t in range(trees)]
            forests[row.width] = (len(forests), fitted)
    return forests


def _met_before(seen: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j of the padded table share a leaf."""
    out = np.zeros(len(i), bool)
    for start in range(0, len(i), 100_000):
        a, b = seen[0][i[start : start + 100_000]], seen[1][j[start : start + 100_000]]
        for column in range(a.shape[1]):
            leaf = a[:, column : column + 1]
            out[start : start + len(a)] |= ((leaf == b) & (leaf >= 0)).any(axis=1)
    return out


def _padded(lists) -> np.ndarray:
    width = max((len(x) for x in lists), default=0)
    out = np.full((len(lists), max(1, width)), -1, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def compare_blocks(pair: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links within or between the two blocks of one leaf: ``(id, other, n_links)``.

    ``n_links`` are links of ``id`` first met here; ``other`` is the smallest id that
    the links found here reach from it, which may be itself.
    """
    sides = [pair[pair.side == s] for s in (0, 1)]
    same = len(pair) > 0 and pair.a.iloc[0] == pair.b.iloc[0]
    one, two = sides[0], sides[0] if same else sides[1]
    x, y = np.array(one.x.tolist(), ndmin=2), np.array(two.x.tolist(), ndmin=2)
    none = pd.DataFrame({"id": [], "other": [], "n_links": []}).astype("int64")
    if not len(one) or not len(two):
        return none
    i, j = np.nonzero(x @ y.T >= threshold)
    ids, others = one.id.to_numpy(), two.id.to_numpy()
    keep = ids[i] < others[j] if same else ids[i] != others[j]
    i, j = i[keep], j[keep]
    if not len(i):
        return none
    fresh = ~_met_before((_padded(one.seen.tolist()), _padded(two.seen.tolist())), i, j)
    n, m = one.n.to_numpy(), two.n.to_numpy()
    nodes, at = np.unique(np.concatenate((ids[i], others[j])), return_inverse=True)
    p, q = at[: len(i)], at[len(i) :]
    count = np.zeros(len(nodes), np.int64)
    np.add.at(count, p, np.where(fresh, m[j], 0))
    np.add.at(count, q, np.where(fresh, n[i], 0))
    return pd.DataFrame({"id": nodes, "other": nodes[_lowest(len(nodes), p, q)], "n_links": count})


def _lowest(size: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the lowest that the links ``p, q`` reach."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        # the labels' own nodes follow, so chains shrink to a fraction in each turn
        for node in (p, q, label[p], label[q]):
            np.minimum.at(new, node, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(routed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every row with each pair of blocks of its leaf that it takes part in."""
    rows = routed.join(blocks.hint("merge"), "leaf")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "leaf"), F.col("blocks")).cast("int"))
    partner = F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))
    rows = rows.withColumn("partner", F.explode(partner))
    return rows.select(
        "leaf",
        F.least("block", "partner").alias("a"),
        F.greatest("block", "partner").alias("b"),
        (F.col("block") > F.col("partner")).cast("int").alias("side"),
        "id",
        "n",
        "x",
        "seen",
    )


def similar_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Links of cosine ``threshold`` or more among ``vectors (vec_id, embedding)``.

    Returns a row for every row: ``vec_id``, ``n_links`` (other vectors linked with
    it), ``component_id`` (the smallest vec_id that links reach, itself included) and
    ``kept`` (whether that is its own). Every link given is right; nearly all are
    found (see the measured recall in README).

    Equal vectors are one node that carries their number, so copies cost nothing.
    Vectors of different lengths are never linked; those of each length are compared
    with each other. A null, empty or zero vector, or one with a null or non-finite
    component, links with nothing, and so does a null vec_id, whose component is null. Rows that repeat a vec_id with another vector are one node: the
    links of any of them count for all. Other columns are not read. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    good = (
        F.col("vec_id").isNotNull()
        & (F.size(F.coalesce("v", F.array().cast("array<double>"))) > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = written(rows.withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    usable = rows.where("good")
    # equal vectors are one class, named by the smallest vec_id
    classes, size = measured(
        usable.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")),
        "vector-classes",
        F.count(F.lit(1)).alias("rows"),
    )
    found = {"links": None}
    if size["rows"]:
        forests = _fit_forests(classes, threshold, trees, sample_rows, leaf_rows)
        routed = written(
            classes.mapInArrow(
                partial(_route, forests=shipped(spark, forests)),
                "id long, n long, x array<double>, leaf long, seen array<long>",
            ),
            "routed",
        )
        blocks = routed.groupBy("leaf").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks")
        )
        schema = "id long, other long, n_links long"

        def compare(pair: pd.DataFrame) -> pd.DataFrame:
            return compare_blocks(pair, threshold)

        found["links"] = written(
            _blocks(routed, blocks)
            .groupBy("leaf", "a", "b")
            .applyInPandas(compare, schema),
            "vector-links",
        )
    else:
        found["links"] = spark.createDataFrame([], "id long, other long, n_links long")
    links = found["links"]
    counts = links.groupBy("id").agg(F.sum("n_links").alias("far"))
    named = usable.select("vec_id", "v").join(
        classes.select("v", "id", "n").hint("merge"), "v"
    )
    copies = named.where("vec_id != id").select("id", F.col("vec_id").alias("other"))
    labels = components(links.select("id", "other").union(copies))
    own = named.select("vec_id", "id", "n").join(counts.hint("merge"), "id", "left")
    own = own.select("vec_id", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    rest = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    labels = labels.withColumnRenamed("id", "vec_id")
    return (
        own.union(rest)
        .join(labels.hint("merge"), "vec_id", "left")
        .select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.expr("component_id <=> vec_id"))
    )

"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items' word sequences is built once and sent to the tasks, which
stream each text's words through it and so know, at every word, the longest stretch
ending there that occurs in an item. A stretch of ``window`` words, or a whole shorter
item, is a hit. Before streaming, stretches that cannot reach that length are skipped:
those with words, or neighbouring words, that no item has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerwise.llm.common import (
    by_batch,
    column_bytes,
    extended,
    free_name,
    opened,
    releasing,
    shipped,
    text_column,
)
from headerwise.sources.scratch import written

#: Item text per automaton. More text makes several, applied one after the other.
BLOCK_BYTES = 1 << 20
_PAIRS = 1 << 22

# digits, letters and everything beyond ASCII make words; A-Z are lowered first
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        sequences = [(key, w) for key, text in items if (w := words_of(text))]
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = []
        for key, words in sequences:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((key, codes))
            state = 0
            for code in codes:
                state = self._extend(state, code)
        self.need = min([window, *(len(c) for _, c in coded)]) if coded else window
        self._label(coded)
        self.pairs = np.zeros(_PAIRS, bool)
        for _, codes in coded:
            at = np.array(codes, np.int64)
            self.pairs[self._pair(at[:-1], at[1:])] = True

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * 0x9E3779B1 + right) & (_PAIRS - 1)

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, state: int, code: int) -> int:
        """The state for exactly ``state`` and ``code``, parted from longer strings."""
        target = self.step[state][code]
        if self.size[target] == self.size[state] + 1:
            return target
        part = self._new(self.size[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = part
        while state >= 0 and self.step[state].get(code) == target:
            self.step[state][code] = part
            state = self.link[state]
        return part

    def _extend(self, state: int, code: int) -> int:
        if code in self.step[state]:
            return self._split(state, code)
        fresh = self._new(self.size[state] + 1, {}, 0)
        while state >= 0 and code not in self.step[state]:
            self.step[state][code] = fresh
            state = self.link[state]
        if state >= 0:
            self.link[fresh] = self._split(state, code)
        return fresh

    def _label(self, coded: list[tuple[str, list[int]]]) -> None:
        """For each state, where its last ``window`` words are a state of their own and
        which items have them; and the shorter items that end there."""
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.cut = [-1] * len(self.size)
        for s in order:
            if self.size[s] >= self.window:
                short = self.size[self.link[s]] < self.window
                self.cut[s] = s if short else self.cut[self.link[s]]
        self.items: dict[int, set[str]] = {}
        ends: dict[int, list[tuple[int, str]]] = {}
        for key, codes in coded:
            state = 0
            for n, code in enumerate(codes, 1):
                state = self.step[state][code]
                if n >= self.window:
                    self.items.setdefault(self.cut[state], set()).add(key)
            if len(codes) < self.window:
                ends.setdefault(state, []).append((len(codes), key))
        self.ends: dict[int, list[tuple[int, str]]] = {}
        if ends:
            for s in order:
                if found := ends.get(s, []) + self.ends.get(self.link[s], []):
                    self.ends[s] = found

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Where at least ``need`` words in a row are known, each with its neighbour."""
        known = codes >= 0
        if self.need > 1:
            known = known[:-1] & known[1:] & self.pairs[self._pair(codes[:-1], codes[1:])]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        more = 1 if self.need > 1 else 0
        start, end = edges[::2], edges[1::2] + more
        keep = end - start >= self.need
        return list(zip(start[keep].tolist(), end[keep].tolist(), strict=True))

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, int, set[str]]]:
        """``(first, end, longest match, items)`` at every word that ends a hit."""
        step, link, size = self.step, self.link, self.size
        state = length = 0
        for i, code in enumerate(codes):
            while state and code not in step[state]:
                state = link[state]
                length = size[state]
            if code in step[state]:
                state, length = step[state][code], length + 1
            else:
                state = length = 0
            hit, found = 0, set()
            if length >= self.window:
                hit, found = self.window, self.items[self._at(state, length)]
            if state in self.ends:
                fits = [(n, key) for n, key in self.ends[state] if n <= length]
                if fits:
                    hit = max(hit, *(n for n, _ in fits))
                    found = found | {key for _, key in fits}
            if hit:
                yield i + 1 - hit, i + 1, length, found

    def _at(self, state: int, length: int) -> int:
        # the last ``window`` words of a match of at least that length
        return self.cut[state]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _hits(texts: list[bytes | None], automaton: ItemAutomaton):
    """For each text: number of words, hit word spans, longest match, items."""
    words = [words_of(t) for t in texts]
    counts = [len(w) for w in words]
    out: list = [[n, [], 0, set()] for n in counts]
    # one array for the batch; an unknown word after each text keeps them apart
    starts = np.cumsum([0, *(n + 1 for n in counts)])
    codes = np.full(starts[-1], -1, np.int64)
    for w, at in zip(words, starts, strict=False):
        codes[at : at + len(w)] = automaton.codes(w)
    for first, end in automaton.stretches(codes):
        doc = int(np.searchsorted(starts, first, "right")) - 1
        found = out[doc]
        for a, b, longest, items in automaton.stream(codes[first:end].tolist()):
            span = (a + first - int(starts[doc]), b + first - int(starts[doc]))
            if found[1] and span[0] <= found[1][-1][1]:
                last = found[1][-1]
                found[1][-1] = (min(last[0], span[0]), span[1])
            else:
                found[1].append(span)
            found[2] = max(found[2], longest)
            found[3] |= items
    for found in out:
        found[1] = merged(found[1])
    return out


_ADDED = (
    ("n_words", pa.int64(), "long"),
    ("spans", pa.list_(pa.int32()), "array<int>"),
    ("longest", pa.int64(), "long"),
    ("items", pa.list_(pa.string()), "array<string>"),
)


@releasing
def _marks(batches: Iterator[pa.RecordBatch], automaton, text: str, names: list[str]):
    """Adds the hit columns to each row, or merges into those of earlier items."""
    automaton = opened(automaton)
    for batch in by_batch(batches, 500):
        found = _hits(column_bytes(batch, text), automaton)
        have = set(batch.schema.names)
        if names[0] in have:
            for row, spans, longest, items in zip(
                found, *(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names[1:]),
                strict=True,
            ):
                row[1] = merged(row[1] + list(zip(spans[::2], spans[1::2], strict=True)))
                row[2], row[3] = max(row[2], longest), row[3] | set(items)
            batch = batch.select([n for n in batch.schema.names if n not in names])
        columns = [
            pa.array([r[0] for r in found], _ADDED[0][1]),
            pa.array([[x for s in r[1] for x in s] for r in found], _ADDED[1][1]),
            pa.array([r[2] for r in found], _ADDED[2][1]),
            pa.array([sorted(r[3]) for r in found], _ADDED[3][1]),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])


def _marked(
    docs: DataFrame, items: DataFrame, window: int, coverage: float | None = None
) -> tuple[DataFrame, list[str]]:
    """``docs`` with the hit columns, and their names; with ``coverage`` the last block
    also cuts the hits out and drops those columns, in the same workers."""
    spark = docs.sparkSession
    docs = text_column(docs, "text")
    plain = docs.schema
    items = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        F.col("text").cast("string").alias("text"),
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    names = [free_name(docs.columns, n) for n, _, _ in _ADDED]
    added = ", ".join(f"{n} {kind}" for n, (_, _, kind) in zip(names, _ADDED, strict=True))
    schema = extended(docs, added)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r.item_id, r.text.encode() if r.text else None) for r in part.collect()]
        step = partial(
            _marks, automaton=shipped(spark, ItemAutomaton(rows, window)), text="text", names=names
        )
        if coverage is not None and block == blocks - 1:
            step, schema = partial(_marks_and_cut, marks=step, coverage=coverage), plain
        docs = docs.mapInArrow(step, schema)
        if blocks > 1:
            docs = written(docs, "decontaminate")
    return docs, names


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """How much of each text in ``docs (doc_id, text)`` occurs in ``items (item_id, text)``.

    Returns a row for every row: ``doc_id``, ``n_words``, ``n_hit`` (words inside an
    occurrence of ``window`` consecutive words of an item, or of a whole shorter
    item), ``longest`` (words of the longest match that holds a hit, else 0),
    ``hit_spans`` (first and end word of each hit stretch) and ``hit_items`` (ids of
    items with such an occurrence, sorted as text).

    Texts and items that are null or have no words hit nothing. Repeated rows are
    reported as often as they occur; repeated items count once by id, and a null
    item_id goes by the name ``null``. Other columns are not read. Without items
    nothing is hit; an empty table gives an empty result.
    """
    docs, (n_words, spans, longest, found) = _marked(docs.select("doc_id", "text"), items, window)
    pairs = F.expr(f"transform(sequence(1, size({spans}) div 2), i -> 2 * i - 2)")
    pairs = F.when(F.size(spans) > 0, pairs).otherwise(F.array().cast("array<int>"))
    at = F.transform(
        pairs,
        lambda i: F.struct(F.get(spans, i).alias("first"), F.get(spans, i + 1).alias("end")),
    )
    return docs.select(
        "doc_id",
        n_words,
        F.aggregate(at, F.lit(0).cast("long"), lambda n, s: n + s.end - s.first).alias("n_hit"),
        longest,
        at.alias("hit_spans"),
        F.col(found).alias("hit_items"),
    )


def _cut(batches: Iterator[pa.RecordBatch], text: str, names: list[str], coverage: float):
    n_words, spans, _, _ = names
    for batch in batches:
        keep, texts = [], []
        rows = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text, n_words, spans))
        for value, count, flat in zip(*rows, strict=True):
            hit = sum(flat[1::2]) - sum(flat[::2])
            keep.append(not hit or hit <= coverage * count)
            if hit and keep[-1]:
                at = [m.span() for m in _WORD.finditer(value)]
                pieces, done = [], 0
                for first, end in zip(flat[::2], flat[1::2], strict=True):
                    pieces.append(value[done : at[first][0]])
                    done = at[end - 1][1]
                value = "".join([*pieces, value[done:]])
            texts.append(value)
        columns = [
            pa.array(texts, pa.string()) if n == text else batch.column(i)
            for i, n in enumerate(batch.schema.names)
            if n not in names
        ]
        kept = [n for n in batch.schema.names if n not in names]
        yield pa.RecordBatch.from_arrays(columns, kept).filter(pa.array(keep, pa.bool_()))


@releasing
def _marks_and_cut(batches: Iterator[pa.RecordBatch], marks: partial, coverage: float):
    """Both steps in one worker: two in a row would take two workers for each task."""
    yield from _cut(marks(batches), marks.keywords["text"], marks.keywords["names"], coverage)


def decontaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5
) -> DataFrame:
    """``docs`` without the stretches of text that ``contamination`` finds.

    Stretches of at least ``window`` matching words are cut out; a document is left
    out when more than ``coverage`` of its words are hit. All other rows and all
    columns stay as they are, also null and empty texts and repeated rows.
    """
    return _marked(docs, items, window, coverage)[0]

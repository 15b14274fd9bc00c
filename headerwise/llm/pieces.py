"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here and rebuilt as a ``tokenizers`` tokenizer: charsmap
normaliser, dummy prefix and metaspace marker, unigram scores or merges by score, byte
fallback. When no piece has a marker inside (checked), what stands between two markers
is encoded independently of the rest, so each distinct stretch is encoded once per task, by
multithreaded batches, checked against the SentencePiece library, and looked up from
then on. Other models encode whole texts in such batches.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from headerwise.llm.common import (
    CACHE_WORDS,
    by_batch,
    column_text,
    extended,
    opened,
    releasing,
    shipped,
    text_column,
)

#: Public 32,000-piece model with byte fallback.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Threads of the tokenizer in one task.
THREADS = 2
MODEL_BYTES = 64 << 20
#: Longer stretches are encoded where they occur and not remembered.
LONG_WORD = 200

_MARK = "▁"
_STRETCH = re.compile("▁+[^▁]*|[^▁]+")

# Numbers of the model file's fields, kinds of pieces and of models.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_UNIGRAM, _BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra_spaces: bool

    @property
    def separable(self) -> bool:
        """Whether no piece reaches over the start of a run of markers."""
        return not any(_MARK in p.lstrip(_MARK) for p in self.pieces)

    @property
    def identity(self) -> bool:
        return self.dummy_prefix and not self.charsmap and not self.remove_extra_spaces


def parse_model(data: bytes) -> PieceModel:
    pieces, scores, kinds = [], [], []
    trainer: dict[int, object] = {}
    normalizer: dict[int, object] = {}
    for number, value in _fields(data):
        if number == _PIECE:
            own = dict(_fields(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, _NORMAL))
        elif number == _TRAINER:
            trainer = dict(_fields(value))
        elif number == _NORMALIZER:
            normalizer = dict(_fields(value))
    kind = trainer.get(3, _UNIGRAM)
    if kind not in (_UNIGRAM, _BPE) or trainer.get(24) or not normalizer.get(5, 1):
        raise ValueError("only unigram and BPE models with escaped leading spaces")
    if _USER in kinds:
        raise ValueError("models with user-defined pieces are not supported")
    return PieceModel(
        pieces,
        scores,
        kinds,
        kind == _UNIGRAM,
        bool(trainer.get(35, 0)),
        normalizer.get(2, b""),
        bool(normalizer.get(3, 1)),
        bool(normalizer.get(4, 1)),
    )


def load_model(path: str = MODEL) -> bytes:
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than a model may be")
    with open(path, "rb") as file:
        return file.read()


def build_tokenizer(model: PieceModel):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {p: i for i, p in enumerate(model.pieces)}
    unknown = model.kinds.index(_UNKNOWN)
    if model.unigram:
        core = models.Unigram(
            list(zip(model.pieces, model.scores, strict=True)), unknown, model.byte_fallback
        )
    else:
        normal = {p for p, k in zip(model.pieces, model.kinds, strict=True) if k == _NORMAL}
        merges = sorted(
            (-model.scores[ids[p]], ids[p], ids[p[:i]], ids[p[i:]])
            for p in normal
            for i in range(1, len(p))
            if p[:i] in normal and p[i:] in normal
        )
        core = models.BPE(
            ids,
            [(model.pieces[a], model.pieces[b]) for *_, a, b in merges],
            unk_token=model.pieces[unknown],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(_MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", _MARK)])
    if model.separable:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(_STRETCH.pattern), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(_MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip]
    )
    return tokenizer


def codec_parts(data: bytes) -> tuple[bytes, PieceModel, str]:
    """What a ``Codec`` is made from: at most a few times the model file."""
    model = parse_model(data)
    return data, model, build_tokenizer(model).to_str()


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, data: bytes, model: PieceModel, tokenizer_json: str, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self.model, self.separable, self.identity = model, model.separable, model.identity
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.normalizer = self.tokenizer.normalizer
        if self.separable:
            # what it gets are stretches of normal text
            self.tokenizer.normalizer = Sequence([])
        self.line_ends = not any("\n" in p and len(p) > 1 for p in model.pieces)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes_of = [
            bytes([int(p[1:-1], 16)]) if k == _BYTE
            else b"" if k == _CONTROL
            else " ⁇ ".encode() if k == _UNKNOWN
            else p.replace(_MARK, " ").encode()
            for p, k in zip(model.pieces, model.kinds, strict=True)
        ]
        whole = zip(model.pieces, model.kinds, strict=True)
        self.bytes_in = np.array([1 if k == _BYTE else len(p.encode()) for p, k in whole], np.int64)
        self._restart()

    def _restart(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.equal, self.exact = np.zeros(0, bool), np.zeros(0, bool)
        self.flat = np.zeros(0, np.int32)

    def stretches(self, text: str) -> list[str]:
        """What the text's normal form consists of, each without its first marker, or
        with a zero character if it has none: what follows a line end, and line ends,
        when these are in no longer piece."""
        plain = self.identity and _MARK not in text and "\x00" not in text
        if plain and "  " not in text and text[:1] != " ":
            if self.line_ends:
                text = text.replace("\n", " \x00\n \x00")
            return text.split(" ")
        normal = self.normalizer.normalize_str(text)
        return [s[1:] if s[0] == _MARK else f"\x00{s}" for s in _STRETCH.findall(normal)]

    def _together(self, words: list[str], marked: bool):
        """Ids of several stretches in one go: all ids, the number of each, parity, and
        whether decoding gives each back.

        They are joined by their markers, or by line ends. The bytes that each piece
        stands for tell where a stretch ends; None if they do not, or if SentencePiece
        disagrees somewhere.
        """
        lead = _MARK if marked else "\n"
        whole = "".join([lead + w for w in words])
        skip = 0 if marked else len(_MARK.encode())
        whole = whole if marked else _MARK + whole
        # a batch of one, as that leaves out the offsets
        ids = self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        text = whole.replace(_MARK, " ")
        other = self.reference.encode(text[1:], out_type=int)
        # where the bytes of the whole are right, so are those between any two ends
        exact = b"".join(map(self.bytes_of.__getitem__, ids)) == text.encode("utf-8", "replace")
        ids = np.array(ids, np.int32)
        length = [len(w.encode("utf-8", "replace")) for w in words]
        wanted = np.cumsum(np.array(length, np.int64) + len(lead.encode())) + skip
        ends = np.cumsum(self.bytes_in[ids])
        at = np.searchsorted(ends, wanted)
        if len(ids) != len(other) or (ids != other).any() or at[-1] + 1 != len(ids):
            return None
        if (ends[at] != wanted).any():
            return None
        first = 0 if marked else 1  # the lone marker before the first line end
        size = np.diff(at, prepend=first - 1)
        if not marked:
            keep = np.ones(len(ids), bool)
            keep[0] = False
            keep[at - size + 1] = False
            ids, size = ids[keep], size - 1
        return ids, size, np.ones(len(words), bool), np.full(len(words), exact)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        whole = [w[1:] if w[:1] == "\x00" else _MARK + w for w in words]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        equal = np.ones(len(words), bool)
        if self.model.dummy_prefix:
            lone = self.reference.piece_to_id(_MARK)
            bare = [w[:1] == "\x00" for w in words]
            plain = ["\n" + w[1:] if b else w.replace(_MARK, " ") for w, b in zip(words, bare, strict=True)]
            other = self.reference.encode(plain, num_threads=1)
            other = [o[2:] if b else o if w else [lone]
                     for w, o, b in zip(words, other, bare, strict=True)]
            equal = np.array([a == b for a, b in zip(found, other, strict=True)], bool)
        flat = np.array([i for f in found for i in f], np.int32)
        back = (b"".join(map(self.bytes_of.__getitem__, f)) for f in found)
        exact = [b == w.replace(_MARK, " ").encode("utf-8", "replace") for b, w in zip(back, whole, strict=True)]
        return flat, np.array([len(f) for f in found], np.int64), equal, np.array(exact, bool)

    def _learn(self, words: list[str]) -> None:
        """Add stretches to what is known, many at a time where one ends in a letter."""
        marked = [w for w in words if self.identity and w.strip(_MARK) and w[0] != "\x00"]
        bare = [w for w in words if self.identity and self.line_ends and w[:1] == "\x00"]
        single = sorted(set(words).difference(marked, bare))
        groups = [(g[i : i + 1000], g is marked) for g in (marked, bare) for i in range(0, len(g), 1000)]
        first, at = len(self.size), len(self.flat)
        learnt = []
        for group, has_mark in [*groups, (single, None)]:
            if not group:
                continue
            together = None
            if has_mark is not None:
                together = self._together(group if has_mark else [w[1:] for w in group], has_mark)
            learnt.append(together or self._each(group))
            self.known.update(zip(group, range(first, first + len(group)), strict=True))
            first += len(group)
        # the arrays grow once for all groups, as growing copies them
        flat, size, equal, exact = (np.concatenate(parts) for parts in zip(*learnt, strict=True))
        self.start = np.concatenate((self.start, at + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.equal = np.concatenate((self.equal, equal))
        self.exact = np.concatenate((self.exact, exact))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and whether they are SentencePiece's."""
        return self.encode_checked(texts)[:2]

    def encode_checked(
        self, texts: list[str | None]
    ) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """``encode``, and whether decoding the ids is known to give the normal form
        back, as it does for every stretch."""
        if not self.separable:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            other = self.reference.encode([t or "" for t in texts], num_threads=1)
            same = np.array([f.ids == o for f, o in zip(found, other, strict=True)], bool)
            return [np.array(f.ids, np.int32) for f in found], same, np.zeros(len(texts), bool)
        if len(self.known) > CACHE_WORDS:
            self._restart()
        words, edges = [], [0]
        for t in texts:
            words += self.stretches(t) if t else []
            edges.append(len(words))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        new = {words[i] for i in missing}
        if new:
            self._learn(sorted(new))
            at[missing] = [self.known[words[i]] for i in missing]
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)]
        ends = np.concatenate(([0], ends))[edges]
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        same, exact = (
            np.array([x[a:b].all() for a, b in zip(edges[:-1], edges[1:], strict=True)], bool)
            for x in (self.equal[at], self.exact[at])
        )
        for w in [w for w in new if len(w) > LONG_WORD]:
            del self.known[w]
        return out, same, exact & (self.identity and self.model.dummy_prefix)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def normal(self, text: str) -> str:
        """The text that decoding gives back."""
        if self.identity:
            return text.replace(_MARK, " ")
        plain = self.normalizer.normalize_str(text).replace(_MARK, " ")
        return plain[1:] if self.model.dummy_prefix else plain


_ADDED = (("n_tokens", "long"), ("ids", "array<int>"), ("round_trip", "boolean"), ("parity", "boolean"))


@releasing
def _encode(batches: Iterator[pa.RecordBatch], shared, text: str, threads: int):
    codec = Codec(*opened(shared), threads)
    for batch in by_batch(batches, 200):
        texts = column_text(batch, text)
        ids, parity, exact = codec.encode_checked(texts)
        # stretches whose own bytes all come back make up the text again
        back = [
            bool(e) or codec.decode(i) == (codec.normal(t) if t else "")
            for i, t, e in zip(ids, texts, exact, strict=True)
        ]
        columns = [
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array(ids, pa.list_(pa.int32())),
            pa.array(back, pa.bool_()),
            pa.array(parity, pa.bool_()),
        ]
        names = [n for n, _ in _ADDED]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])


def encoded(
    docs: DataFrame, model: str = MODEL, text: str = "text", threads: int = THREADS
) -> DataFrame:
    """``docs`` with every whole text encoded: ``n_tokens``, ``ids``, ``round_trip``
    (whether decoding the ids gives the normalised text back) and ``parity`` (whether
    the SentencePiece library gives the same ids).

    Null and empty texts have no ids. Columns of those four names are replaced, all
    others stay; so do all rows. ``model`` is a file the driver reads.
    """
    docs = text_column(docs.drop(*[n for n, _ in _ADDED]), text)
    schema = extended(docs, ", ".join(f"{name} {kind}" for name, kind in _ADDED))
    shared = shipped(docs.sparkSession, codec_parts(load_model(model)))
    return docs.mapInArrow(partial(_encode, shared=shared, text=text, threads=threads), schema)


def _decode(batches: Iterator[pa.RecordBatch], shared, ids: str, out: str):
    codec = Codec(*opened(shared))
    for batch in by_batch(batches, 200):
        lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        size = len(codec.bytes_of)
        texts = [
            None if x is None
            else codec.decode(np.array([i for i in x if i is not None and 0 <= i < size], np.int32))
            for x in lists
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out]
        )


def decoded(rows: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of each row's ``ids``; null ids give null, unknown or null
    numbers nothing. A column called ``out`` is replaced."""
    rows = rows.drop(out)
    schema = extended(rows, f"{out} string")
    shared = shipped(rows.sparkSession, codec_parts(load_model(model)))
    return rows.mapInArrow(partial(_decode, shared=shared, ids=ids, out=out), schema)

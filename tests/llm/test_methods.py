"""Operators against brute force, exact round trips and held-out accuracy on small tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from headerwise.llm import decontaminate, lines
from headerwise.llm.components import components
from headerwise.llm.decontaminate import ItemAutomaton, contamination, decontaminated, words_of
from headerwise.llm.embeddings import similar_vectors
from headerwise.llm.learning import FEATURES, tables
from headerwise.llm.learning import labelled_sample
from headerwise.llm.lines import deduplicated_lines
from headerwise.llm.minhash import (
    WordHashes,
    band_keys,
    near_duplicates,
    shingle_set,
    signatures,
    sketch,
)
from headerwise.llm.pieces import (
    Codec,
    build_tokenizer,
    codec_parts,
    encoded,
    load_model,
    parse_model,
)
from headerwise.llm.pii import pii_digests, running_sum
from headerwise.llm.quality import OrdinalModel, fit_ordinal, quality_scores
from headerwise.llm.secrets import (
    PLACEHOLDERS,
    assignments,
    lexed,
    literal_findings,
    secret_digests,
    secret_spans,
    sensitivity,
)
from headerwise.llm.sharding import (
    OFFSET_SEED,
    _fraction_of,
    interleaved_shards,
    shuffle_key,
    write_shards,
)
from headerwise.llm.toxicity import ToxicityFeatures, fit_toxic, toxicity_scores
from tests.llm.conftest import odd_texts, sentence

SF = "/root/testdata/sf0.1"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# components and near duplicates


def lowest_reachable(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000, i) for i in range(5001, 5400)]
    links = chain + star + [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    found = components(spark.createDataFrame(links + links[:9], "a long, b long"))
    got = {r.id: r.component for r in found.collect()}
    ids = {i for pair in links if pair[0] != pair[1] for i in pair}
    assert got == lowest_reachable(ids, links)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near_texts():
    """Chains of copies with more and more words changed, many with the same passage."""
    rng = random.Random(3)
    out = ["", "one two", "One TWO", "one\x0btwo three", None, "é É é"]
    for _ in range(12):
        base = sentence(rng, 90).split()
        for _ in range(25):
            words = list(base)
            for i in rng.sample(range(90), rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 9, 20])):
                words[i] = rng.choice(["neu", "alt", str(rng.random())])
            out.append(" ".join(words))
    passage = sentence(rng, 40)
    out += [f"{passage} {sentence(rng, 30)}" for _ in range(60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    texts = near_texts()
    sets = {i: shingles(t, width) for i, t in enumerate(texts)}
    links = []
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    expected = lowest_reachable(sets, links)
    for r in near_duplicates(docs_of(spark, texts), width, percent).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for common, own in ((1, 0), (3, 1), (80, 10), (900, 300)):
        a = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
        x, y = np.unique(a[: common + own]), np.unique(np.concatenate((a[:common], a[common + own :])))
        s = signatures([x, y], 2048)
        assert abs((s[0] == s[1]).mean() - common / (common + 2 * own)) < 0.12
        differ = int(np.bitwise_count((sketch(x) ^ sketch(y)).view(np.uint64)).sum())
        assert differ <= 2 * own
        assert band_keys(signatures([x, y], 128), 32, 4).shape == (2, 32)


def test_white_space_and_case():
    known = WordHashes()
    same = [b"A b\tC\n d", b"a B c\x0cD", "a b c d".encode()]
    assert len({shingle_set(t, 3, known).tobytes() for t in same}) == 1
    assert len(shingle_set("a b c".encode(), 3, known)) == 1
    assert len(shingle_set(b"a b c d e f", 3, known)) == 4


# sharding


def test_shards_match_the_mixture(spark, tmp_path):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 5}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    for cell in (None, 50):
        found = interleaved_shards(docs, 7, shuffle_key(3, "doc_id"), ["doc_id"], cell_rows=cell)
        got = sorted((r.shard, r.slot, r.doc_id, r.source) for r in found.collect())
        sizes = Counter(g[0] for g in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
        assert [g[1] for g in got] == [i for s in range(7) for i in range(sizes[s])]
        for source, total in Counter(s for _, s in rows).items():
            per = Counter(g[0] for g in got if g[3] == source)
            assert all(abs(per[s] - total / 7) <= 2 for s in range(7))
        if cell is None:
            first = got
    assert got == first
    write_shards(found, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 5000 and back.select("shard").distinct().count() == 7


def test_a_source_per_row_spreads_over_cells(spark):
    """Sources of one row each: every place of the order is taken about evenly."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source")
    )
    parts = docs.select(_fraction_of(shuffle_key(OFFSET_SEED, "source")).alias("part"))
    cells = [r["count"] for r in parts.groupBy(F.floor(F.col("part") * 20)).count().collect()]
    assert len(cells) == 20 and max(cells) < 1300
    found = interleaved_shards(docs, 8, shuffle_key(3, "doc_id"), ["doc_id"])
    assert {r["count"] for r in found.groupBy("shard").count().collect()} == {2500}


# learnt models


def held_out(rows, labels):
    known = {r.doc_id: r for r in labels.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    return [(r, known[r.doc_id]) for r in rows if r.doc_id in known and fold(r.doc_id)]


def test_quality_on_held_out_labels(spark):
    docs, labels = tables(spark, SF)
    seen = labels.where("pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 3) <> 1")
    rows = quality_scores(docs, seen).collect()
    pairs = held_out(rows, labels)
    poor = [r.kept for r, label in pairs if label.quality == 0]
    good = [r.kept for r, label in pairs if label.quality == 1]
    assert np.mean(poor) < 0.06 and np.mean(good) > 0.98
    clean = [r.expected_grade for r, x in pairs if x.quality == 1 and not x.toxic]
    toxic = [r.expected_grade for r, x in pairs if x.quality == 1 and x.toxic]
    assert np.mean(clean) > np.mean(toxic) + 0.3
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


class Row:
    def __init__(self, grade, features, variants=()):
        self.doc_id, self.grade, self.features, self.variants = 0, grade, features, list(variants)


def test_ordinal_thresholds_are_ordered():
    rng = random.Random(1)
    rows = [Row(g, [f for f in range(8) if rng.random() < (0.15 + 0.25 * g if f < 4 else 0.5)])
            for g in (0, 1, 2, 3) for _ in range(150)]
    model = fit_ordinal(rows)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    z = np.array([model.weights[r.features].sum() for r in rows])
    tails = model.tails(z)
    assert (np.diff(tails, axis=1) <= 0).all()
    means = [tails[[r.grade == g for r in rows]].sum(axis=1).mean() for g in range(4)]
    assert means == sorted(means)
    assert isinstance(fit_ordinal(rows[:3]), OrdinalModel)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = tables(spark, SF)
    rows = toxicity_scores(docs, labels).collect()
    pairs = held_out(rows, labels)
    assert all(r.held_out for r, _ in pairs)
    toxic = np.array([r.predicted for r, x in pairs if x.toxic == 1])
    clean = np.array([r.predicted for r, x in pairs if x.toxic == 0])
    # about one in eight of these toxic labels is on a text without any sign of it:
    # no setting of ridge and feature selection found more than 0.89 of them
    assert toxic.mean() > 0.85 and clean.mean() < 0.01


def test_held_out_labels_do_not_matter(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    fold = "pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 3) = 1"
    turned = labels.selectExpr("doc_id", "quality", f"IF({fold}, 1 - toxic, toxic) AS toxic")
    assert toxicity_scores(docs, labels).collect() == toxicity_scores(docs, turned).collect()


def test_counterfactuals_reduce_identity_bias():
    rng = random.Random(4)
    texts = []
    for i in range(600):
        toxic = i % 2
        words = ["we", "met", "the", rng.choice(["calm", "tall"])]
        words += ["idiot"] if toxic and rng.random() < 0.7 else []
        words += ["muslims" if rng.random() < (0.9 if toxic else 0.05) else "christians"]
        texts.append((toxic, " ".join(words)))
    make = ToxicityFeatures()
    rows = [Row(g, make.features(t).tolist(), [v.tolist() for v in make.variants(t)]) for g, t in texts]
    neutral = [make.features(f"we met the {w}") for w in ("muslims", "christians")]
    gaps = []
    for fairness in (0.0, 1.0):
        model = fit_toxic(rows, fairness=fairness)
        score = [model.weights[f].sum() + model.bias for f in neutral]
        gaps.append(abs(score[0] - score[1]))
        insult = model.weights[make.features("we met the idiot christians")].sum() + model.bias
    assert gaps[1] < 0.2 * gaps[0]
    assert insult > score[1] + 1 and len(model.weights) == FEATURES


# benchmark text


def brute_hits(text, items, window):
    words = words_of(text.encode()) if text else []
    hit, found = set(), set()
    for key, item in items:
        w = words_of(item.encode()) if item else []
        size = min(window, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(key)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(6)
    word = lambda: rng.choice("ab cd ef gh É9 ij".split())
    items = [(str(i), " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12]) + 2)))
             for i in range(25)]
    items += [("25", None), ("26", "!!"), ("7", "ab ab ab ab")]
    texts = [None, "", *(", ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(80))]
    table = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: r for r in contamination(docs_of(spark, texts), table, window=5).collect()}
    for i, text in enumerate(texts):
        assert (found[i].n_words, found[i].n_hit, found[i].hit_items) == brute_hits(text, items, 5)
        assert sum(s.end - s.first for s in found[i].hit_spans) == found[i].n_hit


def test_longest_match_and_cutting(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    automaton = ItemAutomaton([("1", item.encode())], 10)
    assert automaton.need == 10
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = f"Before, {item.upper()}: after. " + "more words here " * 5
    docs = docs_of(spark, [text, item, "clean text", item[:-6]])
    rows = {r.doc_id: r for r in contamination(docs, table).collect()}
    assert rows[0].longest == 12 and rows[0].n_hit == 12 and rows[3].n_hit == 11
    left = {r.doc_id: r.text for r in decontaminated(docs, table).collect()}
    assert left == {0: "Before, : after. " + "more words here " * 5, 2: "clean text"}


# personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        turned = [int(d) for d in reversed(digits)]
        total = sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), i, m.end(), kind)
             for i, (kind, pattern) in enumerate(BASE.items())
             for m in pattern.finditer(text or "") if passes(kind, m.group())]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_pii_equals_brute_force(spark):
    rng = random.Random(8)
    parts = ["a@b.co", "x.y+z@q-w.e.fg%", "@", ".", "a@b@c.de", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8",
             "007.0.0.255", "4111 1111-1111 1111", "4111111111111112", "1 2-3", "+1 (509) 555-6973",
             "+12", "+1 ((((", "49-", "é", "\x01", "\U0001f600", "5500000000000004", "\n", "+", "9" * 25]
    texts = ["".join(rng.choice([*parts, " ", " "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", "1" * 50_000, "a" * 50_000, "a.a@" + "a." * 20_000, "1." * 30_000 + "+" + "1 " * 9000]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = {r.doc_id: r for r in pii_digests(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text)
        counts = Counter(k for k, _, _ in spans)
        row = found[i]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [counts[k] for k in BASE]
        assert row.base_sha256 == hashlib.sha256(said(spans).encode()).hexdigest()
        assert set(filter(None, said(spans).split(","))) <= set(row.spans.split(","))


def test_validators_and_context(spark):
    texts = ["pay to GB82 WEST 1234 5698 7654 32.", "pay to GB83 WEST 1234 5698 7654 32.",
             "my ssn is 078-05-1120", "part 078-05-1120", "call 555-123-4567", "id 555-123-4567",
             "my visa card 4111111111111111", "4111111111111111"]
    rows = {r.doc_id: r for r in pii_digests(docs_of(spark, texts)).collect()}
    assert [rows[i].n_other for i in range(8)] == [1, 0, 1, 0, 1, 0, 0, 0]
    assert rows[0].spans.startswith("iban:7:34")
    assert rows[6].scores[0] > rows[7].scores[0]


# embeddings


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([c + 0.22 * rng.standard_normal((rng.integers(1, 40), 32)) for c in centres])
    x = np.concatenate([x, x[:30], 3 * x[5:6]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = similar_vectors(table, leaf_rows=200, block_rows=64).collect()
    got = {r.vec_id: r for r in found}
    truth = close.sum(axis=1)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= truth).all() and links.sum() >= 0.97 * truth.sum()
    # one leaf of many blocks is exact
    whole = similar_vectors(table, leaf_rows=10**6, block_rows=64, trees=2).collect()
    assert {r.vec_id: r.n_links for r in whole} == dict(enumerate(truth.tolist()))
    reach = lowest_reachable(range(len(x)), np.argwhere(close).tolist())
    assert {r.vec_id: r.component_id for r in whole} == reach


def test_vectors_of_every_length_are_compared(spark):
    rng = np.random.default_rng(6)
    vectors = []
    for width, n in ((12, 400), (5, 150), (2, 3), (3, 2), (700, 2)):
        centres = rng.standard_normal((max(1, n // 4), width))
        near = centres[rng.integers(0, len(centres), n)] + 0.05 * rng.standard_normal((n, width))
        vectors += near.tolist()
    rng.shuffle(order := np.arange(len(vectors)))
    vectors = [vectors[i] for i in order]
    units = [np.array(v) / np.linalg.norm(v) for v in vectors]
    pairs = [
        (i, j) for i in range(len(units)) for j in range(i)
        if len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9
    ]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = similar_vectors(table, leaf_rows=60, block_rows=50).collect()
    degree = Counter(i for pair in pairs for i in pair)
    got = {r.vec_id: r.n_links for r in found}
    assert all(got[i] <= degree[i] for i in got) and sum(got.values()) >= 0.97 * 2 * len(pairs)
    whole = similar_vectors(table, leaf_rows=10**6).collect()
    assert {r.vec_id: r.n_links for r in whole} == {i: degree[i] for i in range(len(units))}
    assert {r.vec_id: r.component_id for r in whole} == lowest_reachable(
        range(len(units)), pairs + [(j, i) for i, j in pairs]
    )


# tokens


def test_tokens_and_parity_on_whole_texts(spark):
    import sentencepiece

    data = load_model()
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [t for t in odd_texts() if t and "￾" not in t][:-1]
    texts += ["  two  spaces ", " lead", "trail ", "   ", "\n\n", "a▁b", "<s> </s> <0x41>", "日本語 テキスト",
              "\U0001f600\U0001f600 é", "x" * 500]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = {r.doc_id: r for r in encoded(docs_of(spark, texts)).collect()}
    whole = build_tokenizer(parse_model(data))
    for i, text in enumerate(texts):
        assert rows[i].ids == reference.encode(text), text[:50]
        assert rows[i].parity and rows[i].round_trip and rows[i].n_tokens == len(rows[i].ids)
        if i % 50 == 0:
            assert whole.encode(text, add_special_tokens=False).ids == rows[i].ids
            assert whole.decode(rows[i].ids, skip_special_tokens=False) == text.replace("▁", " ")


def test_codec_forgets_and_goes_on(monkeypatch):
    from headerwise.llm import pieces

    codec = Codec(*codec_parts(load_model()))
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    for text in ("one two three four", "five six", "one two", "y" * 300, "one two three four"):
        ids, same = codec.encode([text, None, ""])
        assert codec.decode(ids[0]) == text and same.all() and len(ids[1]) == len(ids[2]) == 0


# learning


def test_sample_is_bound_in_rows_and_filled_with_documents(spark):
    rows = [(1, f"copy {i:03}") for i in range(300)] + [(i, f"text {i}") for i in range(2, 8)]
    rows += [(8, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, i % 2) for i in range(1, 60)] + [(1, 0), (None, 1), (3, None)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    texts = {1: "copy 000"} | {i: f"text {i}" for i in range(2, 8)}
    for n in (3, 7, 100):
        found = labelled_sample(docs, labels, F.col("toxic"), n).collect()
        assert len(found) == min(n, 7) == len({r.doc_id for r in found})
        assert all(r.text == texts[r.doc_id] for r in found)
        assert all(r.grade == (r.doc_id % 2 if r.doc_id > 1 else 0) for r in found)


# lines


_GAP = r"\s\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def brute_lines(rows):
    """The rule in plain Python: texts, and numbers of lines, chunks and gone chunks.

    64-bit hashes are those of the job; texts have no scripts without spaces."""
    h = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42)
    chunks, seen, lengths = {}, defaultdict(list), {}
    for doc_id, text in rows:
        pieces = []
        for line in re.split(r"(?s)(?:(?<=\n)|(?<=[.!?]\x20))(?=.)", text):
            if len(line.encode()) < lines.CUT_BYTES:
                pieces.append(line)
                continue
            words = re.findall(rf"(?:[^{_GAP}]+|(?=[{_GAP}]))[{_GAP}]*", line)
            part = ""
            for i, w in enumerate(words):
                part += w
                signed = h(w) - (2**64 if h(w) >= 2**63 else 0)
                if signed % lines.CUT_WORDS == 0 or i == len(words) - 1:
                    pieces.append(part)
                    part = ""
        hashes = [h(p.rstrip(" \t\r\n")) for p in pieces]
        own, part = [], []
        for i, piece in enumerate(pieces):
            part.append(piece)
            last = hashes[i - 1] if i else 0
            rolled = (((last << 1) | (last >> 63)) & (2**64 - 1)) ^ hashes[i] if i else hashes[i]
            if rolled % 2 == 0 or i == len(pieces) - 1:
                own.append(part)
                part = []
        chunks[doc_id], lengths[doc_id] = own, len(pieces)
        for k, c in enumerate(own):
            if whole := "".join(c).strip(" \t\r\n"):
                seen[whole].append((doc_id, k))
    marked = {p for places in seen.values() for p in sorted(places)[1:]}
    out = {}
    for d, own in chunks.items():
        gone, run = set(), []
        for k in range(len(own) + 1):
            if (d, k) in marked:
                run.append(k)
                continue
            size = sum(len(own[j]) for j in run)
            words = 0
            for j in run:
                whole = "".join(own[j]).strip(" \t\r\n")
                words += max(len(re.findall(rf"[^{_GAP}]+", whole)), len(whole) // lines.WORD_CHARS)
            if (size >= lines.MIN_LINES and words >= lines.MIN_WORDS) or words >= lines.LONG_LINE:
                gone |= set(run)
            run = []
        text = "".join("".join(c) for k, c in enumerate(own) if k not in gone)
        some = bool("".join("".join(c) for c in own))
        out[d] = text, lengths[d] * some, len(own) * some, len(gone)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    passages = [" ".join(sentence(rng, rng.randrange(4, 9)).capitalize() + "." for _ in range(12))
                for _ in range(6)]
    passages += [sentence(rng, 60) + "\n", sentence(rng, 120), sentence(rng, 50).replace(" ", "\t") + "\n"]
    texts = []
    for _ in range(160):
        parts = [rng.choice(passages) if rng.random() < 0.4 else sentence(rng) + rng.choice([". ", "\n", " "])
                 for _ in range(rng.randrange(1, 8))]
        texts.append(rng.choice(["\n", " "]).join(parts))
    texts += ["", "\n", "a. b. c.\n\n", texts[3], texts[3] + " more"]
    rows = list(enumerate(texts))
    report = deduplicated_lines(docs_of(spark, texts), report=True).collect()
    found = {r.doc_id: (r.text, r.n_lines, r.n_chunks, r.n_removed) for r in report}
    assert found == brute_lines(rows)
    kept = sum(len(x[0]) for x in found.values()) / sum(map(len, texts))
    assert kept < 0.75  # most of the repeated passages are gone


def test_a_sentence_between_fresh_ones_stays(spark):
    rng = random.Random(2)
    same = sentence(rng, 25)
    texts = [f"{sentence(rng, 13)}. {same}. {sentence(rng, 13)}." for _ in range(200)]
    found = {r.doc_id: r.text for r in deduplicated_lines(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(200)] == texts


def repeated_windows(texts, window=50):
    """Words in windows of so many that came before, and all words; in plain Python."""
    seen, hit, total = set(), 0, 0
    for text in texts:
        words = text.split()
        marked = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                marked[i : i + window] = [True] * window
            seen.add(key)
        hit, total = hit + sum(marked), total + len(words)
    return hit, total


def test_repeated_passages_go_wherever_they_stand(spark):
    rng = random.Random(4)
    cut = lambda n, step: " ".join(sentence(rng, step) + "." for _ in range(n // step))
    passages = [f(n) for n in (50, 55, 70, 100, 300)
                for f in (lambda n: sentence(rng, n), lambda n: cut(n, 5), lambda n: cut(n, 14),
                          lambda n: cut(n, 25), lambda n: sentence(rng, n).replace(" ", "\n"))]
    texts, fresh = [], []
    for k in range(120):
        around = [sentence(rng, rng.randrange(1, 30)) for _ in range(3)]
        fresh.append(around)
        inside = [rng.choice(passages) for _ in range(2)] if k >= len(passages) else [passages[k], ""]
        texts.append(" ".join(x for pair in zip(around, [*inside, ""], strict=True) for x in pair if x))
    found = {r.doc_id: r.text for r in deduplicated_lines(docs_of(spark, texts)).collect()}
    left = [found[i] for i in range(len(texts))]
    hits, _ = repeated_windows(texts)
    # the chunks at both ends of a passage stay, and short passages are hardly more
    assert hits > 10_000 and repeated_windows(left)[0] < 0.3 * hits
    # what came once stays, and so does the first of each passage
    assert left[: len(passages)] == texts[: len(passages)]
    assert all(x in left[k] for k, parts in enumerate(fresh) for x in parts)


@pytest.mark.parametrize("passage", [
    "\n".join(f"item{i}" for i in range(60)) + "\n",
    "\t".join(f"cell{i}" for i in range(60)),
    "one two three four five\nsix seven\teight nine ten eleven\n",
    "".join(chr(0x4E00 + 37 * i) for i in range(60)),
    "".join(chr(0x0E01 + random.Random(i).randrange(46)) for i in range(200)),
    "\n".join("".join(chr(0x4E00 + 37 * i + j) for i in range(8)) for j in range(2)) + "\n",
    "x" * 1200,
    "a b c d e f g\u3000h i\nj k l m n o p\n",
])
def test_words_are_counted_in_any_white_space_and_script(spark, passage):
    texts = [passage, passage, "one two\nthree\n", "one two\nthree\n"]
    found = {r.doc_id: r.text for r in deduplicated_lines(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(4)] == [passage, "", texts[2], texts[3]]


def test_short_repeats_and_scattered_pieces_stay(spark):
    # each line came before, but no two of them side by side
    a = ["yes it is.\n", "new one here.\n", "no thank you.\n", "other one there.\n", "good bye now.\n"]
    texts = ["".join(a), a[0] + a[2] + a[4] + "then " + sentence(random.Random(1), 5), "yes it is.\n"]
    found = {r.doc_id: r.text for r in deduplicated_lines(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(3)] == texts


# secrets


def test_secret_patterns_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += [None, "", "PassWord : 'abcdefgh1' API-KEY=x api_key=\"12345678\" tokens=12345678",
              "AKIA1234567890AB AKIASHORT akia1234567890abcd", "f" * 31 + " " + "0" * 32,
              "tokenK = 12345678 Key", "secret=" * 3000, "token" + " " * 20_000]
    rx = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
    found = {r.doc_id: r for r in secret_digests(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in rx.finditer(text) if len(m.group(2)) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
        spans.sort()
        names = ("assign", "access", "hex")
        counts = Counter(k for _, k, _ in spans)
        row = found[i]
        assert [row.n_assign, row.n_access, row.n_hex] == [counts[k] for k in range(3)]
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_assignments_follow_constants():
    source = 'A = "s3cr3tVa1ue-9f8e7d"\nB = A + "xyz"\ndb_password = B\ncolor = "blue"\n'
    spans = {name: [source[a:b] for a, b in s] for name, s in assignments(source)}
    assert spans["db_password"] == ["s3cr3tVa1ue-9f8e7d", "xyz"] and spans["color"] == ["blue"]
    found = {source[a:b]: name for a, b, _, name in literal_findings(source)}
    assert found == {"s3cr3tVa1ue-9f8e7d": "db_password", "xyz": "db_password"}
    for text, hit in [
        ("clientSecret: Zx81-Qp22-Lm93\n", True),
        ('"private_key": "Zx81Qp22Lm93Aa71",', True),
        ("export DB_PWD=Zx81Qp22Lm93Aa71\n", True),
        ('password = "changeme"\n', False),
        ('password = "${DB_PASSWORD}"\n', False),
        ('title = "Zx81Qp22Lm93Aa71"\n', False),
        ("monkey = 'Zx81Qp22Lm93Aa71'\n", False),
        ("the token is here: we met again\n", False),
    ]:
        assert bool(literal_findings(text)) is hit, text
    assert [k for _, k, *_ in secret_spans('auth_token = "Zx81Qp22Lm93Aa71"')] == ["assign", "literal"]


@pytest.mark.parametrize(
    "source",
    [
        'x = "abc123DEFxyz"\n' + "x = x + x\n" * 1000 + "password = x\n",
        'a = "q1W2e3r4t5"\n' + 'a = a + "zz"\n' * 20_000 + "password = a\n",
        'password = "' + '\\"' * 500_000,
        "a = x1\n" + "a=" * 300_000,
        "token:" + " " * 500_000 + "\n",
    ],
    ids=["doubled", "chained", "open quote", "assigned", "spaces"],
)
def test_lexing_takes_time_in_proportion(source):
    start = time.perf_counter()
    found = literal_findings(source)
    assert time.perf_counter() - start < 10
    assert bool(found) == ("password = x" in source or "password = a" in source)


def test_literals_equal_a_plain_follower():
    """Against every list spelled out, on random sources."""
    rng = random.Random(4)
    words = ["password", "x", "y", "api_key", '"abc123DEFxyz"', "'s3cr3tValue99'", "=", " = ", ":", "+",
             " + ", "\n", "\n", '"', "'", '\\"', "{", '"${A}"', '"your_key"', "bare12Ab34cdef", '""', "=="]
    for _ in range(5000):
        source = "".join(rng.choices(words, k=rng.randint(1, 24)))
        values, best = [], {}
        for one in lexed(source):
            values.append([s for p in one.parts for s in (values[p] if isinstance(p, int) else [p])])
            weight = sensitivity(one.target)
            form = strength("".join(source[a:b] for a, b in values[-1]))
            if weight and form and weight + form >= 0.6:
                for a, b in values[-1]:
                    if b > a and weight + form > best.get((a, b), (0, ""))[0] + 1e-9:
                        best[a, b] = weight + form, one.target
        found = {(a, b): (round(score, 9), name) for a, b, score, name in literal_findings(source)}
        assert found == {s: (round(score, 9), name) for s, (score, name) in best.items()}, source


def strength(value):
    if len(value) < 6 or PLACEHOLDERS.match(value) or value.count(" ") > 3:
        return 0.0
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(0.4, bits / 200) + (0.1 if kinds >= 3 else 0.05 if kinds == 2 else 0.0)


def test_positions_of_very_many_findings(spark):
    """A text with 50,000 addresses, and running sums of every small length."""
    text = " ".join(f"a{i}@b.co" for i in range(50_000))
    start = time.perf_counter()
    row = pii_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.perf_counter() - start < 60
    expected = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text))
    assert row.n_email == 50_000 and row.spans == expected
    numbers = spark.range(1, 70).select(F.sequence(F.lit(1), F.col("id").cast("int")).alias("x"))
    for x, sums in numbers.select("x", running_sum(F.col("x"))).collect():
        assert sums == [sum(x[: i + 1]) for i in range(len(x))]


def test_decontamination_takes_one_worker_a_task(spark):
    """Pipeline out of memory in decontaminate: two Arrow steps in a row took two workers."""
    docs = small_docs(spark, [(1, "a b c d e f"), (2, "x y"), (3, None)])
    items = spark.createDataFrame([("i", "b c")], "item_id string, text string")
    out = decontaminated(docs, items, coverage=0.5)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, "a  d e f"), (2, "x y"), (3, None)}


def test_lines_are_cut_once(spark):
    """op9_lines over its time: every text was cut three times."""
    shared = "One line here is long enough. Two lines here are as well. Three it is now. "
    rows = [(i, f"{shared * 2}End {i}.") for i in range(6)] + [(6, ""), (7, None), (None, "\n")]
    out = deduplicated_lines(small_docs(spark, rows), report=True)
    assert "replace(" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r.doc_id: r for r in out.collect()}
    assert found[6].text == "" and found[7].text is None and found[None].text == "\n"
    assert (found[6].n_lines, found[7].n_chunks, found[None].n_lines) == (0, 0, 1)
    assert found[0].text == rows[0][1] or found[0].n_removed
    assert all(found[i].n_removed == found[1].n_removed > 0 for i in range(1, 6))


def test_known_stretches_are_not_decoded_again(spark, monkeypatch):
    """op8_sentencepiece over its time: each text was decoded token by token."""
    decoded = []
    whole = Codec.decode
    monkeypatch.setattr(Codec, "decode", lambda self, ids: decoded.append(1) or whole(self, ids))
    codec = Codec(*codec_parts(load_model()))
    texts = ["a plain text", "two\nlines  and blanks", " \u2581 mark", "\U0001f600 \u4f60", None, ""]
    ids, same, exact = codec.encode_checked(texts)
    assert same.all() and exact.all() and not decoded
    for text, own in zip(texts, ids, strict=True):
        assert whole(codec, own) == (codec.normal(text) if text else "")


def small_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")

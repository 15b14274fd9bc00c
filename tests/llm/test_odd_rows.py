"""Every operator and pipeline stage on odd rows, on no rows, and on clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headerwise.llm import ranking, substrings
from headerwise.llm.decontaminate import contamination, decontaminated
from headerwise.llm.divergence import divergences
from headerwise.llm.embeddings import similar_vectors
from headerwise.llm.lines import deduplicated_lines, line_report
from headerwise.llm.minhash import near_duplicates, without_near_duplicates
from headerwise.llm.pieces import decoded, encoded
from headerwise.llm.pii import pii_digests, pii_spans
from headerwise.llm.quality import of_quality, quality_scores
from headerwise.llm.ranking import ranked_documents
from headerwise.llm.secrets import find_secrets, secret_digests
from headerwise.llm.sharding import interleaved_shards, shard_digests, shuffle_key
from headerwise.llm.substrings import without_repeats
from headerwise.llm.toxicity import toxicity_scores


def items(spark):
    rows = [(1, "abc def"), (None, "x"), (2, None), (3, ""), (3, "x"), (3, "x")]
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "quality_scores": lambda s, d, lab: quality_scores(d, lab),
    "near_duplicates": lambda s, d, lab: near_duplicates(d),
    "shard_digests": lambda s, d, lab: shard_digests(d),
    "interleaved_shards": lambda s, d, lab: interleaved_shards(
        d, 3, shuffle_key(1, "doc_id", "text"), ["n_chars"]
    ),
    "toxicity_scores": lambda s, d, lab: toxicity_scores(d, lab),
    "contamination": lambda s, d, lab: contamination(d, items(s)),
    "pii_digests": lambda s, d, lab: pii_digests(d),
    "pii_spans": lambda s, d, lab: pii_spans(d),
    "encoded": lambda s, d, lab: decoded(encoded(d)),
    "line_report": lambda s, d, lab: line_report(d),
    "deduplicated_lines": lambda s, d, lab: deduplicated_lines(d),
    "find_secrets": lambda s, d, lab: find_secrets(d),
    "without_repeats": lambda s, d, lab: without_repeats(d),
    "secret_digests": lambda s, d, lab: secret_digests(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_every_row(spark, odd, empty, labels, name):
    operator = OPERATORS[name]
    found = operator(spark, odd, labels)
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    expected = [r.doc_id for r in odd.select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, expected))
    assert operator(spark, empty, labels).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, empty, labels, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = stage(spark, odd, str(tmp_path))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == odd.columns
    assert 0 < found.count() <= odd.count()
    assert stage(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.parametrize("operator", [of_quality])
def test_filters_keep_columns(spark, odd, labels, operator):
    assert operator(odd, labels).columns == odd.columns


def test_without_labels_all_documents_stay(spark, odd, labels):
    none = labels.where("false")
    assert of_quality(odd, none).count() == odd.count()
    assert toxicity_scores(odd, none).where("predicted = 1").count() == 0


def test_defined_results(spark, odd, labels):
    near = {r.doc_id: r for r in near_duplicates(odd).collect()}
    assert near[0].n_shingles == near[1].n_shingles == near[2].n_shingles == 0
    assert near[7].component_id == 6 and not near[7].kept  # the long text again
    assert near[None].component_id is None and near[None].kept
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 2
    whole = decontaminated(odd, items(spark))
    assert whole.columns == odd.columns
    assert whole.where("text = 'x'").count() == 0  # all of its one word is an item
    assert whole.where("text IS NULL").count() == 2


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.01]), (9, [1.0, 0.0]), (10, [1.0]),
            (None, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1e-200, 1e-200]), (13, [1e200, 1e200])]
    found = similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 3, 4, 5, 10, 11):
        assert got[i] == (0, i, True)
    assert [got[i][:2] for i in (6, 7, 8, 9)] == [(3, 6)] * 4
    assert got[None] == (0, None, True) and got[12][:2] == got[13][:2] == (1, 12)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert similar_vectors(none).collect() == []
    assert similar_vectors(none.withColumn("n", F.lit(1))).columns == [
        "vec_id", "n_links", "component_id", "kept",
    ]


def test_ranking_of_odd_rows(spark, odd, empty):
    found = ranked_documents(odd, items(spark)).collect()
    assert ranked_documents(empty, items(spark)).collect() == []
    assert ranked_documents(odd, items(spark).where("false")).collect() == []
    by_item = {}
    for r in found:
        by_item.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    # the item of null id has the term x, and so have two rows that are answered each
    assert len(by_item[3]) == 2 * len(by_item[None]) and 2 not in by_item
    ranks = [r for r, _, _ in sorted(by_item[None])]
    assert ranks == list(range(1, len(ranks) + 1)) and all(r.score > 0 for r in found)


def test_ranking_ties_blocks_and_empty_texts(spark, monkeypatch):
    rows = [(i, "same words here") for i in (9, 4, 7, None, 4)] + [(1, ""), (2, None), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([("a", "Same!"), ("b", "other same"), ("c", "-")], "item_id string, text string")
    best = ranked_documents(docs, asked, depth=4).collect()
    found = {(r.item_id, r["rank"]): r.doc_id for r in best}
    assert [found["a", k] for k in range(1, 5)] == [4, 4, 7, 9] and found["b", 1] == 3
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 1)  # each item in an index of its own
    again = ranked_documents(docs, asked, depth=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, best))


def test_repeats_in_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    part = " ".join(f"w{i}" for i in range(20, 55))
    texts = [(1, long), (1, long), (None, "a " * 40), (2, f"x {part} y"), (3, "a b"), (4, "é\u00a0" * 50)]
    found = without_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in found)
    assert got == [
        ("1", 60, 60, ""), ("1", 60, 60, ""), ("2", 37, 35, "x y"), ("3", 2, 0, "a b"),
        ("4", 1, 0, "é\u00a0" * 50), ("None", 40, 40, ""),
    ]


@pytest.mark.parametrize(("window", "anchor"), [(3, 8), (5, 2), (12, 4)])
def test_repeats_equal_brute_force(spark, monkeypatch, window, anchor):
    rng = random.Random(window)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(0, 60))) for _ in range(80)]
    texts += [" ".join(texts[k : k + 3]) for k in range(0, 30, 3)]

    def expected():
        seen = Counter(tuple(w[i : i + window]) for t in texts if (w := t.split()) for i in range(len(w) - window + 1))
        for t in texts:
            w, gone = t.split(), set()
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i : i + window])] > 1:
                    gone |= set(range(i, i + window))
            yield len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = lambda: [
        (r.n_words, r.n_removed, r.kept_text)
        for r in without_repeats(docs, window, anchor).orderBy("doc_id").collect()
    ]
    assert run() == list(expected())


def test_colliding_hashes_do_not_remove(spark, monkeypatch):
    # paths of different words get the same name: their words are read and told apart
    texts = [" ".join(f"{p}{i}" for i in range(30)) for p in "abcd"] + [" ".join(f"a{i}" for i in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compacted = substrings._compacted

    def collide(paths):
        return compacted(paths).withColumns({"path": F.lit(1).cast("long"), "parts": F.lit(1), "edges": F.lit(1)})

    other = spark.createDataFrame([(7, "b0 b1 b2 b3 b4 b5 b6 b7 z"), (8, "c9 c10 c11 c12 c13 c14 c15")], "doc_id long, text string")
    plain = {r.doc_id: r.n_removed for r in without_repeats(docs.union(other), 5, 3).collect()}
    monkeypatch.setattr(substrings, "_compacted", collide)
    found = {r.doc_id: r.n_removed for r in without_repeats(docs.union(other), 5, 3).collect()}
    assert plain == {0: 30, 1: 8, 2: 7, 3: 0, 4: 30, 7: 8, 8: 7}
    assert all(found[k] <= plain[k] for k in plain) and found[3] == 0


def test_divergences_of_odd_rows(spark, odd, empty):
    assert divergences(empty).collect() == []
    # each language has one source, so none differs from another or from its language
    assert divergences(odd).collect() == []
    rows = [("en", s, t) for s, t in [("a", "one two"), ("b", "one Two"), (None, "one three"), ("", ""), ("c", None)]]
    rows += [("fr", "a", "un"), ("fr", "b", "x" * 70_000)] + [("xx", "a", "é" * 300)] * 3
    small = divergences(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    items = {(r.lang, r.source, r.part, r["item"]): (r.value, r["rank"]) for r in small}
    assert [k for k in items if k[0] == "fr"] and all(v[0] == 0 for k, v in items.items() if k[0] == "fr")
    assert {k[3] for k in items if k[:3] == ("en", "c", "pair")} == {"", "a", "b"}
    # of en one term is kept; a source of one language only has no excess over it
    assert not any(k[2] == "term" and k[0] == "xx" for k in items)

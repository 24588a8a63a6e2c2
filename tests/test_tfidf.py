from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import tfidf
from rankloom.operators.tfidf import TfidfSettings
from rankloom.staging import stage

CORPUS = [(1, "apple apple banana"), (2, "banana cherry"), (3, "banana date apple"), (4, "")]
PLAIN = TfidfSettings(max_features=100, ngram_range=(1, 1), min_df=1, max_df=1.0, stop_words=None)


def tokens(spark, rows):
    return stage(tfidf.token_table(spark.createDataFrame(rows, "id long, text string"), "id",
                                   F.col("text")), "t")


def weights(spark, vectors, vocabulary):
    return {(r.doc_id, r.term): r.w for r in tfidf.vectors_as_terms(vectors, vocabulary).collect()}


def test_idf_weights_and_norm_by_hand(spark):
    table = tokens(spark, CORPUS)
    vocabulary = tfidf.fit_vocabulary(table, PLAIN)
    by_term = {r.term: r for r in vocabulary.collect()}
    assert {t: (r.df, r.tf) for t, r in by_term.items()} == {
        "apple": (2, 3), "banana": (3, 3), "cherry": (1, 1), "date": (1, 1)}
    assert [by_term[t].term_id for t in sorted(by_term)] == [0, 1, 2, 3]
    for term, df in (("apple", 2), ("banana", 3), ("cherry", 1)):
        assert by_term[term].idf == pytest.approx(math.log(5 / (1 + df)) + 1)
    got = weights(spark, tfidf.tfidf_vectors(table, vocabulary, PLAIN), vocabulary)
    a, b = 2 * (math.log(5 / 3) + 1), math.log(5 / 4) + 1
    assert got[(1, "apple")] == pytest.approx(a / math.hypot(a, b))
    assert got[(1, "banana")] == pytest.approx(b / math.hypot(a, b))


def test_sublinear_tf(spark):
    settings = PLAIN.with_(sublinear_tf=True)
    table = tokens(spark, CORPUS)
    vocabulary = tfidf.fit_vocabulary(table, settings)
    got = weights(spark, tfidf.tfidf_vectors(table, vocabulary, settings), vocabulary)
    a, b = (1 + math.log(2)) * (math.log(5 / 3) + 1), math.log(5 / 4) + 1
    assert got[(1, "apple")] == pytest.approx(a / math.hypot(a, b))


def test_every_document_has_a_vector(spark):
    table = tokens(spark, CORPUS)
    vocabulary = tfidf.fit_vocabulary(table, PLAIN)
    other = tokens(spark, [(9, "unknown words only"), (8, None), (7, "unknown apple unknown")])
    got = {r.doc_id: list(r.weights) for r in tfidf.tfidf_vectors(other, vocabulary, PLAIN).collect()}
    assert got == {9: [], 8: [], 7: [pytest.approx(1.0)]}


def test_frequency_pruning_and_cap(spark):
    table = tokens(spark, CORPUS)
    kept = lambda **c: sorted(r.term for r in tfidf.fit_vocabulary(table, PLAIN.with_(**c)).collect())
    assert kept(min_df=2) == ["apple", "banana"]
    assert kept(max_df=0.5) == ["apple", "cherry", "date"]
    assert kept(max_features=2) == ["apple", "banana"]      # equal counts: alphabetical
    with pytest.raises(ValueError):
        tfidf.fit_vocabulary(table, PLAIN.with_(min_df=4))


def test_kept_columns_follow_their_document(spark):
    rows = spark.createDataFrame([(1, "apple", "A"), (2, None, None), (3, "banana", "B")],
                                 "id long, text string, title string")
    table = stage(tfidf.token_table(rows, "id", F.col("text"), keep=["title"]), "t")
    vectors = tfidf.tfidf_vectors(table, tfidf.fit_vocabulary(table, PLAIN), PLAIN, ["title"])
    assert {r.doc_id: r.title for r in vectors.collect()} == {1: "A", 2: None, 3: "B"}


def test_a_large_vocabulary_is_joined_without_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([("r1", "a.txt", "apple date"), ("r2", "a.txt", "banana cherry"), ("r3", "b.txt", None),
                                  ("r3", "b.txt", "zebra"), ("r4", "c.txt", "apple apple banana cherry date")],
                                 "request string, id string, text string")
    table = stage(tfidf.token_table(rows, "id", F.col("text"), keep=["request"]), "t")
    vocabulary = tfidf.fit_vocabulary(table, PLAIN)
    ways, results = [], []
    by_join = tfidf._vectors_by_join
    monkeypatch.setattr(tfidf, "_vectors_by_join", lambda *a: ways.append("join") or by_join(*a))
    for fits in (True, False):
        monkeypatch.setattr(tfidf, "fits_broadcast", lambda df, fits=fits: fits)
        results.append(sorted((r.request, r.doc_id, tuple(r.term_ids), tuple(round(w, 12) for w in r.weights))
                              for r in tfidf.tfidf_vectors(table, vocabulary, PLAIN, ["request"]).collect()))
    assert ways == ["join"] and results[0] == results[1] and len(results[0]) == 5


def test_n_grams_of_one_long_document(spark):
    from collections import Counter

    words = [f"w{i % 6000}" for i in range(6500)]
    table = spark.createDataFrame([(1, words)], "doc_id long, tokens array<string>")
    got = {r.term: (r.df, r.tf) for r in tfidf.term_stats(table, (1, 5)).collect()}
    want = Counter(" ".join(words[i:i + n]) for n in range(1, 6) for i in range(len(words) - n + 1))
    assert got == {t: (1, c) for t, c in want.items()}


def test_term_counts_need_no_shuffle(spark):
    table = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (1, ["a"])], "doc_id long, tokens array<string>")
    counts = tfidf.term_counts(table, (1, 2))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 1), (1, "a", 2), (1, "a b", 1), (1, "b", 1), (1, "b a", 1)]


def test_the_second_stop_list_removes_what_cleaning_left(spark):
    from rankloom.functions.words import ENGLISH_STOP_WORDS, VECTORIZER_STOP_WORDS

    assert len(VECTORIZER_STOP_WORDS) == len(set(VECTORIZER_STOP_WORDS)) == 318
    assert len(set(VECTORIZER_STOP_WORDS) - set(ENGLISH_STOP_WORDS)) > 150
    rows = spark.createDataFrame([(1, "One whole system, however, seems to cry un idiot")], "id long, text string")
    settings = tfidf.base_settings()
    assert tfidf.staged_tokens(rows, "id", "text", settings).first().tokens == ["idiot"]


@pytest.mark.parametrize("largest", [1 << 62, 2000])
def test_counting_kernel_by_brute_force(monkeypatch, largest):
    import random
    from collections import Counter

    import pyarrow as pa

    from rankloom.operators import grams as kernels
    from rankloom.operators.grams import batch_grams, gram_totals

    # A small limit makes the kernel halve its batch.
    monkeypatch.setattr(kernels, "LARGEST", largest)
    random.seed(2)
    lists = [[random.choice("abcde") * 2 for _ in range(random.randrange(9))] for _ in range(40)] + [[]]
    batch = pa.RecordBatch.from_pydict({"tokens": pa.array(lists, pa.list_(pa.string()))})
    for allowed in (None, {"aa", "cc", "dd"}, set()):
        tf, df = Counter(), Counter()
        for words in lists:
            grams = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)
                     if allowed is None or set(words[i:i + n]) <= allowed]
            tf.update(grams)
            df.update(set(grams))
        given = None if allowed is None else pa.array(sorted(allowed), pa.large_string())
        got = {}
        for out in gram_totals(iter([batch]), 1, 3, given):
            for row in out.to_pylist():
                before = got.get(row["term"], (0, 0))
                assert largest < 1 << 62 or before == (0, 0)
                got[row["term"]] = (before[0] + row["df"], before[1] + row["tf"])
        assert got == {t: (df[t], tf[t]) for t in tf}
    flat = [(g, int(r)) for grams, rows in batch_grams(batch.column("tokens"), 2, 2)
            for g, r in zip(grams.to_pylist(), rows)]
    assert flat == [(f"{a} {b}", i) for i, words in enumerate(lists) for a, b in zip(words, words[1:])]


def test_pruned_candidates_give_the_same_vocabulary(spark):
    import random

    random.seed(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(random.choices(words, weights=[1 / (i + 1) for i in range(60)], k=30))) for d in range(60)]
    table = tokens(spark, rows)
    for features, min_df, max_df, grams in ((5, 1, 1.0, (1, 2)), (30, 3, 0.5, (1, 2)), (40, 2, 0.9, (2, 2)),
                                            (50, 2, 0.8, (1, 3)), (10_000, 1, 1.0, (1, 2))):
        settings = PLAIN.with_(max_features=features, min_df=min_df, max_df=max_df, ngram_range=grams)
        stats = tfidf.term_stats(table, grams).where((F.col("df") >= min_df) & (F.col("df") <= max_df * 60))
        want = stats.orderBy(F.desc("tf"), "term").limit(features).collect()
        got = tfidf.fit_vocabulary(table, settings).collect()
        assert {(r.term, r.df, r.tf) for r in got} == {(r.term, r.df, r.tf) for r in want}

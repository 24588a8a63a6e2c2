from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rankloom.functions.vectors import hashed_words, inner_product, l2_normalize, mean_pooling
from rankloom.operators import lemmas, masking, sampling, statistics
from rankloom.operators.tfidf import base_settings
from rankloom.operators import wordmodel
from rankloom.plans import corpus, matching, report


def smallest(ids, n, seed=42):
    return set(sorted(ids, key=lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest())[:n])


@pytest.mark.parametrize("n", [0, 1, 37, 500])
def test_exact_sample(spark, n):
    df = spark.range(500).toDF("id")
    assert {r.id for r in sampling.sample_exact(df, "id", n).collect()} == smallest(range(500), n)


def test_exact_sample_does_not_shuffle_rows(spark):
    df = spark.range(500).select("id", F.lit("text").alias("text"))
    assert "Exchange" not in sampling.sample_exact(df, "id", 37)._jdf.queryExecution().toString()


def test_sample_larger_than_table(spark):
    with pytest.raises(ValueError):
        sampling.sample_exact(spark.range(5).toDF("id"), "id", 6)


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.33, 1.0])
def test_split(spark, fraction):
    split = sampling.train_validation_split(spark.range(97).toDF("id"), "id", fraction)
    held = {r.id for r in split.where("split = 'validation'").collect()}
    assert held == smallest(range(97), math.ceil(97 * fraction)) and split.count() == 97


@pytest.mark.parametrize("total", [0, 12, 400, 10_000])
def test_stratified_sample(spark, total):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"t{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "job_id long, title string")
    got = {r.job_id for r in sampling.stratified_sample(df, "job_id", total).collect()}
    titles = {t for _, t in rows if t}
    share = max(1, total // len(titles))
    want = set()
    for t in titles:
        want |= smallest([i for i, x in rows if x == t], share)
    assert got == want


def test_combined_corpus_keeps_the_bag(spark):
    resumes = spark.createDataFrame([(1, "x"), (2, "x"), (3, "")], "id long, text_cleaned string")
    jobs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "job_id long, title string, text_cleaned string")
    both, sampled = corpus.combined_corpus(resumes, jobs)
    assert sorted((r.origin, r.id, r.text_cleaned) for r in both.collect()) == [
        ("job", 1, "x"), ("job", 2, "y"), ("resume", 1, "x"), ("resume", 2, "x"), ("resume", 3, "")]
    assert sampled.count() == 2


def test_word_statistics(spark):
    df = spark.createDataFrame([("b a a",), (None,), ("",), ("b c a",)], "t string")
    assert [(r.word, r.cnt) for r in statistics.word_frequency(df, "t", 2).collect()] == [("a", 3), ("b", 2)]
    assert {r.word: r.weight for r in statistics.word_weights(df, "t").collect()} == {
        "a": 1.0, "b": pytest.approx(2 / 3), "c": pytest.approx(1 / 3)}
    assert [r[0] for r in df.select(statistics.document_length(F.col("t"))).collect()] == [3, 0, 0, 3]


def test_histogram(spark):
    df = spark.createDataFrame([("w " * n,) for n in (0, 1, 5, 10, 10)], "t string")
    bins = statistics.length_histogram(df, "t", 5).orderBy("bin").collect()
    assert [b.cnt for b in bins] == [2, 0, 1, 0, 2] and (bins[0].lo, bins[-1].hi) == (0.0, 10.0)
    same = statistics.length_histogram(df.where("t = ''"), "t", 4).orderBy("bin").collect()
    assert [b.cnt for b in same] == [0, 0, 1, 0] and (same[0].lo, same[-1].hi) == (-0.5, 0.5)


def test_top_words_and_titles(spark):
    df = spark.createDataFrame([("x", "bb aa aa"), ("x", "cc bb"), ("y", "zz"), (None, "aa"), ("z", "qq qq")],
                               "cat string, t string")
    got = [(r["cat"], r["rank"], r.word, r.cnt)
           for r in statistics.top_words_by_category(df, "t", "cat", 2, 2).orderBy("cat", "rank").collect()]
    assert got == [("x", 1, "aa", 2), ("x", 2, "bb", 2), ("y", 1, "zz", 1)]
    assert tuple(statistics.distinct_titles(df, "cat").first()) == (3, 4)


def test_pairwise_similarity_is_symmetric(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "bb cc"), (3, None), (4, "dd"), (5, "aa bb")], "id long, t string")
    got = {(r.doc_a, r.doc_b): r.score for r in report.pairwise_similarity(df, "id", "t", 3).collect()}
    assert set(got) == {(a, b) for a in (1, 2, 4) for b in (1, 2, 4)}
    assert all(got[a, b] == got[b, a] for a, b in got) and got[1, 1] == pytest.approx(1.0) and got[1, 4] == 0


def test_report_tables(spark):
    resumes = spark.createDataFrame([(1, "aa bb"), (2, "bb cc")], "id long, text_cleaned string")
    jobs = spark.createDataFrame([(1, "x", "aa"), (2, "y", "bb cc")], "job_id long, title string, text_cleaned string")
    tables = report.explore(resumes, jobs)
    assert len(tables) == 8 and all(t.count() for t in tables.values())


def test_lexicon_and_lemmas(spark):
    counts = spark.createDataFrame(
        [("studies", 2), ("study", 9), ("studying", 1), ("cars", 1), ("car", 3), ("care", 5), ("caring", 1),
         ("fast", 4), ("faster", 1), ("s", 7), ("bus", 2)], "word string, cnt long")
    lexicon = lemmas.build_lexicon(counts)
    assert {tuple(r) for r in lexicon.select("word", "pos", "lemma").collect()} == {
        ("studies", "noun", "study"), ("studies", "verb", "study"), ("studying", "verb", "study"), ("cars", "noun", "car"),
        ("cars", "verb", "car"), ("caring", "verb", "care"), ("faster", "adj", "fast")}
    df = spark.createDataFrame([(1, "The cars, studying faster bus"), (2, None), (3, "cars cars")], "id long, t string")
    for rows in (None, 0):
        got = lemmas.lemmatize(df, "id", lemmas.clean_tokens(F.col("t")), lexicon, "out", max_bytes=rows)
        assert {r.id: r.out for r in got.collect()} == {1: "car studying faster bus", 2: "", 3: "car car"}
    tagged = spark.createDataFrame([(1, ["studying", "cars"], ["VBG", None]), (1, ["studying"], ["NN"]), (1, [], [])],
                                   "id long, w array<string>, tags array<string>")
    for rows in (None, 0):
        got = lemmas.lemmatize(tagged, "id", F.col("w"), lexicon, "out", F.col("tags"), rows)
        assert sorted(r.out for r in got.collect()) == ["", "study car", "studying"]
    cleaned = lemmas.clean_and_lemmatize(df, "id", "t", lexicon)
    assert cleaned.columns == ["id", "text_cleaned"]
    tags = spark.createDataFrame([("JJR",), ("VBZ",), ("RB",), ("NNS",), ("CD",)], "t string")
    assert [r[0] for r in tags.select(lemmas.wordnet_pos(F.col("t"))).collect()] == [
        "adj", "verb", "adv", "noun", "noun"]


def test_padding(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],)], "t array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(masking.pad_or_truncate(F.col("t"), 2)).collect()]
    assert got == [[("a", 1), ("b", 1)], [("[PAD]", 0), ("[PAD]", 0)]]


def test_masking_shares(spark):
    words = [f"w{i}" for i in range(200)]
    tokens = spark.createDataFrame([(d, words) for d in range(200)], "doc_id long, tokens array<string>")
    vocabulary = spark.createDataFrame([(w,) for w in words], "term string")
    rows = masking.mask_tokens(tokens, vocabulary, length=150).collect()
    chosen = [r for r in rows if r.label is not None]
    assert len(rows) == 200 * 150 and abs(len(chosen) / len(rows) - 0.15) < 0.01
    assert all(r.token == f"w{r.pos}" for r in rows if r.label is None)
    assert abs(sum(r.token == "[MASK]" for r in chosen) / len(chosen) - 0.8) < 0.03
    assert abs(sum(r.token == r.label for r in chosen) / len(chosen) - 0.1) < 0.03


def test_masked_corpus(spark):
    lines = spark.createDataFrame([(i, f"alpha beta gamma word{i % 3}") for i in range(30)], "doc_id long, line string")
    out = corpus.masked_corpus(lines, base_settings(min_df=1, max_df=1.0, ngram_range=(1, 1), stop_words=None))
    assert out.select("doc_id", "split").distinct().groupBy("split").count().orderBy("split").collect() == [
        ("train", 27), ("validation", 3)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], 1), (1, [1.0, 0.0], 0), (1, [1.0, 2.0], 1), (2, [0.0, 0.0], 0)],
                               "k long, v array<float>, m int")
    assert [list(r.v) for r in l2_normalize(df, "v").collect()][::3] == [[0.6, 0.8], [0.0, 0.0]]
    pooled = {(r.k, r["dim"]): r.value for r in mean_pooling(df, "k", "v", F.col("m")).collect()}
    assert pooled == {(1, 0): 2.0, (1, 1): 3.0, (2, 0): 0.0, (2, 1): 0.0}
    assert df.select(inner_product(F.col("v"), F.col("v"))).first()[0] == 25.0


def test_hashed_words_are_unit_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta  Alpha"), (2, "alpha alpha beta"), (3, None), (4, " ")], "id long, text string")
    rows = {r.doc_id: list(r.embedding) for r in matching.semantic_vectors(df, "id", "text", hashed_words(8)).collect()}
    bits = lambda w: [2 * (hashlib.md5(w.encode()).digest()[0] >> (7 - k) & 1) - 1 for k in range(8)]
    sums = [2 * a + b for a, b in zip(bits("alpha"), bits("beta"))]
    norm = math.sqrt(sum(x * x for x in sums))
    assert rows[1] == pytest.approx([x / norm for x in sums]) and rows[2] == pytest.approx(rows[1])
    assert rows[3] == rows[4] == [0.0] * 8


def test_domain_ranking(spark):
    texts = ["alpha beta gamma", "beta gamma delta", "delta alpha", "gamma gamma beta", "alpha"]
    resumes = spark.createDataFrame([(f"{i}.txt", t) for i, t in enumerate(texts)], "doc_id string, text string")
    jobs = spark.createDataFrame([(7, "alpha beta"), (8, "")], "query_id long, text string")
    rows = corpus.domain_ranking(jobs, resumes, 3, hashed_words()).collect()
    for query in (7, 8):
        ranked = sorted((r["rank"], r.doc_id, r.score) for r in rows if r.query_id == query)
        assert [r[0] for r in ranked] == [1, 2, 3] and all(r[1].endswith(".txt") for r in ranked)
        assert [r[2] for r in ranked] == sorted((r[2] for r in ranked), reverse=True)
        assert all(-1.000001 <= r[2] <= 1.000001 for r in ranked)


def test_domain_ranking_learns_from_the_corpus(spark):
    # "alpha" and "omega" never stand together, but among the same words: only a corpus tells that they are alike.
    around = ["red", "green", "blue", "white", "black"]
    texts = [f"{a} {w} {b}" for w in ("alpha", "omega") for a in around for b in around if a != b]
    texts += [f"{a} gamma {b}" for a in ("one", "two", "three") for b in ("four", "five", "six")]
    resumes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, "omega"), (901, "gamma"), (902, None), (903, "zzz")],
                                    "doc_id long, text string")
    jobs = spark.createDataFrame([(7, "alpha")], "query_id long, text string")
    settings = wordmodel.WordModelSettings(dim=64, rounds=2)
    scores = {r.doc_id: r.score for r in corpus.learnt_domain_ranking(jobs, resumes, 1000, settings).collect()}
    assert len(scores) == len(texts) + 4 and scores[900] > 0.8 and scores[901] < 0 and scores[902] == scores[903]
    hashed = {r.doc_id: r.score for r in corpus.domain_ranking(jobs, resumes, 1000, hashed_words()).collect()}
    assert hashed[900] < 0.5


def test_domain_ranking_without_words(spark):
    resumes = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    jobs = spark.createDataFrame([(7, "")], "query_id long, text string")
    rows = corpus.learnt_domain_ranking(jobs, resumes, 5, wordmodel.WordModelSettings()).collect()
    assert sorted(tuple(r) for r in rows) == [(7, 1, 1, 0.0), (7, 2, 2, 0.0)]

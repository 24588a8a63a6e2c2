from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rankloom.operators import ranking, requests
from rankloom.operators.joins import join_lookup
from rankloom.plans import matching


@pytest.fixture(scope="module")
def scored(spark):
    random.seed(4)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", i, random.choice([0.0, 0.25, 0.5, 0.75])) for i in range(900)]
    return rows, spark.createDataFrame(rows, "g string, doc_id long, score double").repartition(5)


def expected(rows, k=None):
    out = set()
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        out |= {(g, r[1], i + 1) for i, r in enumerate(ordered) if k is None or i < k}
    return out


def as_set(df):
    return {(r.g, r.doc_id, r["rank"]) for r in df.collect()}


def test_rank_all_equals_sorting(scored):
    rows, df = scored
    assert as_set(ranking.rank_all(df, "g", [F.desc("score"), F.asc("doc_id")])) == expected(rows)


@pytest.mark.parametrize("k", [1, 20, 5000])
def test_rank_top(scored, monkeypatch, k):
    rows, df = scored
    order = [F.desc("score"), F.asc("doc_id")]
    assert as_set(ranking.rank_top(df, "g", order, k, "doc_id")) == expected(rows, k)
    monkeypatch.setattr(ranking, "GROUP_LIMIT", 0)
    assert as_set(ranking.rank_top(df, "g", order, k, "doc_id")) == expected(rows, k)


def test_rank_top_cuts_before_the_shuffle(scored):
    plan = ranking.rank_top(scored[1], "g", [F.desc("score")], 3, "doc_id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_messages(spark):
    assert ranking.effective_top_k(None, 7) == (7, "✅ Showing all 7 job matches, ranked by relevance.")
    assert ranking.effective_top_k(9, 7) == (
        7, "ℹ️ You requested 9 matches, but only 7 are available. Showing all 7 matches.")
    assert ranking.effective_top_k(3, 7) == (3, "✅ Showing the top 3 job matches.")
    for bad in (0, -1):
        with pytest.raises(ValueError):
            ranking.effective_top_k(bad, 7)
    asked = spark.createDataFrame([(None,), (9,), (3,)], "k long")
    got = [r[0] for r in asked.select(ranking.top_k_message(F.col("k"), F.lit(7))).collect()]
    assert got == [ranking.effective_top_k(k, 7)[1] for k in (None, 9, 3)]


def test_display(spark):
    row = spark.range(1).select(ranking.clip_score(F.lit(1.0000004)).alias("a"),
                                ranking.display_score(F.lit(0.123456)).alias("b")).first()
    assert (row.a, row.b) == (1.0, "0.1235")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_shuffled_lookup_equals_broadcast(spark, how):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(300)], "id long, key string")
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "key string, v long")
    pick = lambda rows: sorted((r.id, r.key, r.v or 0) for r in rows.collect())
    shuffled = join_lookup(big, lookup, "key", how, max_bytes=0)
    assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
    small = join_lookup(big, lookup, "key", how)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert pick(shuffled) == pick(small)


@pytest.mark.parametrize("max_bytes", [None, 0])
def test_request_scores_by_brute_force(spark, max_bytes):
    rng = np.random.default_rng(5)
    q, d = rng.random((4, 8)) * (rng.random((4, 8)) < 0.4), rng.random((60, 8)) * (rng.random((60, 8)) < 0.3)
    d[7] = 0
    owner = [0 if i % 3 == 0 else i % 4 for i in range(60)]
    rows = lambda m: [(i, [int(j) for j in np.flatnonzero(v)], [float(x) for x in v[np.flatnonzero(v)]])
                      for i, v in enumerate(m)]
    schema = "doc_id long, term_ids array<int>, weights array<double>"
    queries = spark.createDataFrame(rows(q), schema)
    documents = spark.createDataFrame([(*r, owner[r[0]]) for r in rows(d)], schema + ", request_id long")
    got = {r.doc_id: (r.request_id, r.score)
           for r in requests.request_scores(queries, documents, max_bytes).collect()}
    assert got == {i: (owner[i], pytest.approx(float(q[owner[i]] @ d[i]), abs=1e-9)) for i in range(60)}


TEXTS = ["spark engineer builds data pipelines", "data pipelines in spark", "nurse cares for patients",
         "patients need a nurse", "cook makes soup", "soup and bread cook"]


@pytest.fixture(scope="module")
def jobs(spark):
    titles = ["engineer", "engineer", "nurse", "nurse", None, None]
    return spark.createDataFrame([(i, titles[i], t) for i, t in enumerate(TEXTS)],
                                 "job_id long, title string, text string")


def small():
    from rankloom.operators.tfidf import base_settings
    return base_settings(min_df=1, max_df=1.0)


def test_match_titles_lists_each_title_once(spark, jobs):
    resumes = spark.createDataFrame([(1, "spark data pipelines"), (2, "")], "query_id long, text string")
    got = matching.match_titles(resumes, jobs, settings=small()).orderBy("query_id", "rank").collect()
    assert [r.title for r in got if r.query_id == 1][0] == "engineer"
    assert {r.title for r in got if r.query_id == 1} == {"engineer", "nurse", None}
    assert [(r.title, r.job_id, r.score) for r in got if r.query_id == 2] == [
        ("engineer", 0, 0.0), ("nurse", 2, 0.0), (None, 4, 0.0)]
    with pytest.raises(ValueError):
        matching.match_titles(resumes, jobs, top_k=0, settings=small())


def test_a_text_matches_itself(spark, jobs):
    same = jobs.select(F.col("job_id").alias("query_id"), "text")
    ranked = matching.rank_resumes(same, same.withColumnRenamed("query_id", "doc_id"), 1, settings=small())
    assert all(r.query_id == r.doc_id and r.score == pytest.approx(1.0) for r in ranked.collect())


def test_fitted_parts_are_reused(spark, jobs):
    from rankloom.operators import tfidf

    settings = small()
    tokens = tfidf.staged_tokens(jobs, "job_id", "text", settings, ["title"])
    vocabulary = tfidf.fit_vocabulary(tokens, settings)
    vectors = tfidf.tfidf_vectors(tokens, vocabulary, settings, ["title"])
    resumes = spark.createDataFrame([(1, "nurse for patients")], "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(matching.match_titles(resumes, jobs, 2, settings=settings)) == rows(
        matching.match_titles(resumes, jobs, 2, vocabulary=vocabulary, job_vectors=vectors, settings=settings))


def test_requests_rank_only_their_own_files(spark):
    asked = spark.createDataFrame([("a", "spark data"), ("b", "nurse")], "request_id string, text string")
    files = spark.createDataFrame([("a", "1.txt", TEXTS[0]), ("a", "2.txt", TEXTS[2]), ("b", "3.txt", TEXTS[3])],
                                  "request_id string, doc_id string, text string")
    got = {tuple(r)[:3] for r in matching.rank_requests(asked, files, settings=small()).collect()}
    assert got == {("a", 1, "1.txt"), ("a", 2, "2.txt"), ("b", 1, "3.txt")}
    top = {tuple(r)[:3] for r in matching.rank_requests(asked, files, 1, settings=small()).collect()}
    assert top == {("a", 1, "1.txt"), ("b", 1, "3.txt")}


def test_responses(spark, jobs):
    resumes = spark.createDataFrame([(1, "spark data pipelines"), (2, "soup")], "query_id long, text string")
    ranked = matching.match_titles(resumes, jobs, 5, settings=small())
    rows = matching.responses(resumes, ranked, "title", 3, 5).orderBy("query_id").collect()
    assert [m.label for m in rows[0].matches][0] == "engineer" and len(rows[1].matches) == 3
    assert rows[0].message == ranking.effective_top_k(5, 3)[1]


def test_embed_column_takes_any_encoder(spark):
    @F.pandas_udf(ArrayType(DoubleType()))
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(t.count("a")), float(t.count("b"))])

    jobs = spark.createDataFrame([(1, "x", "<b>aaaa</b>"), (2, "x", "aab"), (3, "y", "bb")],
                                 "id long, title string, text string")
    vectors = matching.semantic_vectors(jobs, "id", "text", letters, ["title"])
    best = matching.match_titles_dense(vectors.where("doc_id = 3"), vectors, 2).orderBy("rank").collect()
    assert [(r.title, r.job_id) for r in best] == [("y", 3), ("x", 2)]
    df = spark.createDataFrame([(1, "aaabbbb"), (2, None)], "id long, text string")
    got = {r.id: list(r.embedding) for r in matching.embed_column(df, "text", letters).collect()}
    assert got == {1: [pytest.approx(0.6), pytest.approx(0.8)], 2: [0.0, 0.0]}

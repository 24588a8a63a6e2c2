from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from rankloom.operators import blocks, search
from rankloom.registry.queries import QUERIES

def dense_table(spark, matrix, titles=None):
    rows = [(i * 10, [float(x) for x in v], titles[i] if titles else None) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>, title string")


def sparse_table(spark, matrix, titles=None):
    rows = [(i * 10, [int(j) for j in np.flatnonzero(v)], [float(x) for x in v[np.flatnonzero(v)]],
             titles[i] if titles else None) for i, v in enumerate(matrix)]
    return spark.createDataFrame(
        rows, "doc_id long, term_ids array<int>, weights array<double>, title string")


def brute_force(queries, index, k, titles=None):
    out = set()
    for q, scores in enumerate(np.round(queries @ index.T, 9)):
        seen, rank = set(), 0
        for d in sorted(range(len(index)), key=lambda j: (-scores[j], j)):
            if titles is not None:
                if titles[d] in seen:
                    continue
                seen.add(titles[d])
            rank += 1
            if rank <= k:
                out.add((q * 10, rank, d * 10, round(float(scores[d]), 9)))
    return out


def found(df):
    return {(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect()}


def limit_for(mode, index_cells):
    return {"queries broadcast": None, "index broadcast": index_cells, "blocks": 9}[mode]


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(1)
    index = rng.normal(size=(40, 6)) * (rng.random((40, 6)) < 0.5)
    index[::3] = index[1]                       # a third of the rows are alike
    index[4] = 0
    queries = rng.normal(size=(90, 6)) * (rng.random((90, 6)) < 0.5)
    queries[5] = 0
    as_float = lambda m: m.astype(np.float32).astype(np.float64)
    return as_float(queries), as_float(index)


@pytest.mark.parametrize("limit", [None, 9])
@pytest.mark.parametrize("make", [dense_table, sparse_table])
def test_all_scores_has_every_pair(spark, matrices, make, limit, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 30)
    monkeypatch.setattr(search, "SCORE_CELLS", 100)
    queries, index = matrices
    rows = search.all_scores(make(spark, queries), make(spark, index), limit).collect()
    want = np.round(queries @ index.T, 9)
    assert len(rows) == want.size and len({(r.query_id, r.doc_id) for r in rows}) == want.size
    assert all(abs(r.score - want[r.query_id // 10, r.doc_id // 10]) < 2e-9 for r in rows)


def test_dense_inner_product_keeps_pairs_beyond_the_tenth(spark, tmp_path):
    rows = [(i, [1.0, float(i)], i % 3) for i in range(13)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.vec_id): r.score for r in QUERIES["dense_inner_product"](spark, str(tmp_path)).collect()}
    assert got == {(a, b): 1.0 + a * b for a in range(13) for b in range(13)}


@pytest.mark.parametrize("mode", ["queries broadcast", "index broadcast", "blocks"])
@pytest.mark.parametrize("make", [dense_table, sparse_table])
@pytest.mark.parametrize("k", [1, 7, 100])
def test_every_way_of_searching_is_exact(spark, matrices, mode, make, k):
    queries, index = matrices
    limit = limit_for(mode, 40 * 7)
    got = search.top_k(make(spark, queries), make(spark, index), k, max_broadcast_cells=limit)
    assert found(got) == brute_force(queries, index, k)


@pytest.mark.parametrize("mode", ["queries broadcast", "index broadcast", "blocks"])
def test_one_row_per_title(spark, matrices, mode):
    queries, index = matrices
    titles = ["hot" if i % 3 == 0 else None if i % 7 == 1 else f"t{i % 5}" for i in range(len(index))]
    got = search.top_k(sparse_table(spark, queries), sparse_table(spark, index, titles), 4, one_per_title=True,
                       max_broadcast_cells=limit_for(mode, 40 * 7))
    assert found(got) == brute_force(queries, index, 4, titles)


def test_large_k_is_a_prefix_property(spark, matrices):
    queries, index = matrices
    ten = found(search.top_k(dense_table(spark, queries), dense_table(spark, index), 10))
    eleven = found(search.top_k(dense_table(spark, queries), dense_table(spark, index), 11))
    assert ten == {r for r in eleven if r[1] <= 10}


def test_text_ids_and_empty_sides(spark):
    index = spark.createDataFrame([("b.txt", [0], [1.0]), ("a.txt", [0], [1.0]), ("c.txt", [], [])],
                                  "doc_id string, term_ids array<int>, weights array<double>")
    query = spark.createDataFrame([(1, [0], [1.0])], "doc_id long, term_ids array<int>, weights array<double>")
    got = [(r.query_id, r["rank"], r.doc_id, r.score) for r in search.top_k(query, index, 5).orderBy("rank").collect()]
    assert got == [(1, 1, "a.txt", 1.0), (1, 2, "b.txt", 1.0), (1, 3, "c.txt", 0.0)]
    assert search.top_k(query.where("false"), index, 5).count() == 0
    assert search.top_k(query, index.where("false"), 5).count() == 0


def test_k_must_be_positive(spark, matrices):
    table = dense_table(spark, matrices[1])
    with pytest.raises(ValueError):
        search.top_k(table, table, 0)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.integers(1, 12), st.integers(1, 15), st.integers(0, 10_000))
def test_best_rows_equals_sorting(n, rows, k, seed):
    scores = np.random.default_rng(seed).integers(-3, 4, size=(rows, n)) / 2
    row, column, rank = search.best_rows(scores, np.arange(n), k)
    want = [(r, c, i + 1) for r in range(rows)
            for i, c in enumerate(sorted(range(n), key=lambda c: (-scores[r, c], c))[:k])]
    assert list(zip(row, column, rank)) == want


def test_long_vectors_are_scored_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    index, queries = rng.random((6, 50)), rng.random((3, 50))
    monkeypatch.setattr(search, "ENTRY_CHUNK", 60)
    monkeypatch.setattr(search, "SCORE_CELLS", 6)
    q, d = (search.Block(sparse_table(spark, m).toArrow()) for m in (queries, index))
    got = np.vstack([search.score_block(q, d, a, b) for a, b in search.query_chunks(q, d)])
    assert got == pytest.approx(np.round(queries @ index.T, 9))


@pytest.mark.parametrize("mode", ["queries broadcast", "index broadcast", "blocks"])
def test_score_summary(spark, matrices, mode):
    queries, index = matrices
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    queries, index = unit(queries), unit(index)
    summary = search.similarity_summary(
        sparse_table(spark, queries), sparse_table(spark, index),
        {"queries broadcast": None, "index broadcast": 40 * 7, "blocks": 60}[mode]).first()
    scores = np.round(queries @ index.T, 9)
    assert summary["min"] == scores.min() and summary["max"] == scores.max()
    assert summary["mean"] == pytest.approx((queries @ index.T).mean(), abs=1e-8)
    assert summary["median"] == pytest.approx(np.median(scores), abs=1e-12)


@pytest.mark.parametrize("make", [dense_table, sparse_table])
def test_two_large_sides_meet_without_the_driver(spark, matrices, monkeypatch, make):
    """Above the limit nothing but counts reaches the driver, and equal ids do not make a block larger."""
    queries, index = matrices
    monkeypatch.setattr(blocks.packed, "__defaults__", (30,))
    monkeypatch.setattr(blocks.meet_tables, "__defaults__", (30,))
    refuse = lambda *a, **k: pytest.fail("a table passes the driver")
    monkeypatch.setattr(type(make(spark, queries)), "toArrow", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    packed = blocks.packed(make(spark, index).withColumn("doc_id", F.lit(1)), "embedding" if make is dense_table else "term_ids", 30)
    assert packed.count() > 5
    got = search.top_k(make(spark, queries), make(spark, index), 3, max_broadcast_cells=9)
    rows = got.collect()
    monkeypatch.undo()
    assert found(spark.createDataFrame(rows, got.schema)) == brute_force(queries, index, 3)

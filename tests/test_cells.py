"""Search by cells around pivots against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F, types as T

from rankloom.operators import cells, search
from tests.test_search import brute_force, dense_table, found


def clustered(rng, rows, spread=0.05, clusters=12, dim=8):
    centres = rng.normal(size=(clusters, dim))
    return (centres[rng.integers(0, clusters, rows)] + spread * rng.normal(size=(rows, dim))).astype(np.float32).astype(np.float64)


def built(spark, tmp_path, matrix, titles=None, size=60, max_pivots=16):
    path = cells.build_cells(dense_table(spark, matrix, titles), str(tmp_path / "cells"), size, max_pivots)
    return cells.open_cells(spark, path)


def searched(queries, index, k, titles=False):
    return found(search.top_k_in_cells(queries, index, T.LongType(), k, titles))


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(5)
    index, queries = clustered(rng, 150), clustered(rng, 40)
    queries[:20] = index[:20]
    index[::3] = index[1]                           # a third of the rows are alike: ties, and one cell of many blocks
    index[4] = 0
    index[5] *= 50                                  # norms differ
    index[7] *= -3
    queries[5] = 0
    return queries, index.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("k", [1, 6, 200])
def test_cells_equal_all_pairs(spark, tmp_path, sides, k):
    queries, index = sides
    assert searched(dense_table(spark, queries), built(spark, tmp_path, index), k) == brute_force(queries, index, k)


def test_cells_with_titles(spark, tmp_path, sides):
    queries, index = sides
    titles = ["hot" if i % 3 == 0 else None if i % 7 == 1 else f"t{i % 5}" for i in range(len(index))]
    got = searched(dense_table(spark, queries), built(spark, tmp_path, index, titles), 4, True)
    assert got == brute_force(queries, index, 4, titles)


def test_far_cells_and_rings_are_passed_over(spark, tmp_path):
    """Near clusters answer: the second round visits few of all (query, row) pairs, and the answers are whole."""
    rng = np.random.default_rng(6)
    matrix = clustered(rng, 600, 0.01)
    index = built(spark, tmp_path, matrix, size=200)
    queries = dense_table(spark, matrix[:50])
    assert searched(queries, index, 5) == brute_force(matrix[:50], matrix, 5)
    asked = cells._with_homes(queries.select("doc_id", "embedding"), index, 5)
    best = {q: s for q, r, _, s in brute_force(matrix[:50], matrix, 5) if r == 5}
    floors = spark.createDataFrame(list(best.items()), "doc_id long, floor double")
    rows = dict(zip(index.summary["cell"].tolist(), index.summary["rows"].tolist()))
    passes = [sum(rows[r.cell] for r in cells._visits(asked.join(floors, "doc_id"), index, home).select("cell").collect())
              for home in (True, False)]
    assert sum(passes) < 0.5 * 50 * 600


def test_a_hot_cell_is_many_blocks(spark, tmp_path, sides):
    index = built(spark, tmp_path, np.repeat(sides[1][1:2], 300, axis=0), size=90)
    assert len(index.summary["cell"]) == 1 and index.summary["blocks"][0] >= 30
    assert index.blocks.agg(F.max("rows")).first()[0] <= 10
    got = searched(dense_table(spark, sides[1][1:2]), index, 3)
    assert [(rank, doc) for _, rank, doc, _ in sorted(got)] == [(1, 0), (2, 10), (3, 20)]


def test_empty_sides_zeros_and_missing_ids(spark, tmp_path, sides):
    queries, index = sides
    empty = dense_table(spark, index[:1]).where("false")
    none = cells.open_cells(spark, cells.build_cells(empty, str(tmp_path / "none")))
    assert searched(dense_table(spark, queries[:3]), none, 3) == set()
    full = built(spark, tmp_path, index)
    assert searched(empty, full, 3) == set()
    nameless = dense_table(spark, queries[:1]).withColumn("doc_id", F.lit(None).cast("long"))
    assert searched(nameless, full, 3) == {(None, r, d, s) for _, r, d, s in brute_force(queries[:1], index, 3)}
    zeros = cells.open_cells(spark, cells.build_cells(dense_table(spark, np.zeros((4, 3))), str(tmp_path / "zeros")))
    assert searched(dense_table(spark, np.ones((1, 3))), zeros, 2) == {(0, 1, 0, 0.0), (0, 2, 10, 0.0)}
    with pytest.raises(ValueError):
        search.top_k_in_cells(empty, full, T.LongType(), 0)


def test_pivots_differ_where_copies_prevail(spark, sides):
    pivots = cells.choose_pivots(dense_table(spark, sides[1]), 16)
    assert len(np.unique(np.round(pivots, 9), axis=0)) == len(pivots) >= 11
    assert np.linalg.norm(pivots, axis=1) == pytest.approx(1)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.floats(0.01, 2))
def test_no_score_is_above_its_bound(seed, dim, spread):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dim)
    ring, queries = centre + spread * rng.normal(size=(20, dim)), rng.normal(size=(20, dim))
    ring[0] *= rng.integers(0, 2)
    pivot = (centre / np.linalg.norm(centre))[None]
    (norm, angle), (length, towards) = cells.angles(ring, pivot), cells.angles(queries, pivot)
    bound = cells.upper_bound(towards[:, 0], length, angle.min(), angle.max(), norm.min(), norm.max())
    assert np.all(queries @ ring.T <= bound[:, None])

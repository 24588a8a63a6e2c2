"""The block index against the search that scores everything; the kept vocabulary against a fit from scratch."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rankloom.operators import inverted, search, tfidf, upkeep
from rankloom.staging import list_folder, stage, staging_path


def vectors(spark, seed, n, first=0, terms=60):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        ids = sorted(set(np.minimum(rng.pareto(0.7, rng.choice([0, 1, 5, 12])), terms).astype(int).tolist()))
        w = rng.random(len(ids)) + 0.01
        rows.append((first + int(rng.integers(0, n)) if i % 4 == 0 else first + i, ids, (w / np.linalg.norm(w)).tolist() if ids else []))
    return spark.createDataFrame(rows, "doc_id long, term_ids array<int>, weights array<double>")


@pytest.mark.parametrize("k", [1, 5, 500])
def test_equals_full_search(spark, monkeypatch, k):
    monkeypatch.setattr(inverted, "SEGMENT_DOCS", 70)
    monkeypatch.setattr(inverted, "BLOCK_DOCS", 8)
    docs, queries = vectors(spark, 1, 300), vectors(spark, 2, 40, 1000)
    queries = queries.dropDuplicates(["doc_id"])
    index = inverted.load_index(spark, inverted.save_index(docs, staging_path(spark, "test-index")))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()))
    want = rows(search.top_k(queries, docs, k))
    assert rows(inverted.search_index(queries, index, k)) == want
    few = queries.orderBy("doc_id").limit(3)
    names = {q["doc_id"] for q in few.collect()}
    assert rows(inverted.search_index(few, index, k)) == [r for r in want if r[0] in names]


def test_skips_postings_below_the_bar():
    rng = np.random.default_rng(3)
    n = 4096
    lists = [[0] + ([1] if i % 1000 == 5 else []) for i in range(n)]
    flat = np.array([0.9 if t else 0.1 + 0.01 * rng.random() for ts in lists for t in ts])
    offsets = np.concatenate([[0], np.cumsum([len(ts) for ts in lists])]).astype(np.int32)
    columns = inverted.segment_columns(pa.array(np.arange(n)), pa.ListArray.from_arrays(
        pa.array(offsets), pa.array([t for ts in lists for t in ts], pa.int32())), flat)
    segment = inverted.Segment(pa.table({c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in columns.items()}))
    places, scores, scored = segment.search(np.array([0, 1]), np.array([0.5, 0.8]), 4)
    whole = np.array([sum(w * q for w, q in zip(flat[a:b], (0.5, 0.8))) for a, b in zip(offsets, offsets[1:])])
    assert places.tolist() == np.lexsort((np.arange(n), -np.round(whole, 9)))[:4].tolist()
    assert scored < 0.2 * len(flat)


def test_empty_sides(spark):
    docs = vectors(spark, 1, 20)
    index = stage(inverted.build_index(docs), "index")
    assert inverted.search_index(docs.where("false"), index, 3).count() == 0
    assert inverted.search_index(docs, stage(inverted.build_index(docs.where("false")), "index"), 3).count() == 0


@pytest.fixture
def tokens(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{min(int(rng.pareto(0.6)), 80)}"
    rows = [(i, [word() for _ in range(rng.choice([0, 3, 30]))], i % 4) for i in range(160)] + [(999, None, 0)]
    return stage(spark.createDataFrame(rows, "doc_id long, tokens array<string>, part int"), "tokens")


def test_upkeep_equals_fit_from_scratch(spark, tokens):
    settings = tfidf.base_settings(max_features=70, min_df=2, stop_words=None)
    path = staging_path(spark, "upkeep-test")
    part = lambda p, sign=1: upkeep.term_change(tokens.where(f"part = {p}"), settings, sign)
    rows = lambda df: df.orderBy("term").collect()
    fit = lambda *parts: rows(tfidf.fit_vocabulary(tokens.where(f"part IN {(*parts, -1)}"), settings))
    for name, p in (("01", 0), ("02", 1), ("03", 2)):
        upkeep.append_change(part(p), path, name)
    assert rows(upkeep.refit_vocabulary(spark, path, settings)) == fit(0, 1, 2)
    upkeep.append_change(part(1, -1), path, "04")
    upkeep.compact(spark, path)
    assert [n for n in list_folder(spark, path) if not n.startswith(".")] == ["base=04"]
    assert rows(upkeep.refit_vocabulary(spark, path, settings)) == fit(0, 2)
    # A change that is repeated, in a sum or not, counts once; what came and went leaves no trace.
    upkeep.append_change(part(1, -1), path, "04")
    for name, sign in (("05", 1), ("05", 1), ("06", -1)):
        upkeep.append_change(part(3, sign), path, name)
    assert rows(upkeep.refit_vocabulary(spark, path, settings)) == fit(0, 2)
    upkeep.append_change(part(3, -1), path, "07")
    with pytest.raises(ValueError, match="more often"):
        upkeep.refit_vocabulary(spark, path, settings)


def test_unfinished_sum_is_not_read(spark, tokens):
    settings = tfidf.base_settings(min_df=2, stop_words=None)
    path = staging_path(spark, "upkeep-test")
    upkeep.append_change(upkeep.term_change(tokens, settings), path, "01")
    tokens.sparkSession.createDataFrame([("w1", 5, 5)], upkeep.SCHEMA).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/base=01")
    assert upkeep.current_tables(spark, path) == [f"{path}/change=01"]


def test_few_queries_leave_the_index_in_place(spark, monkeypatch):
    monkeypatch.setattr(inverted, "SEGMENT_DOCS", 40)
    names = vectors(spark, 11, 150)
    index = stage(inverted.build_index(names), "index")
    asked = stage(vectors(spark, 12, 30).dropDuplicates(["doc_id"]), "vectors")
    monkeypatch.setattr(inverted, "fits_broadcast", lambda df: False)
    met = sorted(map(tuple, inverted.search_index(asked, index, 7).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(inverted, "meet_blocks", None)
    assert sorted(map(tuple, inverted.search_index(asked, index, 7).collect())) == met and len(met) == 7 * asked.count()


def test_row_groups_of_an_index_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(inverted, "SEGMENT_DOCS", 10)
    monkeypatch.setitem(inverted.FEW_ROWS, "parquet.block.size", "8192")
    path = inverted.save_index(vectors(spark, 13, 400).coalesce(1), f"{tmp_path}/index")
    groups = [file.metadata.row_group(i).num_rows for file in map(pq.ParquetFile, glob.glob(f"{path}/*.parquet"))
              for i in range(file.metadata.num_row_groups)]
    assert sum(groups) == 40 and max(groups) < 10

"""Kernels on large batches: what they hold at once is bounded, whatever a batch holds."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from rankloom.functions.vectors import pieces_together, sign_sums
from rankloom.operators import blocks, cells, grams, inverted, requests, search, wordmodel
from rankloom.sources import documents


def most_held(work) -> float:
    """MB that numpy and Python held at once."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_sign_sums_of_many_words_are_bounded():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, 300)) for _ in range(2000)]
    texts += ["", "  ", "one " * 100_000]
    found = []
    assert most_held(lambda: found.append(sign_sums(texts, 64))) < 60

    def plain(text):
        words = [w for w in text.split(" ") if w]
        bits = [np.unpackbits(np.frombuffer(hashlib.md5(w.encode()).digest(), np.uint8))[:64] for w in words]
        return (2.0 * np.array(bits) - 1.0).sum(axis=0) if words else np.zeros(64)

    for at in (0, 777, 1999, 2000, 2001):
        assert np.array_equal(found[0][at], plain(texts[at]))
    assert np.array_equal(found[0][2002], 100_000 * plain("one"))


def test_pieces_lose_nothing():
    texts = ["a b", "", "word " * 200_000, "x" * 600_000, "end"]
    again = [""] * len(texts)
    for rows, pieces in pieces_together(texts):
        for row, piece in zip(rows, pieces):
            again[row] += piece
    assert again == texts


def tokens_batch(rows: int, words: int) -> pa.RecordBatch:
    rng = np.random.default_rng(5)
    named = np.array([f"word{i}" for i in range(300)], dtype=object)
    lists = [named[rng.integers(0, 300, words)].tolist() for _ in range(rows)] + [[], None, ["word1"] * (words * 3)]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(lists))), "tokens": pa.array(lists, pa.list_(pa.string()))})


def test_slices_hold_every_row_once():
    batch = tokens_batch(40, 7)
    parts = list(grams.token_slices(iter([batch, batch.slice(5)]), most=20))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch, batch.slice(5)]))
    assert all(p.num_rows == 1 or len(p.column("tokens").flatten()) <= 20 for p in parts)


def test_grams_of_a_large_batch_are_bounded():
    batch = tokens_batch(3000, 400)
    terms = pa.array([f"word{i}" for i in range(300)], pa.large_string())
    assert most_held(lambda: [None for _ in grams.gram_totals(iter([batch]), 1, 2, None)]) < 40
    assert most_held(lambda: [None for _ in grams.gram_vectors(iter([batch]), 1, 2, True, terms, np.ones(300))]) < 40


def test_scores_of_a_large_batch_are_bounded():
    rng = np.random.default_rng(7)

    def vectors(n):
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n)), "embedding": pa.array(list(rng.normal(size=(n, 4)) * 0))})

    asked, batch = search.Block(pa.Table.from_batches([vectors(400)])), vectors(10_000)
    # All scores are equal, so that every cell is a candidate.
    assert most_held(lambda: [None for b in search.batch_blocks(iter([batch])) for _ in search.search_block(asked, b, 3)]) < 120


def test_a_block_travels_to_few_slots():
    assert [blocks.slots(n) for n in (0, 1, 3, 30, 64, 800)] == [1, 1, 3, 4, 8, 100]


def test_segments_are_rows_of_a_few_mb(spark):
    vectors = spark.range(0, 9000, 1, 1).select(
        F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (i * 37 + F.col("id") % 37).cast("int")).alias("term_ids"),
        F.array_repeat(F.lit(0.125).cast("double"), 60).alias("weights"))
    sizes = inverted.build_index(vectors).select(F.octet_length("data").alias("n")).collect()
    assert max(r.n for r in sizes) < 6 << 20


def test_cells_move_no_more_than_blocks(spark, tmp_path, monkeypatch):
    """Random vectors, of which nothing can be passed over: blocks meet, and answers are those of all pairs."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 16)))]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(2).localCheckpoint()
    index = cells.open_cells(spark, search.save_cells(vectors, str(tmp_path / "cells")))
    rounds, visit = [], cells._visits
    monkeypatch.setattr(cells, "_visits", lambda queries, index, at_home: rounds.append(at_home) or visit(queries, index, at_home))
    doc_id = vectors.schema["doc_id"].dataType
    expected = {tuple(r) for r in search.top_k(vectors, vectors, 5).select("query_id", "rank", "doc_id").collect()}
    for most, wanted in ((1, [True]), (1000, [True, False])):
        monkeypatch.setattr(cells, "slots", lambda n: most)
        rounds.clear()
        found = search.top_k_in_cells(vectors, index, doc_id, 5).select("query_id", "rank", "doc_id").collect()
        assert rounds == wanted and {tuple(r) for r in found} == expected


def test_files_are_listed_once_for_all_types(spark, tmp_path, monkeypatch):
    for name, text in (("a.txt", "one"), ("b.TXT", ""), ("c.pdf", "x")):
        (tmp_path / name).write_text(text)
    listed, plain = [], documents.empty_files
    monkeypatch.setattr(documents, "empty_files", lambda spark, path: listed.append(path) or plain(spark, path))
    loaded, errors = documents.bulk_load(spark, str(tmp_path))
    assert sorted(tuple(r) for r in loaded.collect()) == [("a.txt", "one"), ("b.TXT", "")] and errors.count() == 1
    assert listed == [str(tmp_path)]


def long_vectors(rows: int, length: int, **columns) -> pa.RecordBatch:
    lists = lambda values: pa.ListArray.from_arrays(np.arange(0, rows * length + 1, length, dtype=np.int32), pa.array(values))
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(rows)), **columns, "term_ids": lists(np.tile(np.arange(length, dtype=np.int32) * 3, rows)),
        "weights": lists(np.full(rows * length, 0.25))})


def test_requests_with_long_vectors_are_bounded():
    batch = long_vectors(2000, 1000)
    asked = requests._entries(batch.column("term_ids")[:1], batch.column("weights")[:1])
    parts = []

    def score():
        for part in requests.slices_to_score(iter([batch])):
            own = requests._entries(part.column("term_ids"), part.column("weights"))
            parts.append(requests.paired_scores(asked, own, np.zeros(part.num_rows, np.int64), part.num_rows))

    assert most_held(score) < 25
    assert np.array_equal(np.concatenate(parts), np.full(2000, 62.5))


def test_requests_joined_to_long_vectors_are_bounded():
    batch = long_vectors(2000, 10)
    asked = long_vectors(2000, 1000).column("term_ids")
    joined = pa.RecordBatch.from_arrays([*batch.columns, asked], names=[*batch.schema.names, "query_terms"])
    parts = list(requests.slices_to_score(iter([joined])))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([joined]))
    assert max(len(p.column("query_terms").flatten()) for p in parts) <= grams.SLICE_TOKENS


def test_search_of_long_vectors_is_bounded():
    batch = long_vectors(4000, 1000)
    asked = search.Block(pa.Table.from_batches([long_vectors(3, 1000)]))
    found = []
    assert most_held(lambda: found.extend(p for b in search.batch_blocks(iter([batch])) for p in search.search_block(asked, b, 2))) < 90
    table = pa.Table.from_batches(found)
    assert {s for s in table["score"].to_pylist()} == {62.5} and min(table["doc_id"].to_pylist()) == 0


def test_products_of_a_full_block_are_bounded():
    rng = np.random.default_rng(13)
    full, thin, total = rng.normal(size=(600, 700)), rng.normal(size=(700, 80)), np.zeros((601, 80))
    at, to = (x.ravel().astype(np.int32) for x in np.indices(full.shape))
    assert most_held(lambda: wordmodel.add_block(total, at, to, full.ravel(), thin)) < 30
    assert np.allclose(total, np.vstack([full @ thin, np.zeros(80)]), rtol=0, atol=1e-10)
    few, some = np.zeros((601, 80)), np.flatnonzero((at % 7 == 2) & (to % 5 < 3))
    wordmodel.add_block(few, at[some], to[some], full.ravel()[some], thin)
    wordmodel.add_block(few, at[:0], to[:0], full.ravel()[:0], thin)
    kept = np.where((np.arange(600) % 7 == 2)[:, None] & (np.arange(700) % 5 < 3), full, 0)
    assert np.allclose(few[:600], kept @ thin, rtol=0, atol=1e-10)

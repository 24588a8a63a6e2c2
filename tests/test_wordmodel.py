"""Learnt embeddings against dense algebra."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from rankloom.operators import wordmodel
from rankloom.operators.wordmodel import WordModelSettings
from rankloom.plans.matching import semantic_vectors

SETTINGS = WordModelSettings(max_words=120, window=3, dim=12, oversample=60, rounds=12, block=32)


@pytest.fixture(scope="module")
def texts():
    """Words of one topic stand together."""
    rng = random.Random(4)
    return [[f"t{topic}x{min(int(rng.paretovariate(0.8)), 30)}" if rng.random() < 0.8 else f"c{rng.randint(0, 9)}"
             for _ in range(rng.choice([0, 1, 30, 80]))] for topic in range(6) for _ in range(40)]


@pytest.fixture(scope="module")
def tokens(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, tokens array<string>")


@pytest.fixture(scope="module")
def model(tokens):
    return wordmodel.fit_word_model(tokens, SETTINGS)


def dense(texts, settings):
    tf, df = Counter(w for t in texts for w in t), Counter(w for t in texts for w in set(t))
    kept = sorted(sorted((w for w in tf if df[w] >= settings.min_df), key=lambda w: (-tf[w], w))[:settings.max_words])
    number = {w: i for i, w in enumerate(kept)}
    counts = np.zeros((len(kept), len(kept)))
    for t in texts:
        for i, w in enumerate(t):
            for v in t[max(0, i - settings.window):i] + t[i + 1:i + 1 + settings.window]:
                if w in number and v in number:
                    counts[number[w], number[v]] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.log(counts * counts.sum() / np.outer(counts.sum(axis=1), counts.sum(axis=0)))
    return kept, counts, np.where(counts > 0, np.maximum(value, 0), 0)


def test_counts_equal_brute_force(tokens, texts):
    kept, counts, matrix = dense(texts, SETTINGS)
    words = wordmodel.word_table(tokens, SETTINGS)
    assert [r["word"] for r in words.orderBy("word_id").collect()] == kept
    found = np.zeros_like(counts), np.zeros_like(matrix)
    for r in wordmodel.positive_information(wordmodel.cooccurrences(tokens, words, SETTINGS.window)).collect():
        found[0][r["a"], r["b"]], found[1][r["a"], r["b"]] = r["n"], r["value"]
    assert (found[0] == counts).all() and np.allclose(found[1], matrix, atol=1e-12)


def test_singular_values_and_vectors_equal_dense(model, texts):
    _, _, matrix = dense(texts, SETTINGS)
    values, axes = np.linalg.eigh(matrix)
    order = np.argsort(-np.abs(values))[:SETTINGS.dim]
    assert np.allclose(model.singular_values, np.abs(values[order]), rtol=1e-6)
    got = np.array([r["vector"] for r in model.vectors.orderBy("word_id").collect()])
    want = (axes[:, order] * np.abs(values[order])) @ axes[:, order].T
    assert np.abs(got @ got.T - want).max() < 1e-4 * np.abs(want).max()


def test_vectors_repeat(model, tokens):
    again = wordmodel.fit_word_model(tokens.repartition(3, "doc_id"), SETTINGS)
    rows = lambda m: np.array([r["vector"] for r in m.vectors.orderBy("word_id").collect()])
    assert np.allclose(rows(model), rows(again), atol=1e-9)


def test_topics_lie_together(spark, model, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(998, None), (999, "unknown")],
                                 "doc_id long, text string")
    rows = semantic_vectors(docs, "doc_id", "text", wordmodel.word_encoder(model)).collect()
    by_id = {r["doc_id"]: np.array(r["embedding"]) for r in rows}
    assert not by_id[998].any() and not by_id[999].any()
    full = [i for i, t in enumerate(texts) if len(t) >= 30]
    scores = np.array([[by_id[i] @ by_id[j] for j in full] for i in full])
    np.fill_diagonal(scores, -2)
    best = [full[j] // 40 for j in scores.argmax(axis=1)]
    assert np.mean([b == i // 40 for b, i in zip(best, full)]) > 0.95


def test_small_rank_and_empty(spark):
    tiny = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"])], "doc_id long, tokens array<string>")
    found = wordmodel.fit_word_model(tiny, WordModelSettings(dim=8))
    assert len(found.singular_values) <= 2 and found.vectors.count() == 2
    with pytest.raises(ValueError, match="close"):
        wordmodel.fit_word_model(tiny.where("false"), WordModelSettings())

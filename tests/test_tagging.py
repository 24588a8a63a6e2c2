"""Tagger against enumeration, and heavy words against plain counts."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import heavy, lemmas, tagging


def random_model(seed: int, n_words: int, k: int = 4):
    draw = np.random.default_rng(seed)
    return (draw.dirichlet(np.ones(k)), draw.dirichlet(np.ones(k), k), draw.dirichlet(np.ones(n_words), k).T)


def flat(sequences, steps):
    return np.concatenate([np.array(s, np.int64) for s in sequences])[steps.place]


@pytest.mark.parametrize("seed", range(5))
def test_sums_and_best_tags_equal_enumeration(seed):
    draw = np.random.default_rng(seed + 50)
    start, transition, emission = random_model(seed, 6)
    sequences = [draw.integers(0, 6, n).tolist() for n in (4, 1, 0, 5, 2, 4)]
    steps = tagging.Steps(np.array([len(s) for s in sequences]))
    code = flat(sequences, steps)
    chance, starts, moves, log = tagging.expected_counts(emission[code], steps, start, transition)
    tags = tagging.best_tags(emission[code], steps, start, transition)

    want_chance, want_starts, want_moves, want_log = [], np.zeros(4), np.zeros((4, 4)), 0.0
    want_tags = []
    for s in sequences:
        ways = {}
        for path in itertools.product(range(4), repeat=len(s)):
            p = 1.0
            for i, (tag, word) in enumerate(zip(path, s)):
                p *= (start[tag] if i == 0 else transition[path[i - 1], tag]) * emission[word, tag]
            ways[path] = p
        total = sum(ways.values())
        each = np.zeros((len(s), 4))
        for path, p in ways.items():
            for i, tag in enumerate(path):
                each[i, tag] += p / total
                if i:
                    want_moves[path[i - 1], tag] += p / total
        want_chance.extend(each)
        want_tags.extend(max(ways, key=ways.get))
        if len(s):
            want_starts += each[0]
            want_log += np.log(total)
    order = np.argsort(steps.place)
    assert np.allclose(chance[order], want_chance)
    assert np.allclose(starts, want_starts) and np.allclose(moves, want_moves) and np.isclose(log, want_log)
    assert tags[order].tolist() == want_tags


def test_no_sequences():
    steps = tagging.Steps(np.zeros(0, np.int64))
    assert len(steps) == 0 and len(tagging.best_tags(np.zeros((0, 4)), steps, *random_model(1, 3)[:2])) == 0


@pytest.fixture(scope="module")
def taught(spark):
    """Nouns follow adjectives, verbs follow nouns; 'watch' is listed as both."""
    rows = [(i, ["red", "cat", "runs", "fast"] if i % 3 else ["old", "watch", "stops"]) for i in range(60)]
    rows += [(100 + i, ["red", "dog", "watch", "old", "cat"]) for i in range(30)]
    texts = spark.createDataFrame([*rows, (200, None), (201, [])], "doc_id long, words array<string>").repartition(3)
    noun, verb, adj, adv = 1, 2, 4, 8
    listed = [("red", adj), ("old", adj), ("cat", noun), ("dog", noun), ("runs", verb), ("stops", verb), ("fast", adv),
              ("watch", noun | verb)]
    return texts, spark.createDataFrame(listed, "word string, tags int")


def test_context_decides_and_likelihood_never_falls(taught):
    texts, dictionary = taught
    model = tagging.fit_tagger(texts, dictionary, rounds=8, smoothing=0.0)
    assert all(b >= a - 1e-9 for a, b in zip(model.likelihoods, model.likelihoods[1:])) and len(model.likelihoods) == 8
    model = tagging.fit_tagger(texts, dictionary, rounds=8)
    got = {r["doc_id"]: r["tags"] for r in tagging.tag_words(texts, "words", model).collect()}
    assert got[0] == ["JJ", "NN", "VB"] and got[1] == ["JJ", "NN", "VB", "RB"]
    assert got[100] == ["JJ", "NN", "VB", "JJ", "NN"]
    assert got[200] == [] and got[201] == []


def test_slices_of_a_batch_and_few_model_words_change_no_length(taught, monkeypatch):
    texts, dictionary = taught
    monkeypatch.setattr(tagging, "SLICE_WORDS", 3)
    assert list(tagging._slices(np.array([1, 5, 1, 1, 1, 2]))) == [(0, 1), (1, 2), (2, 5), (5, 6)]
    model = tagging.fit_tagger(texts, dictionary, rounds=2, max_words=2)
    assert len(model.words) == 2 and model.emission.shape == (3, 4)
    tagged = tagging.tag_words(texts, "words", model)
    assert tagged.where("size(coalesce(words, array())) <> size(tags)").count() == 0
    with pytest.raises(ValueError):
        tagging.fit_tagger(texts.limit(0), dictionary)


def test_lemma_depends_on_the_tag(spark, taught):
    texts, dictionary = taught
    model = tagging.fit_tagger(texts, dictionary, rounds=8)
    lexicon = spark.createDataFrame([("watch", "noun", "clock"), ("watch", "verb", "look")], "word string, pos string, lemma string")
    df = spark.createDataFrame([(1, "old watch stops"), (2, "red dog watch old cat"), (3, None)], "doc_id long, text string")
    got = dict(map(tuple, tagging.tag_and_lemmatize(df, "doc_id", "text", lexicon, model).collect()))
    assert got == {1: "old clock stops", 2: "red dog look old cat", 3: ""}
    assert dict(map(tuple, tagging.tag_dictionary(lexicon).collect())) == {"watch": 3, "clock": 1, "look": 2}


def test_long_and_short_texts_share_few_steps():
    lengths = np.array([3, 900, 0, 2, 700] * 400)
    slices = list(tagging._like_lengths(lengths))
    assert sorted(np.concatenate([s.place for s in slices]).tolist()) == list(range(lengths.sum()))
    assert sum(map(len, slices)) <= 900


def test_lemmas_by_tag_equal_those_of_the_join(spark):
    lexicon = spark.createDataFrame([("runs", "noun", "run1"), ("runs", "verb", "run2"), ("red", "adj", "reddish"),
                                     ("a", "adv", "b/noun"), ("runs", "noun", "run1")], "word string, pos string, lemma string")
    df = spark.createDataFrame([(1, ["runs", "runs", "red", "a", "x"], ["VBZ", "NN", "JJ", "RB", "RB"]), (2, ["runs", "red"], ["V"]),
                                (3, ["runs"], None), (4, [], ["V", "J"]), (5, None, None), (5, ["a", "runs"], ["R", None, "V"])],
                               "id long, words array<string>, tags array<string>")
    want = [(1, ["run2", "run1", "reddish", "b/noun", "x"]), (2, ["run2", "red"]), (3, ["run1"]), (4, []), (5, []), (5, ["b/noun", "run1"])]
    for limit in (None, 0):
        got = lemmas.lemma_words(df, F.col("words"), lexicon, F.col("tags"), limit).select("id", "_words").collect()
        assert sorted((r[0], r[1]) for r in got) == sorted(want)
    untagged = lemmas.lemma_words(df, F.col("words"), lexicon).where("id = 1").first()
    assert untagged["_words"] == ["run1", "run1", "red", "a", "x"] and "_tags" not in untagged


def plain_counts(texts, n):
    counts = Counter(w for t in texts if t for w in t.split())
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.mark.parametrize("capacity", [2, 5, 40, 4096])
def test_heavy_words_equal_plain_counts(spark, capacity):
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{min(int(x), 400)}" for x in draw.zipf(1.3, 60)) for _ in range(300)] + [None, "", "tie a tie a"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    for n in (1, 10, 1000):
        got = [tuple(r) for r in heavy.heavy_words(df, "text", n, capacity).collect()]
        assert got == plain_counts(texts, n)
    assert heavy.heavy_words(df.limit(0), "text", 3, capacity).collect() == []


def test_summary_bounds():
    draw, summary, loss, exact = np.random.default_rng(4), {}, 0, Counter()
    for _ in range(50):
        batch = Counter(f"w{x}" for x in draw.zipf(1.5, 100))
        exact += batch
        loss += heavy.add_counts(summary, list(batch), list(batch.values()), 10)
        assert len(summary) <= 10
    assert all(exact[w] - loss <= c <= exact[w] for w, c in summary.items())
    assert all(c <= loss for w, c in exact.items() if w not in summary)

"""The exact self-join against all pairs, on copies, near copies, hot terms and odd rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankloom.operators import selfjoin


def brute_vectors(texts):
    counts = [Counter(t) for t in texts]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    vectors = []
    for c in counts:
        raw = {w: n * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append({w: x / norm for w, x in raw.items()})
    return vectors


def brute_links(texts, threshold):
    vectors = brute_vectors(texts)
    cosine = lambda a, b: round(sum(x * b.get(w, 0.0) for w, x in a.items()), 9)
    return [sum(i != j and cosine(a, b) >= threshold for j, b in enumerate(vectors)) for i, a in enumerate(vectors)]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 400)}"
    texts = [[word() for _ in range(rng.choice([0, 1, 3, 20, 60]))] for _ in range(90)]
    for k in range(6):
        base = [word() for _ in range(40)]
        texts += [[w if rng.random() > k * 0.04 else word() for w in base] for _ in range(15)]
    return texts + [texts[5]] * 40 + [["hot"] * n + ["rare%d" % n] for n in range(1, 30)]


@pytest.mark.parametrize("threshold, members", [(0.8, 512), (0.8, 7), (0.5, 16), (1.0, 9)])
def test_equals_all_pairs(spark, monkeypatch, threshold, members):
    monkeypatch.setattr(selfjoin, "PART_MEMBERS", members)
    monkeypatch.setattr(selfjoin, "CELLS", 1 << 12)
    texts = corpus(members)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, tokens array<string>")
    found = {r["doc_id"]: r for r in selfjoin.similarity_join(docs.selectExpr("*", "1 AS node", "2 AS term"), threshold).collect()}
    assert [found[i]["n_links"] for i in range(len(texts))] == brute_links(texts, threshold)
    first = {}
    for i, t in enumerate(texts):
        same = first.setdefault(tuple(sorted(t)), i) if t else i
        assert found[i]["class_id"] == same


def test_pairs_once_each(spark):
    texts = corpus(1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, tokens array<string>")
    vectors = selfjoin.distinct_vectors(docs)
    least = {r["node"]: r["least"] for r in vectors.vectors.collect()}
    found = [(least[r["node_a"]], least[r["node_b"]], r["score"]) for r in selfjoin.similar_pairs(vectors).collect()]
    exact = brute_vectors(texts)
    want = {}
    nodes = sorted(least.values())
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            score = round(sum(x * exact[b].get(w, 0.0) for w, x in exact[a].items()), 9)
            if score >= 0.8:
                want[a, b] = score
    assert len(found) == len(want)
    assert {tuple(sorted(p[:2])): pytest.approx(p[2], abs=2e-9) for p in found} == want


def test_parts_of_a_frequent_term_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(selfjoin, "PART_MEMBERS", 20)
    docs = spark.createDataFrame([(i, ["thanks", f"n{i}"]) for i in range(300)], "doc_id long, tokens array<string>")
    vectors = selfjoin.distinct_vectors(docs).vectors
    sizes = [r["count"] for r in selfjoin.meetings(vectors, 0.1).groupBy(*selfjoin.MEETING).count().collect()]
    assert len(sizes) > 100 and max(sizes) <= 80


def test_odd_rows(spark):
    schema = "doc_id long, tokens array<string>"
    rows = [(None, ["a", "b"]), (1, None), (2, []), (3, ["a", "b"]), (3, ["b", "a"]), (None, ["z"]), (None, ["z"])]
    docs = spark.createDataFrame(rows, schema)
    found = Counter(map(tuple, selfjoin.similarity_join(docs).collect()))
    assert found == Counter({(None, 3, 2): 1, (1, 1, 0): 1, (2, 2, 0): 1, (3, 3, 2): 2, (None, None, 1): 2})
    assert selfjoin.similarity_join(spark.createDataFrame([], schema)).count() == 0


def test_a_vector_travels_once_for_each_part(spark, monkeypatch):
    monkeypatch.setattr(selfjoin, "BLOCK_MEMBERS", 16)
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, [f"w{rng.randrange(300)}" for _ in range(80)]) for i in range(200)],
                                 "doc_id long, tokens array<string>")
    met = selfjoin.meetings(selfjoin.distinct_vectors(docs).vectors, 0.8).selectExpr("*", "length(nodes) / 8 AS vectors").collect()
    parts = {r["one"] for r in met}
    assert 1 < len(parts) <= selfjoin.PARTS + 1 and sum(r["vectors"] for r in met) == 200 * len(parts)
    assert max(r["vectors"] for r in met) <= 16


def test_packed_arrays_come_back():
    for name, kind in selfjoin.BLOCK.items():
        values = np.array([5, 3, 70_000, 3, 0], kind)
        assert np.array_equal(selfjoin.unpack(name, pa.py_buffer(selfjoin.pack(name, values))), values)


def test_folded_vectors_bound_cosines(spark, monkeypatch):
    monkeypatch.setattr(selfjoin, "FREQUENT", 5)
    texts = corpus(2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, tokens array<string>")
    found = selfjoin.distinct_vectors(docs)
    rows = found.vectors.where("size(terms) > 0").select("node", "n", "norm", "terms", "tfs", "idfs").toArrow()
    packed = selfjoin._block(rows, 0)
    block = selfjoin.Block({name: selfjoin.unpack(name, packed.column(name)[0].as_buffer()) for name in selfjoin.BLOCK}, found.frequent)
    assert len(found.frequent) == 5 and block.first.shape[1] * 4 == selfjoin.WIDTH
    i, j = (x.ravel() for x in np.indices((block.n, block.n)))
    exact = selfjoin.cosines(block, block, np.arange(len(block.words)), i, j)
    wide, narrow = ((x @ x.T).ravel() for x in (block.folded, block.first))
    assert (wide >= exact - 1e-5).all() and (narrow >= wide - 1e-5).all()
    # Most of the pairs below the threshold are ruled out by a bound, without their cosines.
    assert (narrow >= 0.8).sum() < 2 * (exact >= 0.8).sum()


def test_terms_too_many_to_go_to_all_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(3))], "doc_id long, tokens array<string>")
    def vectors():
        rows = selfjoin.distinct_vectors(docs).vectors.collect()
        return {r["least"]: (r["n"], list(r["tfs"]), [round(x, 12) for x in r["idfs"]], round(r["norm"], 9)) for r in rows}
    here = vectors()
    monkeypatch.setattr(selfjoin, "fits_broadcast", lambda df: False)
    assert vectors() == here

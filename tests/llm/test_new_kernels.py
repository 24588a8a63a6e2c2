"""Lexical search, periodic runs and byte-pair merges: kernels against brute force, odd rows, empty tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from rankloom.llm import lexical, merge_tree, periodic_runs
from rankloom.llm.queries import byte_tokenizer
from tests.llm.test_queries import brute_runs


def brute_rank(docs, items, k):
    """(item, rank, doc, score) by the definition, over all documents."""
    term_list = lambda text: [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(
        r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    held = [(i, Counter(term_list(t)), len(term_list(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    rows = []
    for item, text in items:
        scored = []
        for doc, counts, n in held:
            score = 0
            for t in term_list(text):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10 ** 9 * counts[t]) // (1000 * counts[t] + 12 * (75 + (25 * n * n_docs) // length)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(rows)


def texts_of(rng, n, words):
    """Texts with very frequent and rare words, some of them very long."""
    return [" ".join(f"w{min(int(rng.paretovariate(0.6)), words)}" for _ in range(rng.choice([0, 1, 4, 30, 30, 400])))
            for _ in range(n)]


@pytest.mark.parametrize("short", [0, 40, 1 << 10])
def test_search_equals_brute_force(spark, monkeypatch, short):
    for name, value in (("SHORT_POSTINGS", short), ("WINDOW", 16), ("SEGMENT_DOCS", 50), ("BLOCK_TERMS", 20)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(short)
    docs = [(rng.randint(0, 150) if i % 9 else None, t) for i, t in enumerate(texts_of(rng, 200, 300))]
    docs += [(500, "É x"), (501, "é X"), (502, None), (503, " \n-"), (500, "É x")] + [(600 + i, "same words w3") for i in range(60)]
    items = [(i, t) for i, t in enumerate(texts_of(rng, 12, 300))] + [(3, "same"), (3, "É x É"), (None, "same words w3"), (77, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS item", "2 AS rank")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS block")
    found = lexical.rank_documents(df, asked, top_k=7)
    assert Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == brute_rank(docs, items, 7)


def test_search_without_wanted_terms_and_with_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical, "INDEXED_BYTES", 0)
    docs = [(i, t) for i, t in enumerate(texts_of(random.Random(5), 60, 50))]
    items = [(1, "w1 w2 w7"), (2, "w9")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lexical.rank_documents(df, asked)
    assert Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == brute_rank(docs, items, 20)
    assert lexical.rank_documents(df.where("false"), asked).count() == 0
    assert lexical.rank_documents(df, asked.where("false")).count() == 0


def test_walk_skips_long_lists():
    """A rare term decides: the long list of a common one is looked up, not walked."""
    n = 100_000
    common, rare = np.arange(n), np.arange(0, n, 4000)
    lists = lexical.Lists([common, rare], [np.full(n, 5), np.full(len(rare), 1000)], [5, 1000])
    best = lexical.Best(20, 1)
    seen = lexical.walk(lists, n, best)
    assert best.scores.tolist() == [1005] * 20 and best.places.tolist() == rare[:20].tolist()
    assert seen <= 3 * len(rare)


def test_walk_stops_when_no_list_reaches_the_bar():
    lists = lexical.Lists([np.arange(5000)], [np.full(5000, 3)], [3])
    assert lexical.walk(lists, 5000, lexical.Best(5, 4)) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4))
def test_runs_equal_brute_force(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    runs = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int64), sizes)
    base = np.cumsum(sizes) - sizes
    want = sorted((s + b, s + b + n, q) for t, b in zip(texts, base.tolist()) for s, n, q in brute_runs(t))
    assert sorted(zip(runs.start.tolist(), runs.end.tolist(), runs.period.tolist())) == want


def test_runs_of_long_periodic_texts(monkeypatch):
    for name, value in (("GRID", 1000), ("EXTENDED", 100), ("LARGE", 50)):
        monkeypatch.setattr(periodic_runs, name, value)
    rng = np.random.default_rng(3)
    texts = [np.tile(rng.integers(0, 9, 37), 40), np.zeros(900, np.int64), np.tile([1, 1, 1, 1, 1, 1, 2], 60),
             np.concatenate([rng.integers(0, 400, 300), np.tile(rng.integers(0, 400, 60), 5)])]
    sizes = np.array([len(t) for t in texts])
    runs = periodic_runs.find_runs(np.concatenate(texts), sizes)
    base = np.cumsum(sizes) - sizes
    want = sorted((s + b, s + b + n, q) for t, b in zip(texts, base.tolist()) for s, n, q in brute_runs(t.tolist()))
    assert sorted(zip(runs.start.tolist(), runs.end.tolist(), runs.period.tolist())) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=2, max_size=200))
def test_extensions_equal_comparison(symbols):
    text = np.array([0, *symbols, 0])
    extensions = periodic_runs.Extensions(text)
    a, b = np.triu_indices(len(symbols), 1)
    want = []
    for i, j in zip(a + 1, b + 1):
        n = 0
        while j + n < len(text) - 1 and text[i + n] == text[j + n]:
            n += 1
        want.append(n)
    assert extensions.common(a + 1, b + 1).tolist() == want


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 12), (4, "x y " * 4), (4, "x y " * 4), (5, "b" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS n_words", "3 AS collapsed")
    found = periodic_runs.periodic_runs(docs).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and all(by_id[i]["runs"] == [] and by_id[i]["collapsed"] == "" for i in (1, 2, 3))
    assert [tuple(r) for r in by_id[None]["runs"]] == [(0, 12, 1)] and by_id[None]["collapsed"] == "a"
    assert [tuple(r) for r in by_id[4]["runs"]] == [(0, 8, 2)] and by_id[4]["collapsed"] == "x y"
    assert by_id[5]["runs"] == [] and by_id[5]["n_words"] == 1
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    path, pattern = byte_tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merge_tree.read_ranks(path), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_ids_equal_library(encoding, texts):
    encoder = merge_tree.merge_encoder(byte_tokenizer()[0])
    ids, counts = encoder.encode(pa.array(texts, pa.large_string()))
    parts = np.split(ids, np.cumsum(counts)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == [encoding.encode_ordinary(t) for t in texts]
    decoded, sizes = encoder.decode(ids.astype(np.int64), counts)
    assert b"".join(t.encode() for t in texts) == decoded.tobytes() and sizes.tolist() == [len(t.encode()) for t in texts]


def test_merges_equal_pair_by_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 301, b"aa": 302, b"aaaa": 303}
    rng = random.Random(2)
    for _ in range(500):
        piece = bytes(rng.choice(b"aabc") for _ in range(rng.randint(1, 30)))
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while piece not in ranks:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert merge_tree.merge_piece(piece, ranks) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])


def test_bpe_of_odd_rows(spark, encoding):
    path, _ = byte_tokenizer()
    rows = [(None, "a b"), (1, None), (2, ""), (3, "<|endoftext|> x"), (3, "<|endoftext|> x"), (4, "z" * 100_000 + " é ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS _text", "3 AS decoded")
    found = merge_tree.decode_ids(merge_tree.encode_texts(docs, path), path).collect()
    assert len(found) == len(rows)
    for row, (name, text) in zip(sorted(found, key=lambda r: (r[0] or 0, r[1])), sorted(rows, key=lambda r: (r[0] or 0, r[1] or ""))):
        assert row["decoded"] == (text or "").encode()
        assert np.frombuffer(row["ids"], "<u4").tolist() == encoding.encode_ordinary(text or "")
    assert merge_tree.encode_texts(docs.where("false"), path).count() == 0


@pytest.mark.parametrize("sizes", [[120_000] + [1 + 2 * i for i in range(59)], [1, 1, 1], [64, 65, 128, 200, 3], [0, 5]])
def test_mix_of_small_sources_comes_near_every_target(spark, sizes):
    from rankloom.llm import mixing

    rows = []
    for s, n in enumerate(sizes):
        for start in range(0, max(n, 1), 97):
            rows.append((len(rows) if len(rows) % 5 else None, " ".join(f"w{start + i}" for i in range(min(97, n - start))), f"s{s:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [mixing.mix(docs, keep=["source", "text"], shard_words=1000).toPandas() for _ in range(2)]
    order = lambda df: sorted(zip(df.kept.map(lambda k: (k["source"], k["text"])), df.taken))
    assert order(runs[0]) == order(runs[1])
    mixed = runs[0].assign(source=runs[0].kept.map(lambda k: k["source"]))
    assert (mixed.taken <= 2 * mixed["size"]).all() and (mixed.runs.map(lambda rs: sum(r["words"] for r in rs)) == mixed["size"]).all()
    sums = mixed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums.taken - sums.target).abs() <= 1).all(), sums


def test_parts_of_short_texts_are_bounded(spark, monkeypatch):
    from rankloom.llm import near_text

    seen = []
    monkeypatch.setattr(near_text, "PART_MEMBERS", 20)
    meet = near_text.meet_in_parts
    monkeypatch.setattr(near_text, "meet_in_parts", lambda *given: seen.append(meet(*given)) or seen[-1])
    docs = spark.createDataFrame([(i, f"thank you for your order N{i}") for i in range(1200)], "doc_id long, text string")
    classes = near_text.near_classes(docs).toPandas()
    assert (classes.doc_id == classes.class_id).all()
    sizes = [r["count"] for met in seen for r in met.groupBy(*near_text.MEETING).count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 80


def test_short_texts_are_one_shingle():
    from rankloom.llm import near_text

    owner, _, counts = near_text.shingle_counts(pa.array(["a b", "b a", "", "a b", "a b c d e f", None], pa.large_string()))
    assert owner.tolist() == [0, 1, 3, 4, 4] and counts.tolist() == [1] * 5
    hashes = [h for _, h in sorted(zip(owner, near_text.shingle_counts(
        pa.array(["a b", "b a", "", "a b", "a b c d e f", None], pa.large_string()))[1]))]
    assert hashes[0] == hashes[2] != hashes[1]


@pytest.mark.parametrize("text", ["x" * 177_000, "word, it's 12  \n\n é " * 9000, " " * 70_000 + "a", "ab " * 30_000 + "\n" * 40_000 + "x"])
def test_long_turns_have_the_ids_of_whole_texts(encoding, text):
    from rankloom.llm.chat_tree import ByteTokens

    assert ByteTokens(*byte_tokenizer()).encode(text) == encoding.encode_ordinary(text)


def test_hosts_of_many_labels(spark):
    from rankloom.llm import url_rules

    urls = ["http://" + "a." * 100_000 + "example.net/en/x", "http://x.net", "http://net/", "http://.net/y", "http://a..net/"]
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: r["rule"] for r in url_rules.judge_urls(pages, "url", rules).collect()}
    assert found == {0: "example.net/en/", 1: None, 2: "net/", 3: "net/", 4: "net/"}
    assert url_rules.judge_urls(pages, "url", rules.where("false")).where("rule IS NULL AND verdict = 'allow'").count() == 5


def test_letters_alone_have_the_ids_of_the_tokenizer():
    from rankloom.llm.queries import WORD_BPE, tokenizer_path
    from rankloom.llm.tokens import LETTERS, WordEncoder

    encoder, rng = WordEncoder(tokenizer_path(WORD_BPE)), random.Random(8)
    assert encoder.letters_alone
    letters = [chr(c) for c in range(0x41, 0x100) if LETTERS.fullmatch(chr(c))]
    pieces = letters + ["".join(rng.choice(letters) for _ in range(rng.randint(2, 14))) for _ in range(4000)]
    assert [encoder.letter_ids(p) for p in pieces] == [
        e.ids for e in encoder.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def test_step_groups_are_full_but_for_the_last():
    from rankloom.llm import packing

    rng = np.random.default_rng(6)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()),
                        ("step_group", pa.int64())])
    sizes = rng.integers(0, 900, 3000)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(["x"] * 3000)], names=["doc_id", "_text"])

    def encode(texts):
        encode.at += len(texts)
        own = sizes[encode.at - len(texts):encode.at]
        return np.ones(int(own.sum()), np.uint32), own

    encode.at = 0
    out = pa.Table.from_batches(packing.pack_stream(iter([batch.slice(i, 100) for i in range(0, 3000, 100)]), encode,
                                                    [2048, 1024, 512, 256], 1 << 16, 1 << 13, 0, schema)).to_pandas()
    assert out.length.sum() == (sizes + 1).sum()
    sequences = out.groupby("sequence_id").agg(window=("window", "first"), group=("step_group", "first"), n=("length", "sum"))
    assert (sequences.n == sequences.window).all()
    groups = sequences.groupby("group").agg(window=("window", "first"), kinds=("window", "nunique"), n=("n", "sum"))
    assert (groups.kinds == 1).all() and (groups.n <= 1 << 13).all()
    assert (groups[groups.n < 1 << 13].groupby("window").size() <= 1).all()

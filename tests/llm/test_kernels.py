"""Operators on small inputs with known results, and their defined cases."""

from __future__ import annotations

import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F
from rankloom.llm import (cascade, chat_tree, mixing, near_text, near_vectors, packing, quality_model, queries, streams,
                          token_edits, tokens, url_rules, warc)
from rankloom.llm.components import connected_components

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (7, "x " * 120_000),
       (8, "ärger\u00a0und\u2003mehr " * 30), (9, "a" * 300_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, with columns whose names the operators use themselves."""
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return rows.select("*", *[F.lit("own").alias(c) for c in (
        "id", "size", "n_words", "score", "stats", "rule", "kept", "n_tokens", "digest", "bands", "label")],
        F.lit("s").alias("source"))


def nothing(df):
    return df.where("false")


# --- quality model

def test_statistics_of_empty_texts_are_finite():
    stats = quality_model.document_stats(pa.array(["", None, "a", "!" * 50, "é" * 9, "A\nA\nA"]))
    assert stats.shape == (6, quality_model.N_STATS) and np.isfinite(stats).all() and (stats[0] == stats[1]).all()


def test_isotonic_pools_violators():
    knots, values = quality_model.isotonic(np.array([0., 1, 2, 3]), np.array([0., 1, 0, 1]), np.array([1., 1, 1, 2]))
    assert knots.tolist() == [0, 1.5, 3] and values.tolist() == [0, 0.5, 1]


def test_normal_equations_equal_least_squares(spark):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(size=quality_model.N_STATS).tolist(), float(i % 2)) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, stats array<double>, label double").repartition(7)
    plain = quality_model.QualityModel(np.zeros(20), np.ones(20), np.zeros((20, 4)), np.zeros(4), *[np.zeros(0)] * 3)
    sums = quality_model.sum_equations(table, plain, 0)
    both = np.hstack([plain.features(np.array([r[1] for r in rows])), np.array([[r[2]] for r in rows])])
    assert np.allclose(sums, both.T @ both)


def test_classifier_without_labels_or_rows(spark, odd):
    labels = spark.createDataFrame([(4, None), (7, 5)], "doc_id bigint, quality int")
    model = quality_model.learn(quality_model.with_stats(odd), labels)
    scored = quality_model.score_documents(odd, model).collect()
    assert len(scored) == len(ODD) and {r["score"] for r in scored} == {0.5}
    assert quality_model.score_documents(nothing(odd), model).count() == 0


def test_one_class_of_labels_gives_scores(spark, odd):
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 7, 8, 9)], "doc_id bigint, quality int")
    model = quality_model.learn(quality_model.with_stats(odd), labels)
    assert all(0 <= r["score"] <= 1 for r in quality_model.score_documents(odd, model).collect())


# --- token counts

pieces_text = st.text(alphabet=st.sampled_from(list("ab'sdmtlvre  \n\té1½!?’\u3000中.x🙂")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(pieces_text, st.text(max_size=20)), min_size=1, max_size=4))
def test_cut_equals_pattern(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    import public_tokenizers
    import regex

    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    start = np.zeros(len(points) + 1, bool)
    lengths = np.array([len(t) for t in texts])
    start[np.cumsum(lengths) - lengths] = True
    want, at = [], 0
    for text in texts:
        want += [at + m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]
        at += len(text)
    assert np.flatnonzero(token_edits.piece_starts(points, start[:-1]) | start[:-1]).tolist() == want


@pytest.fixture(scope="module")
def counter():
    return token_edits.PieceCounter(*queries.byte_tokenizer())


@settings(max_examples=100, deadline=None)
@given(pieces_text, st.integers(1, 9), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 40), pieces_text), max_size=5))
def test_edits_equal_whole_encoding(counter, text, times, edits):
    text = text * times
    _, chars, counts = token_edits.segments(pa.array([text], pa.large_string()), counter)
    state = token_edits.EditableCount(text, chars.tolist(), counts.tolist(), counter)
    for start, size, new in edits:
        state.edit(start, start + size, new)
        start = min(start, len(text))
        text = text[:start] + new + text[start + size:]
        assert state.text == text and state.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_an_edit_encodes_its_surroundings_only(counter):
    text = "some words of a long text, again and again. " * 5000
    _, chars, counts = token_edits.segments(pa.array([text], pa.large_string()), counter)
    state = token_edits.EditableCount(text, chars.tolist(), counts.tolist(), counter)
    state.edit(100_000, 100_010, "other")
    assert state.encoded < 200 and state.n_tokens == len(counter.encoding.encode_ordinary(state.text))


def test_token_counts_of_odd_tables(spark, odd, counter):
    trees = token_edits.build_trees(odd.withColumn("edits", F.when(F.col("doc_id") == 4, F.array(F.struct(
        F.lit(0).alias("start"), F.lit(1).alias("stop"), F.lit("T").alias("replacement"))))), *queries.byte_tokenizer())
    edited = token_edits.apply_edits(trees, *queries.byte_tokenizer())
    assert sorted(r["n_tokens"] for r in edited.collect()) == sorted(
        len(counter.encoding.encode_ordinary("Tne" if t == "one" else t or "")) for _, t in ODD)
    assert token_edits.apply_edits(nothing(trees), *queries.byte_tokenizer()).count() == 0


# --- urls

def test_url_rules_on_hand_made_urls(spark):
    urls = ["HTTP://A.Example.NET:80/en/x?q#f", "https://example.net/en", "x://net/", "x://net", "x://sub.net/a", "nope",
            None, "", "http://", "x://org/fr/", "x://a.org/fr", "x://b.org/fr/z", "x://example.com/de/1", "x://example.com/DE/",
            "x://badexample.com/de/", "x://a://b.net/", "X://EXAMPLE.NET/en/\nfoo"]
    rules = spark.createDataFrame(queries.URL_RULES + [("net", "/", "block"), (None, "/", "block")],
                                  "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in url_rules.judge_urls(pages, "url", rules).collect()}
    want = [("a.example.net:80", "/en/x", None, "allow"), ("example.net", "/en", "net/", "block"),
            ("net", "/", "net/", "block"), ("net", "", None, "allow"), ("sub.net", "/a", "net/", "block"),
            ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("org", "/fr/", "org/fr/", "allow"), ("a.org", "/fr", None, "allow"), ("b.org", "/fr/z", "org/fr/", "allow"),
            ("example.com", "/de/1", "example.com/de/", "block"), ("example.com", "/DE/", None, "allow"),
            ("badexample.com", "/de/", None, "allow"), ("a:", "//b.net/", None, "allow"),
            ("example.net", "/en/\nfoo", "example.net/en/", "allow")]
    assert [got[i] for i in range(len(urls))] == want
    salted = url_rules.judge_urls(pages, "url", rules, max_bytes=0)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in salted.collect()} == got
    assert url_rules.judge_urls(nothing(pages), "url", rules).count() == 0
    assert url_rules.judge_urls(pages, "url", nothing(rules)).where("verdict <> 'allow'").count() == 0


# --- rules

def slow_repeats(text):
    words = text.split()
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    return len({i + k for found in places.values() if len(found) > 1 for i in found for k in range(3)})


def test_metrics_of_hand_made_texts(spark):
    draw = random.Random(1)
    texts = ["", "a a a a", "a b c a b c", "a b c d e f", "a b", "x\nx\n \n\nx y\nx", "#*$%&|<> é ß"] + [
        " ".join(draw.choice("abcd") for _ in range(n)) for n in (3, 10, 40, 400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for row in cascade.base_metrics(rows).collect():
        text = row["text"]
        assert row["n_repeat_words"] == slow_repeats(text), text
        assert row["n_words"] == len(text.split()) and row["word_chars"] == sum(map(len, text.split()))
        lines = [line for line in text.split("\n") if line.strip()]
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
    assert cascade.base_metrics(rows).where("doc_id = 6").first()["n_symbols"] == 8


def test_repeats_by_pairs_equal_repeats_by_numbers(spark, monkeypatch):
    text = " ".join(random.Random(5).choice("abc") for _ in range(300))
    rows = spark.createDataFrame([(text,)], "text string")
    monkeypatch.setattr(cascade, "POSITION_MASK", 255)
    monkeypatch.setattr(cascade, "POSITION_BITS", 8)
    assert cascade.base_metrics(rows).first()["n_repeat_words"] == slow_repeats(text)


def test_cascade_orders_by_rejection_per_cost(spark, odd):
    rules = [cascade.Rule("slow", F.lit(True)), cascade.Rule("fast", F.lit(True)), cascade.Rule("idle", F.lit(False))]
    found = cascade.order_rules([cascade.Measured(rules[0], 2.0, 0.5), cascade.Measured(rules[1], 0.1, 0.3),
                                 cascade.Measured(rules[2], 0.01, 0.0)])
    assert [r.name for r in found] == ["fast", "slow", "idle"]
    rules = cascade.default_rules(lambda m: cascade.METRICS[m](F.col("text")))
    planned = cascade.plan_cascade(odd, rules)
    assert {r.name for r in planned} == {r.name for r in rules}
    kept = odd.where(~cascade.rejected(planned))
    assert [r["doc_id"] for r in kept.collect()] == []
    assert len(cascade.plan_cascade(nothing(odd), rules)) == len(rules)
    assert cascade.base_metrics(odd).count() == len(ODD)


# --- near texts

def test_signatures_agree_as_often_as_texts_are_similar():
    draw = np.random.default_rng(0)
    for _ in range(3):
        a, b = ({int(k): int(draw.integers(1, 6)) for k in draw.choice(60, n, False)} for n in (30, 40))
        flat = lambda d: (np.array(sorted(d)), np.array([d[k] for k in sorted(d)]))
        every = set(a) | set(b)
        want = sum(1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in every) for d in set(a) & set(b))
        assert near_text.similarity(flat(a), flat(b)) == pytest.approx(want)
        owner, shingles, counts = [], [], []
        for t in range(80):
            for side, d in enumerate((a, b)):
                for k in sorted(d):
                    owner.append(2 * t + side)
                    shingles.append(k + 1000 * t)
                    counts.append(d[k])
        names = near_text.mix(np.array(shingles, np.uint64)) & near_text.HASH_MASK
        taken = near_text.signatures(np.array(owner), names, np.array(counts), 160, 125)
        assert (taken[0::2] == taken[1::2]).mean() == pytest.approx(want, abs=0.03)


def test_near_classes_of_odd_tables(spark, odd):
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in near_text.near_classes(odd).collect())
    assert got == sorted((i or -1, i or -1) for i, _ in ODD)
    assert near_text.near_classes(nothing(odd)).count() == 0


def near_copies(n):
    """n texts of 100 words, each followed by one that differs in a word."""
    texts = []
    for t in range(n):
        listed = [f"w{t}x{i}" for i in range(100)]
        texts += [" ".join(listed), " ".join([*listed[:-1], "end"])]
    return texts


def test_texts_under_one_id_are_classed_one_by_one(spark):
    texts = near_copies(12)
    rows = [(5, t) for t in texts[::2]] + [(10 + i, t) for i, t in enumerate(texts[1::2])] + [(1, texts[1] + " more")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["class_id"]) for r in near_text.near_classes(table).collect()]
    assert sorted(got) == sorted([(5, 1), (10, 1), (1, 1)] + [(5, 5)] * 11 + [(11 + i, 5) for i in range(11)])


def test_chains_and_mixed_buckets(spark):
    """Steps of one word in a long text link like a chain, beside texts that share half their words."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = []
    for step in range(30):
        texts.append(" ".join(base))
        base[step * 6] = word()
    half = [word() for _ in range(100)]
    texts += [" ".join(half + [word() for _ in range(60)]) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    from tests.llm.test_queries import brute_classes

    got = {r["doc_id"]: r["class_id"] for r in near_text.near_classes(rows).collect()}
    assert got == brute_classes(list(range(len(texts))), texts)
    assert len({got[i] for i in range(30)}) == 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(3, 3)]
    found = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[k] == 7 for k in range(200, 240)) and 3 not in found


# --- chat

@given(st.text(alphabet=st.sampled_from(list("\\<>[]/sINT \n")) | st.characters(codec="utf-8"), max_size=80))
def test_escape_is_reversible_and_leaves_no_control(text):
    escaped = chat_tree.escape(text)
    assert chat_tree.unescape(escaped) == text and not any(c in escaped for c in chat_tree.CONTROLS)


def test_trees_share_tokens_and_read_back(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {'all' if t < 2 else c} </s>[INST]\\")
            for c in range(30) for t in range(4)] + [(99, 0, None, None), (None, 0, "assistant", "x" * 50_000), (99, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    file = queries.byte_tokenizer()
    trees = chat_tree.chat_trees(chat_tree.conversations(table.coalesce(1)), *file, max_conversations=10)
    held = trees.collect()
    nodes = [r for r in held if not r["leaf"]]
    sequences = {r["sequence_id"] for r in nodes}
    shared = [r for r in nodes if r["depth"] < 2 and len(r["ids"]) > 80]
    assert len(shared) <= 2 * len(sequences) and len(nodes) <= 30 * 2 + 2 * len(sequences) + 3
    for r in nodes:
        above = sum(i["end"] - i["start"] for i in r["attends"])
        assert r["position"] == above and all(i["end"] <= r["start"] for i in r["attends"])
    back = {r["id"]: r for r in chat_tree.read_conversations(trees, *file).collect()}
    assert len(back) == 32
    for c in range(30):
        want = [(role, text) for n, _, role, text in rows if n == c]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert back[c]["trained"] == [text for role, text in want if role == "assistant"]
    assert [(t["role"], t["text"]) for t in back[99]["turns"]] == [("", ""), ("", "")]
    assert back[None]["trained"] == ["x" * 50_000]
    assert chat_tree.chat_trees(chat_tree.conversations(nothing(table)), *file).count() == 0


# --- mixing

def test_targets_share_the_excess_again(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 400), (None, 10)], "source string, size bigint")
    keyed = sizes.select(mixing._source_key(F.col("source")).alias("source_key"), "size")
    got = {r["source_key"]["name"] or None: r["target"] for r in mixing.source_targets(keyed, (3, 1, 2), 1.5, 2).collect()}
    # 2265 by weights 3 1 2 3: a and the null source are cut first, then c.
    assert got == {"a": 200.0, None: 20.0, "c": 800.0, "b": 1245.0}


def test_sainte_lague_equals_the_definition(spark):
    draw = random.Random(2)
    for seats in (0, 1, 7, 40):
        votes = [draw.randrange(0, 100) for _ in range(6)]
        table = spark.createDataFrame([("g", i, v, seats) for i, v in enumerate(votes)],
                                      "g string, no int, votes int, seats int")
        got = {r["no"]: r["quota"] for r in mixing.sainte_lague(table, ["g"], "seats", "votes", "no").collect()}
        quotients = sorted((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) if v for k in range(seats))
        want = dict.fromkeys(range(6), 0)
        for _, i, _ in quotients[:seats]:
            want[i] += 1
        assert got == want


def test_mixed_texts_have_the_words_that_are_taken(spark, odd):
    mixed = mixing.mix(odd, block=4, keep=["text"])
    texts = mixing.mixed_texts(F.col("kept.text"), F.col("size"), F.col("runs"))
    for row in mixed.withColumn("texts", texts).collect():
        assert row["taken"] <= 2 * row["size"] and sum(len(t.split()) for t in row["texts"]) >= row["taken"]
    assert mixed.count() == len(ODD) and mixing.mix(nothing(odd)).count() == 0
    again = mixing.mix(odd.repartition(5), block=4)
    key = lambda df: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in df.collect())
    assert key(again) == key(mixed)


# --- packing

def test_windows_are_filled_from_shorter_pieces():
    pool = packing.Pool()
    for doc, length in enumerate([60, 40, 30, 9, 5, 3, 64, 20]):
        pool.add(doc, 0, length)
    filled = list(packing.fill_windows(pool, [64, 32, 16], True))
    assert [w for w, _ in filled] == [64, 64, 64, 32, 4, 2, 1] or sum(w for w, _ in filled) == 231
    assert all(sum(n for _, _, n in pieces) == w for w, pieces in filled)
    assert packing.Pool().longest(10) == 0


def test_step_groups_have_equal_tokens():
    sequences = [(64, [(0, 0, 64)])] * 10 + [(32, [(0, 0, 16), (1, 0, 16)])] * 7
    groups = packing.balanced_groups(sequences, 128)
    sums = {}
    for (window, _), group in zip(sequences, groups):
        sums[group] = sums.get(group, 0) + window
    assert max(sums.values()) <= 128 and len(sums) == 7


word = st.text(alphabet=st.sampled_from(list("aAzZ09'\"-,.!<|>éÉßİσΣ\u0301中½\u00a0_#")), min_size=0, max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(word, st.sampled_from(["<|endoftext|>", "a<|startoftext|>b", "it's", "'s", "''s", "We'LL"])),
                max_size=12), st.sampled_from([" ", "\n", "  \t"]))
def test_word_encoder_equals_tokenizer(words, space):
    encoder = tokens.word_encoder(queries.tokenizer_path(queries.WORD_BPE))
    text = space.join(words)
    ids, counts = encoder.encode(pa.array([text, None, text]))
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and counts.tolist() == [len(want), 0, len(want)]


def test_packing_of_odd_tables(spark, odd):
    path = queries.tokenizer_path(queries.WORD_BPE)
    pieces = packing.pack(odd, path, pool_tokens=4096).collect()
    assert sum(p["length"] for p in pieces) == sum(
        len(tokens.word_encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert packing.pack(nothing(odd), path).count() == 0


# --- archives

def record(payload: bytes, key: str = "1", digest: str | None = None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    head = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{key}>\r\nContent-Type: application/http\r\n"
            f"WARC-Payload-Digest: sha1:{digest or warc.digest_of(payload)}\r\nContent-Length: {len(http + payload)}\r\n\r\n")
    return head.encode() + http + payload + b"\r\n\r\n"


def found(data: bytes):
    rows = list(warc.salvage(data))
    covered = sorted((a, b) for a, b, _ in rows)
    assert not data or (covered[0][0] == 0 and covered[-1][1] == len(data))
    return [r["payload"] if isinstance(r, dict) else (a, b) for a, b, r in rows]


def test_salvage_of_plain_archives():
    parts = [record(b"first"), record(b"WARC/1.1\r\nin a payload"), record(b"")]
    assert found(b"".join(parts)) == [b"first", b"WARC/1.1\r\nin a payload", b""]
    n = len(parts[0])
    assert found(b"junk" + parts[0]) == [(0, 4), b"first"]
    assert found(parts[0] + b"junk" + parts[2]) == [b"first", (n, n + 4), b""]
    assert found(parts[0][:-10] + parts[2]) == [(0, n - 10), b""]
    assert found(record(b"x", digest="A" * 32) + parts[0]) == [(0, len(record(b"x", digest="A" * 32))), b"first"]
    assert found(parts[0] + parts[2][:40]) == [b"first", (n, n + 40)]
    assert found(parts[0].replace(b"Content-Length: 24", b"Content-Length: 99") + parts[2]) == [(0, n), b""]
    assert found(b"nothing here") == [(0, 12)] and found(b"") == []


def test_salvage_of_gzip_members():
    parts = [gzip.compress(record(p * 50, k), mtime=0) for p, k in ((b"one", "1"), (b"two", "2"), (b"three", "3"))]
    payloads = [b"one" * 50, b"two" * 50, b"three" * 50]
    assert found(b"".join(parts)) == payloads
    broken = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    broken[at:at + 8] = bytes(8)
    got = found(bytes(broken))
    assert got[0] == payloads[0] and got[-1] == payloads[2] and (len(parts[0]), len(parts[0] + parts[1])) in got
    assert found(parts[0] + b"garbage" + parts[2])[::2] == [payloads[0], payloads[2]]
    assert found(b"".join(parts)[:-5])[:2] == payloads[:2]


def test_archives_of_odd_pages(spark):
    rows = [(3, "u", "same"), (1, "u", "same"), (2, None, None), (5, "a\r\nb", ""), (None, "u", "same"), (1, "u", "same"),
            (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = warc.archived(pages)
    assert got.where("problem IS NOT NULL").count() == 0 and got.count() == len(rows)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.collect()
                   if r["payload_bytes"] == 4)
    assert kinds == [("<urn:page:1>", "response", None, 4), ("<urn:page:1>", "response", None, 4),
                     ("<urn:page:3>", "revisit", "<urn:page:1>", 4), ("<urn:page:>", "revisit", "<urn:page:1>", 4)]
    assert warc.archived(nothing(pages)).count() == 0


# --- vectors

def test_links_equal_all_pairs(spark):
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(12, 32))
    vectors = [c + draw.normal(size=32) * s for c in centers for s in (0.02, 0.1, 0.3, 0.35, 0.4) for _ in range(6)]
    vectors += [vectors[0] * 2] * 3 + [vectors[0]] * 40
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    unit = near_vectors.unit_rows(np.array([r[1] for r in rows]))
    labels = np.array([r[2] for r in rows])
    links = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(len(rows), dtype=bool)
    odd = [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [None] * 32, 1), (1004, [], 1),
           (1005, rows[0][1], None), (1006, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    for part in (1024, 8):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_links(table, part=part).collect()}
        root = streams.chains(*np.nonzero(links), len(rows))
        want = {i: (int(links[i].sum()), int(root[i])) for i in range(len(rows))}
        share = sum(got[i][0] for i in want) / links.sum()
        assert 0.99 <= share <= 1 and all(got[i][0] <= want[i][0] for i in want)
        if share == 1:
            assert {i: got[i] for i in want} == want
        assert all(got[i] == (0, i) for i in (*range(1000, 1007), None))
    assert near_vectors.near_links(nothing(table)).count() == 0


def pairs_at(cosine, count, dim, seed):
    draw = np.random.default_rng(seed)
    left = near_vectors.unit_rows(draw.normal(size=(count, dim)))
    away = draw.normal(size=(count, dim))
    away = near_vectors.unit_rows(away - (away * left).sum(axis=1, keepdims=True) * left)
    return left, cosine * left + np.sqrt(1 - cosine ** 2) * away


def test_pairs_at_the_threshold_share_a_filter_at_every_size():
    for n, dim in ((10 ** 5, 64), (10 ** 6, 64), (10 ** 7, 64), (10 ** 8, 64), (10 ** 6, 8), (10 ** 5, 3), (10 ** 5, 300)):
        settings = near_vectors.code_settings(n, dim)
        code = near_vectors.product_codes(dim, *settings, 5)
        (i, f), (j, g) = (near_vectors.vector_filters(side, code) for side in pairs_at(0.93, 500, dim, 21))
        met = {row for row, _ in set(zip(i.tolist(), f.tolist())) & set(zip(j.tolist(), g.tolist()))}
        assert len(met) >= 0.99 * 500, (n, dim, len(met))


def test_links_are_found_with_the_settings_of_a_large_table(spark):
    left, right = pairs_at(0.9301, 300, 64, 22)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([left, right]))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = near_vectors.near_links(table, settings=near_vectors.code_settings(10 ** 7, 64)).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * 600 <= got <= 600


def test_vectors_of_every_number_of_dimensions_are_compared(spark):
    draw = np.random.default_rng(23)
    vectors = [c + draw.normal(size=dim) * s for dim, count in ((1, 4), (2, 8), (5, 8), (16, 60), (40, 8))
               for c in draw.normal(size=(count, dim)) for s in (0.0, 0.1, 0.3)]
    vectors += vectors[:30]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    unit = [v / np.linalg.norm(v) for v in vectors]
    want = {i: sum(j != i and i % 2 == j % 2 and len(u) == len(v) and u @ v >= 0.93 for j, v in enumerate(unit))
            for i, u in enumerate(unit)}
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_links(table).collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in want)
    for dim in (1, 2, 5, 16, 40):
        ids = [i for i in want if len(vectors[i]) == dim]
        assert sum(got[i] for i in ids) >= 0.99 * sum(want[i] for i in ids) > 0, dim


def test_list_decoding_finds_every_filter_above_the_bound():
    draw = np.random.default_rng(1)
    vectors = near_vectors.unit_rows(draw.normal(size=(40, 12)))
    for blocks in (1, 2, 3):
        code = near_vectors.product_codes(12, 1, blocks, 5, 0.3, 7)
        row, name = near_vectors.list_decode(vectors, code.blocks[0], 0.3)
        want = set()
        for f in range(5 ** blocks):
            digits = [f // 5 ** (blocks - 1 - i) % 5 for i in range(blocks)]
            whole = np.concatenate([code.blocks[0][i][d] for i, d in enumerate(digits)]) / np.sqrt(blocks)
            want |= {(int(r), f) for r in np.flatnonzero(vectors @ whole >= 0.3 - 1e-12)}
        assert set(zip(row.tolist(), name.tolist())) == want


def test_punctuation_is_cut_off_every_letter_as_the_tokenizer_does():
    encoder = tokens.word_encoder(queries.tokenizer_path(queries.WORD_BPE))
    words = [f"x{chr(c)},'s" if c % 2 else f"{chr(c)}." for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000
             and not chr(c).isspace()]
    ids, counts = encoder.encode(pa.array(words, pa.large_string()))
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_vectors_without_a_label_or_few_of_a_kind_are_served_by_the_filters(spark):
    rows = [(i, [1.0, float(i % 4), 0.5, 0.0, 2.0, -1.0, 0.0, 1.0], i % 3 or None) for i in range(60)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (None, [1.0] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_links(table).collect()}
    unit = near_vectors.unit_rows(np.array([r[1] for r in rows[:60]]))
    for i in range(60):
        linked = [j for j in range(60) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2]
                  and unit[i] @ unit[j] >= 0.93]
        assert got[i][0] == len(linked), i
    assert all(got[i] == (0, i) for i in range(0, 60, 3)) and got[100] == (0, 100) and got[101] == (0, 101)
    assert got[None] == (0, None) and len(got) == 63


def test_long_pages_that_lie_together_do_not_share_a_large_archive(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}", str(i) * 20) for i in range(400)]
    rows += [(1000 + i, f"http://b.org/{i}", chr(97 + i) * 300_000) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, str(tmp_path / "archives"), file_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "archives").glob("part-*")]
    assert max(sizes) <= warc.LONG << 20 and len(sizes) >= 4
    got = warc.read_archives(spark, path)
    assert got.where("problem IS NOT NULL").count() == 0
    assert got.where("record_type = 'response'").agg({"payload_bytes": "sum"}).first()[0] == sum(len(r[2]) for r in rows)

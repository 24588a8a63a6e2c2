"""Registered operator queries: against SQL where there is one, else against brute force, on odd and skewed tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from rankloom import staging
from rankloom.llm import near_text, oracle, queries
from tools.check import TABLES, compare


@pytest.fixture(scope="module")
def con(skewed):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{skewed}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle.build()))
def test_query_equals_sql(spark, con, skewed, name):
    status, _, _ = compare(spark, con, name, skewed)
    staging.release(spark)
    assert status.startswith("ok") and "TYPES" not in status, status


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(oracle.build()) == {n for n in queries.QUERIES if n.split("_")[0] not in ("op1", "op2", "op5", "op8", "op12", "op13")}


def test_classifier_finds_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op1_quality_classifier(spark, folder).toPandas()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.3) == (scored.predicted == 1)).all()
    judged = scored.merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id").query("held_out")
    assert len(scored) == 10000 and (judged.predicted == judged.quality).mean() > 0.99
    assert ((judged.score - judged.quality) ** 2).mean() < 0.01


def test_classifier_on_odd_tables(spark, skewed):
    scored = queries.op1_quality_classifier(spark, skewed).toPandas()
    assert len(scored) == 200 and scored.score.between(0, 1).all()


def test_token_counts_equal_whole_encoding(spark, skewed):
    from pyspark.sql import functions as F
    from rankloom.llm.token_edits import PieceCounter

    found = queries.op2_token_counts(spark, skewed).toPandas().set_index("doc_id")
    encode = PieceCounter(*queries.byte_tokenizer()).encoding.encode_ordinary
    docs = queries.table(spark, skewed, "documents", "doc_id", "text")
    rows = docs.withColumn("edits", queries.sample_edits(F.col("doc_id"), F.col("text"))).collect()
    assert len(rows) == len(found)
    for row in rows:
        text = row["text"] or ""
        assert found.n_tokens_before[row["doc_id"]] == len(encode(text))
        for e in row["edits"]:
            start = min(e["start"], len(text))
            text = text[:start] + e["replacement"] + text[max(e["stop"], start):]
        assert found.n_tokens_after[row["doc_id"]] == len(encode(text))


def brute_classes(ids, texts, threshold=0.8):
    """Smallest id per component of pairs with at least the threshold, over all pairs."""
    owner, shingles, counts = near_text.shingle_counts(pa.array(texts, pa.large_string()))
    weights = [dict(zip(shingles[owner == i].tolist(), counts[owner == i].tolist())) for i in range(len(ids))]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            a, b = weights[i], weights[j]
            common = set(a) & set(b)
            if not common or len(common) < 0.3 * min(len(a), len(b)):
                continue
            if a == b:
                similarity = 1.0
            else:
                every = set(a) | set(b)
                similarity = sum(1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in every) for d in common)
            if similarity >= threshold:
                low, high = sorted((find(i), find(j)), key=lambda x: ids[x])
                root[high] = low
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_near_documents_equal_all_pairs(spark, skewed):
    docs = pd.read_parquet(f"{skewed}/documents.parquet")
    found = queries.op5_near_documents(spark, skewed).toPandas()
    want = brute_classes(docs.doc_id.tolist(), [t or "" for t in docs.text])
    assert dict(zip(found.doc_id, found.class_id)) == want
    assert (found.kept == (found.doc_id == found.class_id)).all() and not found.kept.all()


def test_packing_covers_every_id_once(spark, skewed):
    from tokenizers import Tokenizer

    pieces = queries.op8_packing(spark, skewed).toPandas()
    docs = pd.read_parquet(f"{skewed}/documents.parquet")
    tokenizer = Tokenizer.from_file(queries.tokenizer_path(queries.WORD_BPE))
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
           for i, t in zip(docs.doc_id, docs.text)}
    for name, own in pieces.sort_values("start").groupby("doc_id"):
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids[name])
        for p in own.itertuples():
            assert p.doc_tokens == len(ids[name])
            assert p.ids_crc32 == zlib.crc32(ids[name][p.start:p.start + p.length].tobytes())
    assert pieces.doc_id.nunique() == len(docs)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]]
    lengths = pieces.groupby("sequence_id").length.sum()
    assert lengths.max() <= 2048 and all(n & (n - 1) == 0 for n in lengths)


def test_mix_comes_near_its_targets(spark):
    folder = "/root/testdata/sf0.1"
    mixed = queries.op7_source_mix(spark, folder).toPandas()
    mixed = mixed.merge(pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "source"]), on="doc_id")
    assert (mixed.taken <= 2 * mixed["size"]).all()
    sums = mixed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums.taken - sums.target).abs() <= 0.002 * sums.target).all()


def brute_runs(w):
    """``start, length, period`` of every run of a list of words, by its definition."""
    found = {}
    for q in range(len(w) // 4, 0, -1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q) and i > start:
                found[start, i + q - start] = q
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def test_brute_runs():
    assert brute_runs("a b a b a b a b c".split()) == [(0, 8, 2)]
    assert brute_runs(["a"] * 5) == [] and brute_runs(["a"] * 12) == [(0, 12, 1)]


def test_periodic_runs_equal_brute_force(spark, skewed):
    docs = pd.read_parquet(f"{skewed}/documents.parquet")
    found = queries.op12_periodic_runs(spark, skewed).toPandas().set_index("doc_id")
    assert len(found) == len(docs) and (found.n_runs > 0).sum() > 10
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for name, text in zip(docs.doc_id, docs.text):
        ws = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        h, n = zlib.crc32(str(name).encode()), len(ws)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[a + (i - a) % p] if i >= a else w for i, w in enumerate(ws)]
        runs, row = brute_runs(ws), found.loc[name]
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == digest("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2]))))
        assert row.collapsed_sha256 == digest(" ".join(w for i, w in enumerate(ws) if i not in dropped))
        if runs:
            s, m, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert row[["start", "length", "period", "exponent_milli"]].isna().all()


def test_byte_bpe_equals_library(spark, skewed):
    import tiktoken
    from rankloom.llm.merge_tree import read_ranks

    path, pattern = queries.byte_tokenizer()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    docs = pd.read_parquet(f"{skewed}/documents.parquet")
    found = queries.op13_byte_bpe(spark, skewed).toPandas().set_index("doc_id")
    assert len(found) == len(docs)
    for name, text in zip(docs.doc_id, docs.text):
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
        assert found.n_tokens[name] == len(ids)
        assert found.ids_sha256[name] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert found.decoded_sha256[name] == hashlib.sha256((text or "").encode()).hexdigest()

"""The pipeline's stages on odd and skewed documents, each against what its operator says."""

from __future__ import annotations

import pandas as pd
import pytest

import corpus_pipeline
from rankloom.llm import cascade, near_text, quality_model, tokens
from rankloom.llm.queries import WORD_BPE, tokenizer_path
from rankloom.staging import stage

from tests.llm.test_queries import brute_classes


@pytest.fixture(scope="module")
def outputs(spark, skewed):
    docs = spark.read.parquet(f"{skewed}/documents.parquet")
    found = {"documents": docs}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, skewed), "pipeline-test")
        found[name] = docs
    return {name: df.toPandas() for name, df in found.items()}


def test_order_and_columns(outputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "quality classifier", "near duplicates", "source mix", "packing"]
    for name in list(outputs)[:-1]:
        assert list(outputs[name].columns) == list(outputs["documents"].columns), name


def test_rules_reject_what_any_rule_rejects(spark, skewed, outputs):
    from pyspark.sql import functions as F

    metrics = cascade.base_metrics(spark.read.parquet(f"{skewed}/documents.parquet"))
    kept = metrics.where(~cascade.rejected(cascade.default_rules(F.col))).select("doc_id").toPandas()
    assert sorted(kept.doc_id) == sorted(outputs["quality rules"].doc_id)
    assert 0 < len(kept) < len(outputs["documents"])


def test_classifier_keeps_scores_from_its_bound(outputs):
    before, after = outputs["quality rules"], outputs["quality classifier"]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) > 0.5 * len(before)


def test_one_document_of_each_group_stays(outputs):
    before, after = outputs["quality classifier"], outputs["near duplicates"]
    classes = brute_classes(before.doc_id.tolist(), before.text.tolist())
    assert sorted(after.doc_id) == sorted(set(classes.values())) and len(after) < len(before)


def test_mix_repeats_texts_near_the_target(outputs):
    before, after = outputs["near duplicates"], outputs["source mix"]
    n_words = lambda df: df.text.str.split(r"[\x20\x09-\x0D]+", regex=True).map(lambda ws: sum(w != "" for w in ws))
    assert n_words(after).sum() == pytest.approx(1.5 * n_words(before).sum(), rel=0.02)
    assert after.groupby("doc_id").size().max() <= 2 and set(after.doc_id) <= set(before.doc_id)
    assert (after.n_chars == after.text.str.len()).all()
    whole = dict(zip(before.doc_id, before.text))
    for row in after.itertuples():
        assert row.text == whole[row.doc_id] or set(row.text.split()) <= set(whole[row.doc_id].split())


def test_packing_holds_all_tokens(outputs):
    texts, pieces = outputs["source mix"].text, outputs["packing"]
    encoder = tokens.word_encoder(tokenizer_path(WORD_BPE)).tokenizer
    assert pieces.length.sum() == sum(len(e.ids) + 1 for e in encoder.encode_batch(texts.tolist(), add_special_tokens=False))
    assert (pieces.ids.map(len) == 4 * pieces.length).all() and pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_odd_documents_pass_every_stage_alone(spark, skewed):
    rows = [(None, "a b c " * 40, None, None, None), (1, None, "en", None, 0), (2, "", "en", "x", 0),
            (3, "word " * 60, None, "x", 300), (3, "word " * 60, None, "x", 300)]
    schema = spark.read.parquet(f"{skewed}/documents.parquet").schema
    odd = spark.createDataFrame(rows, schema)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, odd, skewed)
        assert out.count() >= (name in ("near duplicates", "source mix", "packing")), name
        assert function(spark, odd.where("false"), skewed).count() == 0, name
    near = corpus_pipeline.near_duplicates(spark, odd, skewed).toPandas()
    assert sorted(near.doc_id.fillna(-1)) == [-1, 1, 2, 3]


def test_copies_are_told_by_text_not_by_id(spark, skewed):
    from tests.llm.test_kernels import near_copies

    texts = near_copies(8)
    rows = [(7, t) for t in texts[:8:2]] + [(None, t) for t in texts[1:8]] + [(None, t) for t in texts[8:]] + [(9, None), (9, "")]
    schema = spark.read.parquet(f"{skewed}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], schema)
    near = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, skewed).collect()]
    assert sorted(t for i, t in near if i == 7) == sorted(texts[:8:2])
    nameless = [t for i, t in near if i is None]
    assert len(nameless) == 4 and {t.split()[0] for t in nameless} == {f"w{k}x0" for k in range(4, 8)}
    assert len(near) == 10


def test_run_gives_the_last_stage(spark, skewed, outputs):
    assert corpus_pipeline.run(spark, skewed).columns == list(outputs["packing"].columns)

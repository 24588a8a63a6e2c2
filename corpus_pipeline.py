"""A training corpus from documents, stage by stage.

Every stage takes the rows that its predecessor kept, and its decisions take effect: rejected documents go, copies go, the
mix repeats and cuts texts, and the last stage gives packed pieces with their token ids. Stages are written as Parquet, so
each starts from a table and none repeats the work before it.

Defined cases are those of the operators. Copies are told by their texts, whatever the ids; blank texts are copies where
id and text are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm import cascade, mixing, near_text, packing, quality_model
from rankloom.llm.queries import WORD_BPE, tokenizer_path
from rankloom.staging import stage

# ProbMinHash, the fitted classifier and a tokenizer file have no SQL counterpart.
ORACLE_SQL = None

MIN_SCORE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    rules = cascade.default_rules(lambda m: cascade.METRICS[m](F.col("text")))
    order = [rule.name for rule in cascade.plan_cascade(docs, rules)]
    return docs.where(~cascade.text_rejected(F.col("text"), order))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least ``MIN_SCORE``, by a model that is fitted on the labelled ones among these."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    stats = stage(quality_model.with_stats(docs.select("doc_id", "text")), "stats")
    model = quality_model.learn(stats, labels)
    return quality_model.score_documents(docs, model).where(F.col("score") >= MIN_SCORE).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, null last."""
    gone = stage(near_text.text_classes(docs.select("doc_id", "text")).where("digest <> class_digest").select("digest"), "copies")
    blank = lambda c: F.when(F.col("_digest").isNull(), F.col(c))
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("doc_id").isNull(), "doc_id", "text"))
    one = (near_text.with_digests(docs, name="_digest")
           .groupBy("_digest", blank("doc_id").alias("_id"), blank("text").alias("_text")).agg(first.alias("row")))
    return one.join(gone, one["_digest"] == gone["digest"], "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes: repeated for a second pass, cut where it takes a part."""
    mixed = mixing.mix(docs, keep=docs.columns)
    texts = mixing.mixed_texts(F.col("kept.text"), F.col("size"), F.col("runs"))
    taken = mixed.select("kept", F.explode(texts).alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return taken.select(*[changed.get(c, F.col(f"kept.{c}")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return packing.pack(docs, tokenizer_path(WORD_BPE))


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier),
          ("near duplicates", near_duplicates), ("source mix", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

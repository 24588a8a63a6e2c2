"""Corpus building: the stratified combined corpus, and data for language-model adaptation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions.text import clean_text
from rankloom.functions.vectors import l2_normalize
from rankloom.operators.masking import PAD, mask_tokens
from rankloom.operators.sampling import stratified_sample, train_validation_split
from rankloom.operators.search import top_k as search_top_k
from rankloom.operators.tfidf import TfidfSettings, fit_vocabulary, staged_tokens, token_table
from rankloom.operators.wordmodel import WordModelSettings, fit_propagated_model, word_encoder
from rankloom.plans.matching import semantic_vectors
from rankloom.sources.tables import load_or_clean_jobs, load_or_clean_resumes, strip_lines
from rankloom.sources.versions import load_version, save_version
from rankloom.staging import stage


def combined_corpus(resumes: DataFrame, jobs: DataFrame, total: int = 100_000,
                    seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(``origin, id, text_cleaned`` of all résumés and the sampled jobs, the sampled jobs).

    resumes  ``id, text_cleaned``;  jobs  ``job_id, title, text_cleaned``.
    """
    sampled = stratified_sample(jobs, "job_id", total, seed)
    corpus = (resumes.select(F.lit("resume").alias("origin"), "id", "text_cleaned")
              .unionByName(sampled.select(F.lit("job").alias("origin"), F.col("job_id").alias("id"),
                                          "text_cleaned")))
    return corpus, sampled


def masked_corpus(lines: DataFrame, settings: TfidfSettings, fraction: float = 0.1, length: int = 256,
                  probability: float = 0.15, seed: int = 42, pad: bool = False) -> DataFrame:
    """``doc_id, line`` to ``doc_id, split, pos, token, label``: split, truncate, mask.

    With ``pad`` every line has ``length`` positions, and ``mask`` is 1 for its tokens and 0 for padding.
    """
    tokens = staged_tokens(lines, "doc_id", "line", settings)
    vocabulary = fit_vocabulary(tokens, settings)
    split = train_validation_split(tokens, "doc_id", fraction, seed)
    masked = mask_tokens(split, vocabulary, probability, length, seed, ["split"])
    if not pad:
        return masked
    short = split.where(F.size("tokens") < length)
    padding = short.select("doc_id", "split", F.explode(F.sequence(
        F.size("tokens").cast("long"), F.lit(length - 1).cast("long"))).alias("pos"), F.lit(PAD).alias("token"), F.lit(None).cast("string").alias("label"))
    return (masked.withColumn("mask", F.lit(1).cast("long"))
            .unionByName(padding.withColumn("mask", F.lit(0).cast("long"))))


def prepare_corpus(texts: DataFrame, id_column: str, text_column: str, settings: TfidfSettings, fraction: float = 0.1,
                   length: int = 256, probability: float = 0.15, seed: int = 42) -> DataFrame:
    """From texts to padded training lines: strip lines, drop blank ones, split, truncate and pad, mask.

    ``doc_id`` is the text's id and the number of the line.
    """
    raw = texts.select(id_column, F.posexplode(F.split(text_column, "\n")).alias("_line", "_raw"))
    lines = strip_lines(raw, "_raw").select(
        F.concat_ws(":", F.col(id_column).cast("string"), F.col("_line").cast("string")).alias("doc_id"), "line")
    return masked_corpus(lines, settings, fraction, length, probability, seed, pad=True)


def fit_to_domain(*sides: DataFrame) -> list[DataFrame]:
    """Embeddings of one domain, unit length again after the mean of them all is taken out.

    What all texts have in common goes, so that scores tell the texts of this domain apart.
    """
    together = sides[0].select("embedding")
    for side in sides[1:]:
        together = together.unionByName(side.select("embedding"))
    # One row per dimension.
    means = (together.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))
             .orderBy("dim").collect())
    mean = F.array(*[F.lit(r["mean"]) for r in means]).cast("array<double>")
    return [l2_normalize(side.withColumn("embedding", F.zip_with("embedding", mean, lambda x, m: x - m)), "embedding")
            for side in sides]


def domain_ranking(jobs: DataFrame, resumes: DataFrame, top_k: int, encoder: Callable) -> DataFrame:
    """Embed both texts as one domain, and rank the résumés for each job description; ids of any type.

    jobs  ``query_id, text``;  resumes  ``doc_id, text``.
    """
    queries, index = fit_to_domain(semantic_vectors(jobs, "query_id", "text", encoder),
                                   semantic_vectors(resumes, "doc_id", "text", encoder))
    return search_top_k(stage(queries, "embeddings"), index, top_k)


def learnt_domain_ranking(jobs: DataFrame, resumes: DataFrame, top_k: int, settings: WordModelSettings) -> DataFrame:
    """``domain_ranking`` by an encoder that is trained on the cleaned texts of both sides first.

    jobs  ``query_id, text``;  resumes  ``doc_id, text``. Words that the model does not have do not count.
    """
    cleaned = lambda df, key: df.select(key, clean_text(F.col("text")).alias("text"))
    jobs, resumes = cleaned(jobs, "query_id"), cleaned(resumes, "doc_id")
    tokens = [token_table(side, key, F.col("text"), ascii_only=True).select("tokens")
              for side, key in ((jobs, "query_id"), (resumes, "doc_id"))]
    model = fit_propagated_model(stage(tokens[0].unionByName(tokens[1]), "tokens"), settings)
    return domain_ranking(jobs, resumes, top_k, word_encoder(model))


def prepare_resumes(spark: SparkSession, raw_path: str, cleaned_path: str, versions_base: str,
                    max_versions: int = 2, version: str | None = None) -> DataFrame:
    """Load and clean résumés once, save the cleaned table as a new version, and read that version."""
    cleaned = load_or_clean_resumes(spark, cleaned_path, raw_path)
    save_version(cleaned, versions_base, max_versions, version)
    return load_version(spark, versions_base, version)


def prepare_jobs(spark: SparkSession, raw_path: str, cleaned_path: str, resumes: DataFrame,
                 id_column: str | None = None) -> DataFrame:
    """Load a sample of job descriptions as large as the résumé table, clean it once, and read it."""
    return load_or_clean_jobs(spark, cleaned_path, raw_path, resumes.count(), id_column)

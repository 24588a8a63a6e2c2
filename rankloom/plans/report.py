"""The exploratory report over cleaned résumés and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.operators.search import top_k as search_top_k
from rankloom.operators.statistics import (histogram_of_lengths, lengths_of, text_counts, top_words_of_titles, weights_of_words,
                                           words_of)
from rankloom.operators.tfidf import TfidfSettings, fit_vocabulary, tfidf_vectors, token_table
from rankloom.staging import stage


def pairwise_similarity(df: DataFrame, id_column: str, column: str, n_documents: int = 100,
                        max_features: int = 100) -> DataFrame:
    """``doc_a, doc_b, score``: the similarity map of the first ``n_documents`` non-null texts."""
    first = df.where(F.col(column).isNotNull()).orderBy(id_column).limit(n_documents)
    settings = TfidfSettings(max_features=max_features, ngram_range=(1, 1), min_df=1, max_df=1.0, stop_words=None)
    tokens = stage(token_table(first, id_column, F.col(column)), "tokens")
    vectors = stage(tfidf_vectors(tokens, fit_vocabulary(tokens, settings), settings), "vectors")
    pairs = search_top_k(vectors, vectors, n_documents)
    return pairs.select(F.col("query_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), "score")


def explore(resumes: DataFrame, jobs: DataFrame, column: str = "text_cleaned") -> dict[str, DataFrame]:
    """The report's tables. resumes ``id, <column>``; jobs ``job_id, title, <column>``.

    The texts of each side are scanned once for all counts, and once more for the first hundred that are compared.
    """
    of_resumes, of_jobs = text_counts(resumes, column), text_counts(jobs, column, "title")
    resume_words, job_words = words_of(of_resumes), words_of(of_jobs)
    top = lambda words: words.orderBy(F.desc("cnt"), "word").limit(30)
    return {
        "resume_word_frequency": top(resume_words),
        "resume_word_weights": weights_of_words(resume_words),
        "resume_lengths": histogram_of_lengths(lengths_of(of_resumes)),
        "resume_similarity": pairwise_similarity(resumes, "id", column, 100, 100),
        "job_word_frequency": top(job_words),
        "job_word_weights": weights_of_words(job_words),
        "job_lengths": histogram_of_lengths(lengths_of(of_jobs)),
        "job_top_words": top_words_of_titles(of_jobs),
    }


def report_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """``section, label, value``: all tables of the report below one another, numbers at 9 places."""
    shown = {"frequency": ("word", "cnt"), "weights": ("word", "weight"), "lengths": ("bin", "cnt"),
             "similarity": (F.concat_ws(" ", "doc_a", "doc_b"), "score"), "top_words": (F.concat_ws(" ", "title", "word"), "cnt")}
    rows = None
    for section, table in tables.items():
        label, value = next(v for k, v in shown.items() if section.endswith(k))
        label = F.col(label) if isinstance(label, str) else label
        part = table.select(F.lit(section).alias("section"), label.cast("string").alias("label"),
                            F.round(F.col(value).cast("double"), 9).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows

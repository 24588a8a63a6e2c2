"""The two ranking questions, for many queries at once.

applicant   for each résumé the best jobs, one per job title
recruiter   for each job description the best résumés, over a whole table or inside a request
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from rankloom.functions.text import clean_text, clean_text_semantic
from rankloom.functions.vectors import l2_normalize
from rankloom.operators.ranking import check_top_k, effective_top_k, rank_all, rank_top
from rankloom.operators.requests import request_scores
from rankloom.operators.search import top_k as search_top_k
from rankloom.operators.statistics import distinct_titles
from rankloom.operators.tfidf import (TfidfSettings, base_settings, combined_settings, fit_vocabulary,
                                      staged_tokens, tfidf_vectors)
from rankloom.staging import stage


def sparse_vectors(df: DataFrame, id_column: str, text_column: str, vocabulary: DataFrame, settings: TfidfSettings,
                   keep: list[str] | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Clean, tokenize and weigh a text column; with a lexicon the words are lemmatized."""
    return tfidf_vectors(staged_tokens(df, id_column, text_column, settings, keep or [], lexicon), vocabulary,
                         settings, keep or [])


def titles_available(jobs: DataFrame) -> int:
    """Distinct titles, a missing title being one of them."""
    return distinct_titles(jobs, "title").first()["n_distinct_with_null"]


def best_titles(query_vectors: DataFrame, job_vectors: DataFrame, titles: DataFrame, top_k: int | None,
                places: int | None) -> DataFrame:
    """``query_id, rank, title, job_id, score``; rounding comes after ranking.

    With ``top_k`` None all distinct titles of the table ``titles`` are ranked: a row per query and title.
    """
    check_top_k(top_k)
    k = top_k or max(titles_available(titles), 1)
    found = search_top_k(query_vectors, job_vectors, k, one_per_title=True)
    score = F.col("score") if places is None else F.round("score", places)
    return found.select("query_id", "rank", "title", F.col("doc_id").alias("job_id"), score.alias("score"))


def match_titles(resumes: DataFrame, jobs: DataFrame, top_k: int | None = 10,
                 vocabulary: DataFrame | None = None, job_vectors: DataFrame | None = None,
                 settings: TfidfSettings | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Best job titles per résumé by TF-IDF.

    resumes  ``query_id, text``;  jobs  ``job_id, title, text``. Without a vocabulary it is fitted on the
    jobs; a fitted vocabulary and job vectors (with titles) are used as they are. With a lexicon both texts are
    lemmatized. ``top_k`` None gives a row per résumé and title.
    """
    check_top_k(top_k)
    settings = settings or base_settings()
    if vocabulary is None or job_vectors is None:
        tokens = staged_tokens(jobs, "job_id", "text", settings, ["title"], lexicon)
        vocabulary = fit_vocabulary(tokens, settings) if vocabulary is None else vocabulary
        job_vectors = tfidf_vectors(tokens, vocabulary, settings, ["title"])
    queries = stage(sparse_vectors(resumes, "query_id", "text", vocabulary, settings, lexicon=lexicon), "vectors")
    return best_titles(queries, job_vectors, jobs, top_k, places=4)


def match_titles_dense(query_vectors: DataFrame, job_vectors: DataFrame, top_k: int | None = 10) -> DataFrame:
    """Best job titles per query by inner product of unit embeddings; scores stay unrounded."""
    return best_titles(query_vectors, job_vectors, job_vectors, top_k, places=None)


def fit_combined(resumes: DataFrame, resume_id: str, jobs: DataFrame, job_id: str, settings: TfidfSettings,
                 lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One vocabulary over both texts: (vocabulary, résumé vectors, job vectors).

    The vectors are lazy over written tokens; ``stage`` them to read them more than once.
    """
    resume_tokens = staged_tokens(resumes, resume_id, "text", settings, lexicon=lexicon)
    job_tokens = staged_tokens(jobs, job_id, "text", settings, lexicon=lexicon)
    vocabulary = fit_vocabulary(resume_tokens.unionByName(job_tokens), settings)
    return (vocabulary, tfidf_vectors(resume_tokens, vocabulary, settings),
            tfidf_vectors(job_tokens, vocabulary, settings))


def rank_resumes(jobs: DataFrame, resumes: DataFrame, top_k: int | None = 10, vocabulary: DataFrame | None = None,
                 settings: TfidfSettings | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, doc_id, score``: the best résumés of the whole table for each job description.

    jobs  ``query_id, text``;  resumes  ``doc_id, text``. Ties keep the order of ``doc_id``. With a lexicon both
    texts are lemmatized. ``top_k`` None ranks all résumés: a row per job description and résumé.
    """
    check_top_k(top_k)
    settings = settings or combined_settings()
    if vocabulary is None:
        _, resume_vectors, job_vectors = fit_combined(resumes, "doc_id", jobs, "query_id", settings, lexicon)
    else:
        resume_vectors = sparse_vectors(resumes, "doc_id", "text", vocabulary, settings, lexicon=lexicon)
        job_vectors = sparse_vectors(jobs, "query_id", "text", vocabulary, settings, lexicon=lexicon)
    return search_top_k(stage(job_vectors, "vectors"), resume_vectors, top_k or max(resumes.count(), 1))


def rank_resumes_dense(job_vectors: DataFrame, resume_vectors: DataFrame, top_k: int | None = 10) -> DataFrame:
    """The same by inner product of unit embeddings."""
    check_top_k(top_k)
    return search_top_k(job_vectors, resume_vectors, top_k or max(resume_vectors.count(), 1))


def rank_requests(requests: DataFrame, resumes: DataFrame, top_k: int | None = None,
                  vocabulary: DataFrame | None = None, settings: TfidfSettings | None = None,
                  lexicon: DataFrame | None = None) -> DataFrame:
    """``request_id, rank, doc_id, score``: each request ranks the résumés it brought along.

    requests  ``request_id, text``;  resumes  ``request_id, doc_id, text``. All rows without ``top_k``.
    """
    check_top_k(top_k)
    scored = score_requests(requests, resumes, vocabulary, settings, lexicon)
    order = [F.desc("score"), F.asc("doc_id")]
    ranked = (rank_all(scored, "request_id", order) if top_k is None
              else rank_top(scored, "request_id", order, top_k, "doc_id"))
    return ranked.select("request_id", "rank", "doc_id", "score")


def score_requests(requests: DataFrame, resumes: DataFrame, vocabulary: DataFrame | None = None,
                   settings: TfidfSettings | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``request_id, doc_id, score`` for every résumé of every request."""
    settings = settings or combined_settings()
    request_tokens = staged_tokens(requests, "request_id", "text", settings, lexicon=lexicon)
    resume_tokens = staged_tokens(resumes, "doc_id", "text", settings, ["request_id"], lexicon)
    if vocabulary is None:
        vocabulary = fit_vocabulary(
            resume_tokens.select("doc_id", "tokens").unionByName(request_tokens), settings)
    return request_scores(stage(tfidf_vectors(request_tokens, vocabulary, settings), "vectors"),
                          tfidf_vectors(resume_tokens, vocabulary, settings, ["request_id"]))


def match_all(resumes: DataFrame, jobs: DataFrame, top_k: int = 5, settings: TfidfSettings | None = None,
              lexicon: DataFrame | None = None) -> DataFrame:
    """``resume_id, rank, job_id, score``: the best jobs of every résumé, titles not considered.

    resumes  ``resume_id, text``;  jobs  ``job_id, text``; one shared vocabulary over both.
    """
    _, resume_vectors, job_vectors = fit_combined(resumes, "resume_id", jobs, "job_id",
                                                  settings or base_settings(), lexicon)
    found = search_top_k(stage(resume_vectors, "vectors"), job_vectors, top_k)
    return found.select(F.col("query_id").alias("resume_id"), "rank", F.col("doc_id").alias("job_id"),
                        F.round("score", 4).alias("score"))


def match_debug(jobs: DataFrame, resumes: DataFrame, top_k: int, preview: int = 1000,
                settings: TfidfSettings | None = None) -> DataFrame:
    """Ranking with the beginning of each cleaned query text, for a look at the raw scores."""
    ranked = rank_resumes(jobs, resumes, top_k, settings=settings)
    previews = jobs.select("query_id", F.substring(clean_text(F.col("text")), 1, preview).alias("preview"))
    return previews.join(ranked, "query_id").select("query_id", "preview", "rank", "doc_id", "score")


def text_previews(df: DataFrame, id_column: str, text_column: str, n: int = 3, length: int = 300) -> DataFrame:
    """The beginning of the first ``n`` cleaned texts, for a look at what is ranked."""
    preview = F.substring(clean_text(F.col(text_column)), 1, length).alias("preview")
    return df.orderBy(id_column).limit(n).select(id_column, preview)


def responses(queries: DataFrame, ranked: DataFrame, label: str, available: int,
              top_k: int) -> DataFrame:
    """``query_id, matches, message``: one answer per query, at most ``top_k`` matches each, perhaps none.

    ``label`` names the column of ``ranked`` that is shown: the title, or the document.
    """
    k, message = effective_top_k(top_k, available)
    entry = F.struct("rank", F.col(label).alias("label"), F.col("score").alias("match_score"))
    grouped = (ranked.where(F.col("rank") <= k).groupBy("query_id")
               .agg(F.sort_array(F.collect_list(entry)).alias("matches")))
    none = F.array().cast(grouped.schema["matches"].dataType)
    return (queries.select("query_id").join(grouped, "query_id", "left")
            .withColumn("matches", F.coalesce("matches", none)).withColumn("message", F.lit(message)))


def embed_column(df: DataFrame, column: str, encoder: Callable, new_column: str = "embedding") -> DataFrame:
    """Unit embeddings of a text column; nulls count as ''.

    ``encoder`` maps a text column to a vector column: a pandas UDF, or any column function.
    """
    encoded = df.withColumn(new_column, encoder(F.coalesce(F.col(column), F.lit(""))))
    return l2_normalize(encoded, new_column)


def semantic_vectors(df: DataFrame, id_column: str, text_column: str, encoder: Callable,
                     keep: list[str] | None = None) -> DataFrame:
    """``doc_id, embedding``: light cleaning, then the encoder; a written table for the dense rankings."""
    cleaned = df.select(F.col(id_column).alias("doc_id"), *(keep or []),
                        clean_text_semantic(F.col(text_column)).alias("_text"))
    return stage(embed_column(cleaned, "_text", encoder).drop("_text"), "embeddings")


__all__ = ["best_titles", "effective_top_k", "embed_column", "fit_combined", "match_all", "match_debug",
           "match_titles", "match_titles_dense", "rank_requests", "responses", "rank_resumes", "rank_resumes_dense",
           "score_requests", "semantic_vectors", "sparse_vectors", "text_previews",
           "titles_available"]

"""Every operator bound to the given tables: name -> (session, folder) -> DataFrame.

jobs and résumés are ``documents`` (``source`` is the title), the other side is ``benchmark``;
dense vectors are ``embeddings`` with ``label`` as the title.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions import text as tx
from rankloom.functions.vectors import hashed_words, inner_product, l2_normalize, mean_pooling
from rankloom.functions.words import ENGLISH_STOP_WORDS
from rankloom.operators import (cells, heavy, inverted, lemmas, masking, ranking, sampling, search, selfjoin, statistics, subwords, tagging, tfidf,
                                upkeep, wordmodel)
from rankloom.plans import corpus, matching, report
from rankloom.sources import artifacts, documents as files, tables, versions
from rankloom.staging import stage, staging_path
from rankloom.streaming.scoring import score_stream
from rankloom.streaming.standing import current_standings, follow_standings, standing_top_k

K = 10
SEED = 42
TOKENIZER = os.environ.get("RANKLOOM_TOKENIZER", "/opt/tokenizers/word_bpe_49k.json")
TOKENIZER_START, TOKENIZER_END = "<|startoftext|>", "<|endoftext|>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark, folder):
    return table(spark, folder, "documents")


def _texts(spark, folder):
    """Documents for work that is heavy per row."""
    return tables.spread(_documents(spark, folder))


def _resumes(spark, folder):
    return _texts(spark, folder).select("doc_id", "text")


def _jobs(spark, folder):
    return _texts(spark, folder).select(F.col("doc_id").alias("job_id"), F.col("source").alias("title"), "text")


def _items(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _dense(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("title"))


def _cleaned(spark, folder, **flags):
    return _texts(spark, folder).select("doc_id", tx.clean_text(F.col("text"), **flags).alias("text_cleaned"))


def _tokens(spark, folder):
    """Tokens of the cleaned documents, no second stop list."""
    return tfidf.token_table(_texts(spark, folder), "doc_id", tx.clean_text(F.col("text")), ascii_only=True)


# --- sources and sinks

def load_resumes(spark, folder):
    path = staging_path(spark, "resumes-csv")
    tables.write_csv(_documents(spark, folder).select(
        "doc_id", F.col("lang").alias("Category"), F.col("text").alias("Resume_str")), path)
    return tables.load_resumes(spark, path)


def load_jobs_sampled(spark, folder):
    path = staging_path(spark, "jobs-csv")
    tables.write_csv(_documents(spark, folder).select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("Job Title"),
        F.col("text").alias("Job Description")), path)
    return tables.load_jobs(spark, path, sample_size=100, seed=SEED, id_column="job_id")


def job_titles(spark, folder):
    path = staging_path(spark, "titles-csv")
    tables.write_csv(_documents(spark, folder).select(F.col("source").alias("title")), path)
    return tables.load_job_titles(spark, path)


def read_through_clean(spark, folder):
    path = staging_path(spark, "cleaned")
    load = lambda: _resumes(spark, folder)
    tables.load_or_clean(spark, path, load)
    return tables.load_or_clean(spark, path, load).select("doc_id", "text_cleaned")


def vocab_roundtrip(spark, folder):
    settings = tfidf.base_settings()
    tokens = tfidf.staged_tokens(_texts(spark, folder), "doc_id", "text", settings)
    path = artifacts.save_vocabulary(tfidf.fit_vocabulary(tokens, settings), staging_path(spark, "saved-vocabulary"))
    return _vocabulary_columns(artifacts.load_vocabulary(spark, path))


def weights_roundtrip(spark, folder):
    settings = tfidf.base_settings()
    vectors, vocabulary = tfidf.fit_transform(_resumes(spark, folder), "doc_id", "text", settings)
    path = artifacts.save_vectors(vectors, staging_path(spark, "saved-vectors"))
    terms = tfidf.vectors_as_terms(artifacts.load_vectors(spark, path), vocabulary)
    return terms.select("doc_id", "term", F.round("w", 6).alias("w"))


def clean_and_cache(spark, folder):
    raw = staging_path(spark, "raw-csv")
    tables.write_csv(_texts(spark, folder).select(
        F.col("lang").alias("Category"), F.col("text").alias("Resume_str")), raw)
    prepared = corpus.prepare_resumes(spark, raw, staging_path(spark, "prepared"), staging_path(spark, "saved"), 1)
    return prepared.select("role", "text_cleaned")


def embedding_index(spark, folder):
    path = artifacts.save_embeddings(_dense(spark, folder), staging_path(spark, "saved-embeddings"))
    return artifacts.load_embeddings(spark, path).select(F.col("doc_id").alias("vec_id"), "dim", "title")


def versioned_save(spark, folder):
    base = staging_path(spark, "versions")
    cleaned = stage(_cleaned(spark, folder), "cleaned")
    for version in ("20240101000000", "20240201000000", "20240301000000"):
        versions.save_version(cleaned, base, max_versions=2, version=version)
    return (spark.read.parquet(base).groupBy(F.col("version").cast("string").alias("version"))
            .agg(F.count("*").alias("n_rows")))


def version_retention(spark, folder):
    days = table(spark, folder, "events").select(F.date_format("ts", "yyyyMMdd").alias("version")).distinct()
    return versions.versions_to_keep(days, 2)


def version_label(spark, folder):
    return table(spark, folder, "events").select("event_id", versions.version_label(F.col("ts")).alias("label"))


def bulk_load_documents(spark, folder):
    path = staging_path(spark, "files")
    # One document per file is what is read.
    files.write_text_files(_documents(spark, folder), "text", path)
    loaded, _ = files.bulk_load(spark, path)
    return loaded.select(tx.file_extension(F.col("filename")).alias("type"), "text")


def docx_documents(spark, folder):
    """Documents as a written table of .docx files, loaded from it."""
    written = stage(files.as_docx(_texts(spark, folder), "doc_id", "text"), "docx")
    return files.load_file_table(written)[0]


def corpus_lines(spark, folder):
    lines = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return tables.strip_lines(lines, "raw").select("conv_id", "turn", F.col("line_no").cast("long").alias("line_no"),
                                                   "line")


def corpus_lines_file(spark, folder):
    path = staging_path(spark, "lines")
    table(spark, folder, "conversations").select("text").write.text(path)
    return tables.load_corpus_lines(spark, path)


# --- rows and text

def dropna_any(spark, folder):
    return (_resumes(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
            .select("doc_id", "text", F.col("quality").cast("long").alias("quality")).dropna(how="any"))


def fill_null_text(spark, folder):
    withheld = (_resumes(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
                .select("doc_id", F.when(F.coalesce("toxic", F.lit(0)) == 0, F.col("text")).alias("text")))
    return withheld.fillna("", ["text"])


def clean_text(spark, folder):
    return _cleaned(spark, folder)


def clean_text_keep_numbers(spark, folder):
    return _cleaned(spark, folder, remove_numbers=False)


def clean_text_keep_stopwords(spark, folder):
    return _cleaned(spark, folder, remove_stopwords=False)


def clean_column(spark, folder):
    return tx.clean_column(_resumes(spark, folder), "text").select("doc_id", "text_cleaned")


def clean_text_semantic(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", tx.clean_text_semantic(F.col("html")).alias("text_cleaned"))


def _positions(tokens: DataFrame) -> DataFrame:
    return (tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
            .withColumn("pos", F.col("pos").cast("long")))


def tokenize(spark, folder):
    return _positions(_tokens(spark, folder))


def remove_stopwords(spark, folder):
    raw = tx.whitespace_words(F.lower(F.col("text")))
    return _positions(_texts(spark, folder).select(
        "doc_id", tx.remove_stop_words(raw, ENGLISH_STOP_WORDS).alias("tokens")))


def ngrams(spark, folder):
    return tfidf.term_counts(_tokens(spark, folder), (1, 2))


def sanitize_label(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.sanitize_label(F.col("url")).alias("label"))


def _lexicon(spark, folder):
    counts = stage(statistics.word_counts(_cleaned(spark, folder), "text_cleaned"), "word-counts")
    return lemmas.build_lexicon(counts)


def build_lemma_dict(spark, folder):
    return _lexicon(spark, folder)


def lemmatize_lookup(spark, folder):
    lexicon = stage(_lexicon(spark, folder), "lexicon")
    return (lemmas.clean_and_lemmatize(_texts(spark, folder), "doc_id", "text", lexicon)
            .withColumnRenamed("text_cleaned", "text_lemmatized"))


# --- TF-IDF

def term_stats(spark, folder):
    return tfidf.term_stats(_tokens(spark, folder), (1, 2))


def term_counts(spark, folder):
    return tfidf.term_counts(_tokens(spark, folder), (1, 1))


def _vocabulary_columns(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select("term", "df", "tf", F.round("idf", 6).alias("idf"))


def tfidf_vocab(spark, folder):
    settings = tfidf.base_settings()
    tokens = tfidf.staged_tokens(_texts(spark, folder), "doc_id", "text", settings)
    return _vocabulary_columns(tfidf.fit_vocabulary(tokens, settings))


def tfidf_vocab_combined(spark, folder):
    settings = tfidf.combined_settings()
    both = (_resumes(spark, folder).toDF("id", "text")
            .unionByName(table(spark, folder, "benchmark").toDF("id", "text")))
    return _vocabulary_columns(tfidf.fit_vocabulary(tfidf.staged_tokens(both, "id", "text", settings), settings))


def _transformed(spark, folder, settings):
    vectors, vocabulary = tfidf.fit_transform(_resumes(spark, folder), "doc_id", "text", settings)
    return tfidf.vectors_as_terms(vectors, vocabulary).select("doc_id", "term", F.round("w", 6).alias("w"))


def tfidf_transform(spark, folder):
    return _transformed(spark, folder, tfidf.base_settings())


def tfidf_transform_sublinear(spark, folder):
    return _transformed(spark, folder, tfidf.combined_settings())


# --- matching

def _requests(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Every document is sent to one of the job descriptions, as the résumés of that request."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    resumes = _resumes(spark, folder).withColumn("request_id", F.pmod("doc_id", F.lit(items.count())))
    return items, resumes


def sparse_cosine_full(spark, folder):
    scored = matching.score_requests(*_requests(spark, folder))
    return scored.select(F.col("request_id").alias("item_id"), "doc_id", "score")


def sparse_cosine(spark, folder):
    return sparse_cosine_full(spark, folder).where(F.col("score") > 0)


def recruiter_request_rank(spark, folder):
    ranked = matching.rank_requests(*_requests(spark, folder))
    return ranked.select(F.col("request_id").alias("item_id"), "rank", "doc_id", "score")


def recruiter_tfidf_rank(spark, folder):
    ranked = matching.rank_resumes(_items(spark, folder), _resumes(spark, folder), K)
    return ranked.withColumnRenamed("query_id", "item_id")


def attach_title(spark, folder):
    ranked = recruiter_tfidf_rank(spark, folder).withColumnRenamed("doc_id", "job_id")
    titles = _jobs(spark, folder).select("job_id", "title")
    return ranking.attach_title(ranked, titles, "job_id").select("item_id", "job_id", "title", "score")


def applicant_tfidf_topk(spark, folder):
    found = matching.match_titles(_items(spark, folder), _jobs(spark, folder), K)
    return found.withColumnRenamed("query_id", "item_id")


def applicant_response(spark, folder):
    items, jobs = _items(spark, folder), _jobs(spark, folder)
    answers = matching.responses(items, matching.match_titles(items, jobs, K), "title",
                                 matching.titles_available(jobs), K)
    titles = F.array_join(F.transform("matches", lambda m: m["label"]), " | ")
    return answers.select(F.col("query_id").alias("item_id"), titles.alias("titles"), "message")


def batch_top5(spark, folder):
    jobs = table(spark, folder, "benchmark").select(F.col("item_id").alias("job_id"), "text")
    return matching.match_all(_resumes(spark, folder).withColumnRenamed("doc_id", "resume_id"), jobs, 5)


def match_debug(spark, folder):
    found = matching.match_debug(_items(spark, folder), _resumes(spark, folder), K)
    return found.withColumnRenamed("query_id", "item_id")


def text_previews(spark, folder):
    return matching.text_previews(_documents(spark, folder).select("doc_id", "text"), "doc_id", "text", 3, 300)


def topk_message(spark, folder):
    available = matching.titles_available(_jobs(spark, folder))
    asked = table(spark, folder, "benchmark").select(
        "item_id", F.explode(F.array(F.lit(None), F.lit(5), F.lit(1_000_000)).cast("array<bigint>")).alias("k"))
    return (asked.withColumn("available", F.lit(available).cast("long"))
            .withColumn("message", ranking.top_k_message(F.col("k"), F.col("available"))))


def clip_scores(spark, folder):
    own = inner_product(F.col("embedding"), F.col("embedding"))
    return _dense(spark, folder).select(F.col("doc_id").alias("vec_id"),
                                        F.round(ranking.clip_score(own), 6).alias("match_score"))


def similarity_stats(spark, folder):
    _, resumes, items = matching.fit_combined(_resumes(spark, folder), "doc_id", _items(spark, folder), "query_id",
                                              tfidf.combined_settings())
    return search.similarity_summary(stage(items, "vectors"), resumes).withColumn("mean", F.round("mean", 9))


# --- dense vectors

def dense_inner_product(spark, folder):
    """Every vector with every vector, whatever the score."""
    vectors = _dense(spark, folder)
    found = search.all_scores(vectors, vectors)
    return found.select("query_id", F.col("doc_id").alias("vec_id"), "score")


def recruiter_dense_rank(spark, folder):
    vectors = _dense(spark, folder)
    return matching.rank_resumes_dense(vectors, vectors, K).withColumnRenamed("doc_id", "vec_id")


def applicant_dense_topk(spark, folder):
    vectors = _dense(spark, folder)
    return matching.match_titles_dense(vectors, vectors, 5).withColumnRenamed("job_id", "vec_id")


def applicant_dense_cells(spark, folder):
    """``applicant_dense_topk`` by a written index that passes over cells and rings of vectors."""
    vectors = _dense(spark, folder)
    index = cells.open_cells(spark, search.save_cells(vectors, staging_path(spark, "cells"), with_title=True))
    found = search.top_k_in_cells(vectors, index, vectors.schema["doc_id"].dataType, 5, one_per_title=True)
    return found.withColumnRenamed("doc_id", "vec_id")


def _by_dimension(vectors: DataFrame) -> DataFrame:
    return (vectors.select(F.col("doc_id").alias("vec_id"), F.posexplode("embedding").alias("dim", "value"))
            .select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")))


def l2_normalize_vectors(spark, folder):
    scaled = _dense(spark, folder).withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") * 3.0))
    return _by_dimension(l2_normalize(scaled, "embedding"))


def mean_pooling_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings").withColumn("label", F.col("label").cast("long"))
    return (mean_pooling(vectors, "label", "embedding", (F.col("embedding")[0] >= 0).cast("int"))
            .withColumn("value", F.round("value", 6)))


# --- statistics

def distinct_titles(spark, folder):
    return statistics.distinct_titles(_documents(spark, folder), "source")


def category_counts(spark, folder):
    return statistics.category_counts(_documents(spark, folder), "lang", 5)


def word_frequency(spark, folder):
    return statistics.word_frequency(_cleaned(spark, folder), "text_cleaned", 30)


def word_weights(spark, folder):
    weights = statistics.word_weights(_cleaned(spark, folder), "text_cleaned")
    return weights.withColumn("weight", F.round("weight", 9))


def doc_length(spark, folder):
    return _documents(spark, folder).select("doc_id", statistics.document_length(F.col("text")).alias("n_words"))


def length_histogram(spark, folder):
    bins = statistics.length_histogram(_documents(spark, folder), "text", 30)
    return bins.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "cnt")


def top_words_by_category(spark, folder):
    cleaned = _texts(spark, folder).select("lang", tx.clean_text(F.col("text")).alias("text_cleaned"))
    return statistics.top_words_by_category(cleaned, "text_cleaned", "lang", 5, 10,
                                            tfidf.base_settings().stop_words)


def pairwise_similarity(spark, folder):
    return report.pairwise_similarity(_cleaned(spark, folder), "doc_id", "text_cleaned", 100, 100)


# --- corpora

def stratified_sample(spark, folder):
    jobs = _jobs(spark, folder)
    return sampling.stratified_sample(jobs, "job_id", 200, SEED).select("title", "job_id")


def stratified_summary(spark, folder):
    """``stratified_sample`` by mergeable summaries."""
    return sampling.stratified_summary(_jobs(spark, folder), "job_id", 200, SEED)


def combined_corpus(spark, folder):
    resumes = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("id"), tx.clean_text(F.col("text")).alias("text_cleaned"))
    jobs = _jobs(spark, folder).select("job_id", "title", tx.clean_text(F.col("text")).alias("text_cleaned"))
    return corpus.combined_corpus(resumes, jobs, 200, SEED)[0]


def train_val_split(spark, folder):
    return sampling.train_validation_split(_documents(spark, folder).select("doc_id"), "doc_id", 0.1, SEED)


def pad_truncate(spark, folder):
    padded = _tokens(spark, folder).select("doc_id", masking.pad_or_truncate(F.col("tokens")).alias("padded"))
    return (padded.select("doc_id", F.posexplode("padded").alias("pos", "t"))
            .select("doc_id", F.col("pos").cast("long").alias("pos"), "t.token", "t.mask"))


def subword_pad(spark, folder):
    """Documents as model inputs of 256 ids, in pieces of a public vocabulary."""
    ids = subwords.collect_pieces(subwords.read_pieces(spark, TOKENIZER))
    marks = subwords.collect_pieces(subwords.read_marks(spark, TOKENIZER))
    start, end = marks[TOKENIZER_START], marks[TOKENIZER_END]
    pieces = subwords.Pieces(ids, unknown=end, pad=end, first=start, last=end, inside="", end="</w>")
    encoded = subwords.encode_words(_tokens(spark, folder).select("doc_id", "tokens"), pieces)
    return (encoded.select("doc_id", "n_pieces", F.posexplode(F.arrays_zip("input_ids", "attention_mask")).alias("pos", "t"))
            .select("doc_id", "n_pieces", F.col("pos").cast("long").alias("pos"), F.col("t.input_ids").cast("long").alias("id"),
                    F.col("t.attention_mask").cast("long").alias("mask")))


def mlm_mask(spark, folder):
    settings = tfidf.base_settings(ngram_range=(1, 1), stop_words=None)
    tokens = tfidf.staged_tokens(_texts(spark, folder), "doc_id", "text", settings)
    return masking.mask_tokens(tokens, tfidf.fit_vocabulary(tokens, settings), 0.15, 256, SEED)


def mlm_corpus(spark, folder):
    lines = _texts(spark, folder).select("doc_id", F.col("text").alias("line"))
    settings = tfidf.base_settings(ngram_range=(1, 1), stop_words=None)
    return corpus.masked_corpus(lines, settings, 0.1, 256, 0.15, SEED)


def mlm_prepared_lines(spark, folder):
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    settings = tfidf.base_settings(ngram_range=(1, 1), stop_words=None)
    return corpus.prepare_corpus(turns, "id", "text", settings, 0.1, 256, 0.15, SEED)


def embed_text(spark, folder):
    vectors = matching.semantic_vectors(_texts(spark, folder), "doc_id", "text", hashed_words())
    return _by_dimension(vectors).withColumnRenamed("vec_id", "doc_id")


def recruiter_text_dense(spark, folder):
    jobs = matching.semantic_vectors(_items(spark, folder), "query_id", "text", hashed_words())
    resumes = matching.semantic_vectors(_resumes(spark, folder), "doc_id", "text", hashed_words())
    return matching.rank_resumes_dense(jobs, resumes, K).withColumnRenamed("query_id", "item_id")


def applicant_text_dense(spark, folder):
    resumes = matching.semantic_vectors(_items(spark, folder), "query_id", "text", hashed_words())
    jobs = matching.semantic_vectors(_jobs(spark, folder), "job_id", "text", hashed_words(), ["title"])
    return matching.match_titles_dense(resumes, jobs, K).withColumnRenamed("query_id", "item_id")


DOMAIN_MODEL = wordmodel.WordModelSettings(max_words=20_000, dim=64, rounds=2)


def domain_embedding_rank(spark, folder):
    """Documents by embeddings that are trained on the texts of both sides."""
    ranked = corpus.learnt_domain_ranking(_items(spark, folder), _resumes(spark, folder), K, DOMAIN_MODEL)
    return ranked.withColumnRenamed("query_id", "item_id")


def normalize_nfkc(spark, folder):
    # The pages hold no character that NFKC changes, so each gets some of every kind around its whole text.
    widened = F.concat(F.lit("ﬁ½Ａ"), F.coalesce("html", F.lit("")), F.lit("Ⅳ①㎏ｶﾞ"))
    return table(spark, folder, "pages").select("page_id", tx.normalize_nfkc(widened).alias("text_normalized"))


def recruiter_lemma_rank(spark, folder):
    lexicon = stage(_lexicon(spark, folder), "lexicon")
    ranked = matching.rank_resumes(_items(spark, folder), _resumes(spark, folder), K, lexicon=lexicon)
    return ranked.withColumnRenamed("query_id", "item_id")


def applicant_lemma_topk(spark, folder):
    lexicon = stage(_lexicon(spark, folder), "lexicon")
    found = matching.match_titles(_items(spark, folder), _jobs(spark, folder), K, lexicon=lexicon)
    return found.withColumnRenamed("query_id", "item_id")


def recruiter_response(spark, folder):
    items, resumes = _items(spark, folder), _resumes(spark, folder)
    answers = matching.responses(items, matching.rank_resumes(items, resumes, K), "doc_id", resumes.count(), K)
    found = F.array_join(F.transform("matches", lambda m: m["label"].cast("string")), " | ")
    return answers.select(F.col("query_id").alias("item_id"), found.alias("documents"), "message")


def clean_and_cache_jobs(spark, folder):
    raw = staging_path(spark, "jobs-csv")
    tables.write_csv(_documents(spark, folder).select(
        "doc_id", F.col("source").alias("Job Title"), F.col("text").alias("Job Description")), raw)
    prepared = corpus.prepare_jobs(spark, raw, staging_path(spark, "prepared-jobs"), _items(spark, folder), "doc_id")
    return prepared.select("doc_id", "title", "text_cleaned")


def stream_score(spark, folder):
    settings = tfidf.combined_settings()
    vocabulary, resumes, _ = matching.fit_combined(_resumes(spark, folder), "doc_id", _items(spark, folder),
                                                   "query_id", settings)
    items = (spark.readStream.schema(table(spark, folder, "benchmark").schema)
             .parquet(f"{folder}/benchmark.parque[t]")
             .select(F.col("item_id").alias("query_id"), "text"))
    output = staging_path(spark, "stream")
    score_stream(items, stage(resumes, "vectors"), vocabulary, settings, K, output, staging_path(spark, "stream-state")
                 ).awaitTermination()
    return (spark.read.parquet(output).drop("batch_id").withColumnRenamed("query_id", "item_id")
            .select("item_id", "rank", "doc_id", "score"))


def similarity_join(spark, folder):
    return selfjoin.similarity_join(_tokens(spark, folder), 0.8)


WORD_MODEL = wordmodel.WordModelSettings(max_words=5000, dim=64)


def word_information(spark, folder):
    """Per word how many others stand near it, how often, and what they tell about it."""
    tokens = stage(_tokens(spark, folder), "tokens")
    words = wordmodel.word_table(tokens, WORD_MODEL)
    counts = stage(wordmodel.cooccurrences(tokens, words, WORD_MODEL.window), "cooccurrences")
    values = wordmodel.positive_information(counts).groupBy("a").agg(
        F.count("*").alias("n_neighbours"), F.sum("n").alias("n_pairs"), F.round(F.sum("value"), 6).alias("information"))
    return values.join(words, values["a"] == words["word_id"]).select("word", "n_neighbours", "n_pairs", "information")


def learnt_embedding_rank(spark, folder):
    """Documents by embeddings that are learnt from them."""
    tokens = stage(_tokens(spark, folder), "tokens")
    encoder = wordmodel.word_encoder(wordmodel.fit_word_model(tokens, WORD_MODEL))
    words = lambda df, key: df.select(key, tx.clean_text(F.col("text")).alias("text"))
    jobs = matching.semantic_vectors(words(_items(spark, folder), "query_id"), "query_id", "text", encoder)
    resumes = matching.semantic_vectors(words(_resumes(spark, folder), "doc_id"), "doc_id", "text", encoder)
    return matching.rank_resumes_dense(jobs, resumes, K).withColumnRenamed("query_id", "item_id")


def indexed_tfidf_rank(spark, folder):
    """``recruiter_tfidf_rank`` by a written index that skips blocks of documents."""
    _, resumes, jobs = matching.fit_combined(_resumes(spark, folder), "doc_id", _items(spark, folder), "query_id",
                                             tfidf.combined_settings())
    index = inverted.load_index(spark, inverted.save_index(resumes, staging_path(spark, "inverted")))
    return inverted.search_index(stage(jobs, "vectors"), index, K).withColumnRenamed("query_id", "item_id")


def vocab_upkeep(spark, folder):
    """The vocabulary after documents in one language came and those in another went."""
    settings = tfidf.base_settings()
    tokens = stage(tfidf.token_table(_texts(spark, folder), "doc_id", tx.clean_text(F.col("text")), settings.stop_words, ["lang"],
                                     True), "tokens")
    path, language = staging_path(spark, "upkeep"), F.coalesce("lang", F.lit(""))
    upkeep.append_change(upkeep.term_change(tokens.where(language != "en"), settings), path, "1")
    upkeep.append_change(upkeep.term_change(tokens.where(language == "en"), settings), path, "2")
    upkeep.append_change(upkeep.term_change(tokens.where(language == "fr"), settings, -1), path, "3")
    upkeep.compact(spark, path)
    return _vocabulary_columns(upkeep.refit_vocabulary(spark, path, settings))


def stream_standing_topk(spark, folder):
    """``recruiter_tfidf_rank`` with the documents as a stream of several micro-batches."""
    settings = tfidf.combined_settings()
    vocabulary, _, items = matching.fit_combined(_resumes(spark, folder), "doc_id", _items(spark, folder), "query_id",
                                                 settings)
    arriving = staging_path(spark, "arriving")
    _resumes(spark, folder).write.parquet(arriving)
    documents = (spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 4).parquet(arriving))
    output = staging_path(spark, "standings")
    standings = standing_top_k(documents, stage(items, "vectors"), vocabulary, settings, K)
    follow_standings(standings, output, staging_path(spark, "standing-state")).awaitTermination()
    return current_standings(spark, output).withColumnRenamed("query_id", "item_id")


def explore_report(spark, folder):
    """The whole exploratory report: ``benchmark`` as résumés, ``documents`` with their languages as jobs."""
    resumes = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), tx.clean_text(F.col("text")).alias("text_cleaned"))
    jobs = _texts(spark, folder).select(F.col("doc_id").alias("job_id"), F.col("lang").alias("title"),
                                        tx.clean_text(F.col("text")).alias("text_cleaned"))
    return report.report_rows(report.explore(resumes, jobs))


def heavy_words(spark, folder):
    """``word_frequency`` by summaries of bounded size."""
    return heavy.heavy_words(_cleaned(spark, folder), "text_cleaned", 30)


def tagged_lemmas(spark, folder):
    """Lemmas by the part of speech that each word has in its text."""
    words = stage(_texts(spark, folder).select("doc_id", tx.clean_tokens(F.col("text")).alias("words")), "words")
    counts = stage(tagging.list_counts(words), "word-counts")
    lexicon = stage(lemmas.build_lexicon(counts), "lexicon")
    model = tagging.fit_tagger(words, tagging.tag_dictionary(lexicon), counts=counts)
    return tagging.tag_and_lemmatize_words(words, "doc_id", "words", lexicon, model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        load_resumes, load_jobs_sampled, job_titles, read_through_clean, vocab_roundtrip, weights_roundtrip,
        embedding_index, clean_and_cache,
        versioned_save, version_retention, version_label, bulk_load_documents, corpus_lines, corpus_lines_file,
        dropna_any, fill_null_text, clean_text, clean_text_keep_numbers, clean_text_keep_stopwords, clean_column,
        clean_text_semantic, tokenize, remove_stopwords, ngrams, sanitize_label, build_lemma_dict,
        lemmatize_lookup, term_stats, term_counts, tfidf_vocab, tfidf_vocab_combined, tfidf_transform,
        tfidf_transform_sublinear, sparse_cosine, sparse_cosine_full, recruiter_request_rank,
        recruiter_tfidf_rank, attach_title, applicant_tfidf_topk, applicant_response, batch_top5, match_debug, text_previews, topk_message,
        clip_scores, similarity_stats, dense_inner_product, recruiter_dense_rank, applicant_dense_topk,
        distinct_titles, category_counts, word_frequency, word_weights, doc_length, length_histogram,
        top_words_by_category, pairwise_similarity, stratified_sample, combined_corpus, train_val_split,
        pad_truncate, mlm_mask, mlm_corpus, embed_text, domain_embedding_rank, stream_score,
        recruiter_text_dense, applicant_text_dense, normalize_nfkc, recruiter_lemma_rank, applicant_lemma_topk,
        recruiter_response, clean_and_cache_jobs, mlm_prepared_lines, similarity_join, word_information,
        learnt_embedding_rank, indexed_tfidf_rank, vocab_upkeep, stream_standing_topk, heavy_words, tagged_lemmas,
        explore_report, stratified_summary, applicant_dense_cells, docx_documents, subword_pad)}
QUERIES["l2_normalize"] = l2_normalize_vectors
QUERIES["mean_pooling"] = mean_pooling_vectors

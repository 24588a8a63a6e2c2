"""TF-IDF as relations: token tables, a fitted vocabulary table and sparse vectors.

tokens      <doc_id, tokens array<string>>
vocabulary  <term, term_id int, df, tf, idf>          at most ``max_features`` rows
vectors     <doc_id, term_ids array<int>, weights array<double>>, one row per document, unit length
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rankloom.functions.text import clean_text, clean_tokens, ngrams, tokenize
from rankloom.functions.words import VECTORIZER_STOP_WORDS
from rankloom.operators.grams import gram_rows, gram_totals, gram_vectors
from rankloom.operators.joins import fits_broadcast, join_lookup
from rankloom.operators.lemmas import lemma_words
from rankloom.staging import stage


@dataclass(frozen=True)
class TfidfSettings:
    """How text becomes weighted terms; ``max_df`` is a share of the documents, ``min_df`` a count."""

    max_features: int = 5000
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 3
    max_df: float = 0.85
    sublinear_tf: bool = False
    stop_words: tuple[str, ...] | None = VECTORIZER_STOP_WORDS

    def with_(self, **changes) -> TfidfSettings:
        return replace(self, **changes)


def base_settings(**changes) -> TfidfSettings:
    return TfidfSettings().with_(**changes)


def combined_settings(**changes) -> TfidfSettings:
    """For one vocabulary over both kinds of documents."""
    return TfidfSettings(max_features=40_000, min_df=5, sublinear_tf=True).with_(**changes)


def token_table(df: DataFrame, id_column: str, text: Column, stop_words: Sequence[str] | None = None,
                keep: Sequence[str] = (), ascii_only: bool = False) -> DataFrame:
    """``doc_id, tokens`` (and the ``keep`` columns). Null text counts as ''.

    ``ascii_only`` promises that the text holds nothing else, as cleaned text does.
    """
    tokens = tokenize(F.coalesce(text, F.lit("")), stop_words, ascii_only)
    return df.select(F.col(id_column).alias("doc_id"), *keep, tokens.alias("tokens"))


def staged_tokens(df: DataFrame, id_column: str, text_column: str, settings: TfidfSettings,
                  keep: Sequence[str] = (), lexicon: DataFrame | None = None) -> DataFrame:
    """Clean and tokenize once and write the result: fit and transform both read it.

    With a lexicon ``word, pos, lemma`` cleaning ends with lemmatization, every word being a noun.
    """
    text = clean_text(F.col(text_column))
    if lexicon is not None:
        df = lemma_words(df, clean_tokens(F.col(text_column)), lexicon)
        text = F.array_join("_words", " ")
    return stage(token_table(df, id_column, text, settings.stop_words, keep, True), "tokens")


def term_stats(tokens: DataFrame, ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """``term, df, tf``: documents holding the term, and its total count; only term totals are shuffled."""
    return _totals(tokens, *ngram_range)


def term_counts(tokens: DataFrame, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """``doc_id, term, tf``, counted row by row where the documents lie, without a shuffle."""
    rows = tokens.select("doc_id", "tokens")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: gram_rows(batches, *ngram_range), f"doc_id {kind}, term string, tf bigint")


def candidate_stats(tokens: DataFrame, settings: TfidfSettings, n_docs: int) -> DataFrame:
    """``term, df, tf`` of every term that can enter the vocabulary, and perhaps of some that cannot.

    An n-gram is no more frequent than its rarest word. With single words counted first, the
    ``max_features``-th of them sets a bar that every word of a useful n-gram must reach, so the many
    n-grams around rare words are dropped inside the tasks, before anything is shuffled.
    """
    low, high = settings.ngram_range
    words = stage(_totals(tokens, 1, 1), "words")
    if high == 1:
        return words
    bar = 1
    if low == 1:
        top = (words.where(_within(settings, n_docs)).orderBy(F.desc("tf")).limit(settings.max_features)
               .agg(F.min("tf"), F.count("*")).first())
        bar = top[0] if top[1] == settings.max_features else 1
    useful = words.where((F.col("tf") >= bar) & (F.col("df") >= settings.min_df)).select("term")
    held = None
    if fits_broadcast(useful):
        held = tokens.sparkSession.sparkContext.broadcast(useful.toArrow()["term"].combine_chunks())
    grams = _totals(tokens, max(low, 2), high, held)
    return words.unionByName(grams) if low == 1 else grams


def _totals(tokens: DataFrame, low: int, high: int, held: Broadcast | None = None) -> DataFrame:
    """``term, df, tf``, counted batch by batch and then summed; ``held`` has the allowed words."""
    def count(batches):
        return gram_totals(batches, low, high, None if held is None else held.value.cast("large_string"))

    return (tokens.select("tokens").mapInArrow(count, "term string, df long, tf long")
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")))


def _within(settings: TfidfSettings, n_docs: int) -> Column:
    return (F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * n_docs)


def fit_vocabulary(tokens: DataFrame, settings: TfidfSettings) -> DataFrame:
    """Prune by document frequency, keep the ``max_features`` most frequent terms, attach idf.

    Ties in frequency go to the alphabetically first term. ``tokens`` should be a written table, since it
    is read more than once; the result is one too.
    """
    n_docs = tokens.count()
    kept = (candidate_stats(tokens, settings, n_docs).where(_within(settings, n_docs))
            .orderBy(F.desc("tf"), "term").limit(settings.max_features))
    # max_features bounds this table, so numbering it in one task is safe.
    numbered = kept.withColumn("term_id", F.row_number().over(Window.orderBy("term")) - 1)
    vocabulary = stage(numbered.select(
        "term", "term_id", "df", "tf",
        (F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")), "vocabulary")
    if vocabulary.isEmpty():
        raise ValueError("no terms remain: lower min_df or raise max_df")
    return vocabulary


def tfidf_vectors(tokens: DataFrame, vocabulary: DataFrame, settings: TfidfSettings,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Unit TF-IDF vectors over the vocabulary; a document without known terms keeps an empty one.

    The vocabulary is capped when it is fitted. As long as its measured size allows a broadcast, each document is
    weighed where it lies, without a shuffle.
    """
    if not fits_broadcast(vocabulary):
        return _vectors_by_join(tokens, vocabulary, settings, keep)
    return vectorizer(tokens.sparkSession, vocabulary, settings)(tokens, keep)


def vectorizer(spark: SparkSession, vocabulary: DataFrame,
               settings: TfidfSettings) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """(tokens, keep) to vectors, for many token tables: the vocabulary is broadcast once."""
    table = vocabulary.orderBy("term_id").select("term", "idf").toArrow().combine_chunks()
    held = spark.sparkContext.broadcast(table)
    low, high = settings.ngram_range
    sublinear = settings.sublinear_tf

    def weigh(batches):
        terms = held.value["term"].cast("large_string").combine_chunks()
        return gram_vectors(batches, low, high, sublinear, terms, held.value["idf"].to_numpy())

    def vectors(tokens: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        rows = tokens.select("doc_id", *keep, "tokens")
        schema = T.StructType([rows.schema[c] for c in rows.columns[:-1]]
                              + [T.StructField("term_ids", T.ArrayType(T.IntegerType())),
                                 T.StructField("weights", T.ArrayType(T.DoubleType()))])
        return rows.mapInArrow(weigh, schema)

    return vectors


def _vectors_by_join(tokens: DataFrame, vocabulary: DataFrame, settings: TfidfSettings,
                     keep: Sequence[str]) -> DataFrame:
    """The same for a vocabulary that is too large to broadcast.

    Every row gets a key of its own, so documents may share ids. Unknown terms are dropped at the join, before the
    shuffle that takes (row, term number) pairs to their row.
    """
    rows = stage(tokens.select("doc_id", *keep, "tokens").withColumn("_row", F.monotonically_increasing_id()), "rows")
    exploded = rows.select("_row", F.explode(ngrams(F.col("tokens"), *settings.ngram_range)).alias("term"))
    known = join_lookup(exploded, vocabulary.select("term", "term_id", "idf"), "term", "inner")
    n = F.count("*").cast("double")
    tf = 1.0 + F.log(n) if settings.sublinear_tf else n
    weighted = known.groupBy("_row", "term_id").agg((tf * F.first("idf")).alias("w"))
    vectors = (weighted.groupBy("_row")
               .agg(F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("entries"),
                    F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
               .select("_row", F.transform("entries", lambda e: e["term_id"]).alias("term_ids"),
                       F.transform("entries", lambda e: e["w"] / F.col("norm")).alias("weights")))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return (rows.select("_row", "doc_id", *keep).join(vectors, "_row", "left")
            .select("doc_id", *keep, F.coalesce("term_ids", empty("int")).alias("term_ids"),
                    F.coalesce("weights", empty("double")).alias("weights")))


def vectors_as_terms(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The long form ``doc_id, term, w``."""
    entries = vectors.select("doc_id", F.inline(F.arrays_zip("term_ids", "weights")))
    return (join_lookup(entries.toDF("doc_id", "term_id", "w"), vocabulary.select("term_id", "term"),
                        "term_id", "inner")
            .select("doc_id", "term", "w"))


def fit_transform(df: DataFrame, id_column: str, text_column: str, settings: TfidfSettings,
                  lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary) of the same documents; null text is filled with '' first."""
    tokens = staged_tokens(df, id_column, text_column, settings, lexicon=lexicon)
    vocabulary = fit_vocabulary(tokens, settings)
    return tfidf_vectors(tokens, vocabulary, settings), vocabulary

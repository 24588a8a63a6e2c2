"""Descriptive statistics of text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.text import tokenize, whitespace_words
from rankloom.staging import stage


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """``word, cnt`` over all non-null text."""
    words = df.where(F.col(column).isNotNull()).select(F.explode(whitespace_words(F.col(column))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def word_frequency(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    """The ``n`` most common words; ties go to the alphabetically first."""
    return word_counts(df, column).orderBy(F.desc("cnt"), "word").limit(n)


def word_weights(df: DataFrame, column: str) -> DataFrame:
    """``word, weight``: counts relative to the most common word."""
    return weights_of_words(stage(word_counts(df, column), "word-counts"))


def weights_of_words(counts: DataFrame) -> DataFrame:
    return counts.select("word", (F.col("cnt") / counts.agg(F.max("cnt")).scalar()).alias("weight"))


def category_counts(df: DataFrame, category: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent categories, null excluded."""
    return (df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("cnt"))
            .orderBy(F.desc("cnt"), category).limit(n))


def top_words_by_category(df: DataFrame, text: str, category: str, n_categories: int = 5,
                          n_words: int = 10, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``category, rank, word, cnt`` for the most frequent categories; ties alphabetical."""
    top = F.broadcast(category_counts(df, category, n_categories).select(category))
    words = (df.select(category, text).join(top, category, "left_semi")
             .select(category, F.explode(tokenize(F.col(text), stop_words)).alias("word")))
    counts = words.groupBy(category, "word").agg(F.count("*").alias("cnt"))
    order = Window.partitionBy(category).orderBy(F.desc("cnt"), "word")
    return (counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_words)
            .select(category, F.col("rank").cast("long").alias("rank"), "word", "cnt"))


def text_counts(df: DataFrame, column: str, title: str | None = None) -> DataFrame:
    """``title, word, n_words, cnt``: all that the statistics below need of the texts, by one scan of them; a written table.

    A row with a word says how often it occurs under a title. A row without one says how many texts of that title have
    ``n_words`` words; null texts have none.
    """
    whole = F.struct(F.lit(None).cast("string").alias("word"), document_length(F.col(column)).alias("n_words"))
    words = F.transform(F.coalesce(whitespace_words(F.col(column)), F.array().cast("array<string>")),
                        lambda w: F.struct(w.alias("word"), F.lit(None).cast("long").alias("n_words")))
    titled = F.lit(None).cast("string") if title is None else F.col(title).cast("string")
    return stage(df.select(titled.alias("title"), F.inline(F.concat(F.array(whole), words)))
                 .groupBy("title", "word", "n_words").agg(F.count("*").alias("cnt")), "text-counts")


def words_of(counts: DataFrame) -> DataFrame:
    """``word, cnt`` of ``text_counts``; a written table."""
    return stage(counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("cnt").alias("cnt")), "word-counts")


def lengths_of(counts: DataFrame) -> DataFrame:
    """``n_words, texts`` of ``text_counts``; a written table."""
    return stage(counts.where("word IS NULL").groupBy("n_words").agg(F.sum("cnt").alias("texts")), "lengths")


def top_words_of_titles(counts: DataFrame, n_titles: int = 5, n_words: int = 10) -> DataFrame:
    """``title, rank, word, cnt`` of ``text_counts``, as by ``top_words_by_category``: no token crosses white space."""
    known = counts.where("title IS NOT NULL")
    top = (known.where("word IS NULL").groupBy("title").agg(F.sum("cnt").alias("cnt"))
           .orderBy(F.desc("cnt"), "title").limit(n_titles).select("title"))
    tokens = (known.where("word IS NOT NULL").join(F.broadcast(top), "title", "left_semi")
              .select("title", F.explode(tokenize(F.col("word"))).alias("word"), "cnt"))
    summed = tokens.groupBy("title", "word").agg(F.sum("cnt").alias("cnt"))
    order = Window.partitionBy("title").orderBy(F.desc("cnt"), "word")
    return (summed.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n_words)
            .select("title", "rank", "word", "cnt"))


def document_length(column: Column) -> Column:
    """Number of whitespace-separated words; null has none."""
    return F.size(whitespace_words(column)).cast("long")


def length_histogram(df: DataFrame, column: str, n_bins: int = 30) -> DataFrame:
    """``bin, lo, hi, cnt``: equal bins from the shortest to the longest text, the last one closed."""
    # One row per distinct length: the texts are read once.
    lengths = stage(df.groupBy(document_length(F.col(column)).alias("n_words")).agg(F.count("*").alias("texts")),
                    "lengths")
    return histogram_of_lengths(lengths, n_bins)


def histogram_of_lengths(lengths: DataFrame, n_bins: int = 30) -> DataFrame:
    """The same from ``n_words, texts``, a written table."""
    low, high = lengths.agg(F.min("n_words"), F.max("n_words")).first()
    if low is None:
        raise ValueError("no rows to count")
    low, high = (low - 0.5, high + 0.5) if low == high else (float(low), float(high))
    width = (high - low) / n_bins
    place = F.least(F.floor((F.col("n_words") - low) / F.lit(width)), F.lit(n_bins - 1)).cast("long")
    counts = lengths.groupBy(place.alias("bin")).agg(F.sum("texts").alias("cnt"))
    bins = lengths.sparkSession.range(n_bins).toDF("bin")
    return (bins.join(counts, "bin", "left")
            .select("bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt")))


def distinct_titles(df: DataFrame, title: str) -> DataFrame:
    """``n_distinct, n_distinct_with_null`` of a column."""
    has_null = F.max(F.col(title).isNull().cast("long"))
    return df.agg(F.countDistinct(title).alias("n_distinct"),
                  (F.countDistinct(title) + F.coalesce(has_null, F.lit(0))).alias("n_distinct_with_null"))

"""Dictionary lemmatization: a lexicon ``word, pos, lemma`` is joined to the words of each text."""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.text import clean_tokens
from rankloom.operators.grams import replace_words
from rankloom.operators.joins import fits_broadcast, join_lookup
from rankloom.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The suffix detachment rules published with the WordNet lemmatizer, per part of speech.
SUFFIX_RULES: tuple[tuple[str, str, str], ...] = (
    ("noun", "s", ""), ("noun", "ses", "s"), ("noun", "xes", "x"), ("noun", "zes", "z"),
    ("noun", "ches", "ch"), ("noun", "shes", "sh"), ("noun", "men", "man"), ("noun", "ies", "y"),
    ("verb", "s", ""), ("verb", "ies", "y"), ("verb", "es", "e"), ("verb", "es", ""),
    ("verb", "ed", "e"), ("verb", "ed", ""), ("verb", "ing", "e"), ("verb", "ing", ""),
    ("adj", "er", ""), ("adj", "est", ""), ("adj", "er", "e"), ("adj", "est", "e"),
)


def wordnet_pos(tag: Column) -> Column:
    """Part of speech of a Treebank tag by its first letter; anything unknown is a noun."""
    first = F.substring(tag, 1, 1)
    return (F.when(first == "J", "adj").when(first == "V", "verb").when(first == "R", "adv")
            .otherwise("noun"))


def build_lexicon(word_counts: DataFrame) -> DataFrame:
    """``word, pos, lemma`` from ``word, cnt``.

    A rule's candidate counts only if it is itself a word of the corpus; for each part of
    speech the most frequent candidate wins, then the alphabetically first. Words without one are left out: they are
    their own lemma.
    """
    candidates = F.array(*[
        F.when(F.col("word").endswith(suffix) & (F.length("word") > len(suffix)),
               F.struct(F.lit(pos).alias("pos"),
                        F.concat(F.expr(f"left(word, length(word) - {len(suffix)})"), F.lit(ending)).alias("lemma")))
        for pos, suffix, ending in SUFFIX_RULES])
    proposed = word_counts.select("word", F.inline(F.filter(candidates, lambda c: c.isNotNull())))
    known = word_counts.select(F.col("word").alias("lemma"), F.col("cnt").alias("lemma_cnt"))
    best = Window.partitionBy("word", "pos").orderBy(F.desc("lemma_cnt"), "lemma")
    return (proposed.join(known, "lemma").withColumn("_n", F.row_number().over(best)).where("_n = 1")
            .select("word", "pos", "lemma"))


def clean_and_lemmatize(df: DataFrame, id_column: str, text_column: str, lexicon: DataFrame,
                        **flags) -> DataFrame:
    """``id, text_cleaned``: cleaning with its last optional step, lemmatization."""
    return lemmatize(df, id_column, clean_tokens(F.col(text_column), **flags), lexicon, "text_cleaned")


def lemmatize(df: DataFrame, id_column: str, words: Column, lexicon: DataFrame, new_column: str = "text_lemmatized",
              tags: Column | None = None, max_bytes: int | None = None) -> DataFrame:
    """``id, text``: every word replaced by its lemma, unknown words kept, order kept."""
    listed = lemma_words(df, words, lexicon, tags, max_bytes)
    return listed.select(id_column, F.array_join("_words", " ").alias(new_column))


def lemma_words(df: DataFrame, words: Column, lexicon: DataFrame, tags: Column | None = None,
                max_bytes: int | None = None) -> DataFrame:
    """All columns and ``_words``: the words, each replaced by the lemma of (word, part of speech).

    ``tags`` has a Treebank tag for each word; without tags every word is a noun. A lexicon that is measured to be small is
    broadcast and each text changed where it lies. A larger one is joined to the exploded words, and each row is put
    together again by a key of its own, so rows may share ids.
    """
    plain = F.coalesce(words, F.array().cast("array<string>"))
    speech = (F.transform(plain, lambda w: F.lit("noun")) if tags is None
              else F.transform(plain, lambda w, i: wordnet_pos(F.coalesce(F.get(tags, i), F.lit("NN")))))
    keys = F.zip_with(plain, speech, lambda w, p: F.concat(w, F.lit("/"), p))
    entries = lexicon.select(F.concat("word", F.lit("/"), "pos").alias("key"), "lemma").dropDuplicates(["key"])
    if fits_broadcast(entries, max_bytes):
        listed = lexicon.select("word", "pos", "lemma").dropDuplicates(["word", "pos"])
        held = df.sparkSession.sparkContext.broadcast((listed.where("pos = 'noun'") if tags is None else listed).toArrow().combine_chunks())
        kinds, tag_column = (("noun",), None) if tags is None else (("noun", "verb", "adj", "adv"), "_tags")
        columns = [F.col(c) for c in df.columns if c != "_words"]
        rows = df.select(*columns, plain.alias("_words"), *([] if tags is None else [tags.alias("_tags")]))

        def replace(batches):
            table = held.value
            by_speech = {}
            for pos in kinds:
                own = table.filter(pc.equal(table["pos"], pos))
                by_speech[pos] = tuple(pa.concat_arrays(own[c].cast("large_string").chunks or [pa.array([], "large_string")])
                                       for c in ("word", "lemma"))
            yield from replace_words(batches, "_words", by_speech, tag_column)

        return rows.mapInArrow(replace, rows.drop("_tags").schema)
    rows = stage(df.withColumn("_keys", keys).withColumn("_row", F.monotonically_increasing_id()), "rows")
    exploded = rows.select("_row", F.posexplode("_keys").alias("_at", "key"))
    found = join_lookup(exploded, entries, "key", "left", max_bytes)
    entry = F.struct("_at", F.coalesce("lemma", F.regexp_replace("key", "/(noun|verb|adj|adv)$", "")).alias("lemma"))
    texts = (found.groupBy("_row").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
             .select("_row", F.transform("_entries", lambda e: e["lemma"]).alias("_words")))
    return (rows.join(texts, "_row", "left")
            .withColumn("_words", F.coalesce("_words", F.array().cast("array<string>"))).drop("_row", "_keys"))

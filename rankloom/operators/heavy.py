"""The most frequent words by bounded summaries: only what can be among them is counted exactly.

Each task keeps a summary of at most ``capacity`` words with lower bounds of their counts and says by how much
these may be too low. Summed over tasks the bounds prove which words can reach the top; a second pass counts those.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from rankloom.functions.text import whitespace_words
from rankloom.operators.joins import join_lookup
from rankloom.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 4096


def add_counts(summary: dict[str, int], words: list[str], counts: list[int], capacity: int) -> int:
    """Add counts to a summary and cut it to its capacity; returns by how much counts may have become too low.

    What the first word beyond the capacity has is taken off every word, and words with nothing left go.
    """
    for word, count in zip(words, counts):
        summary[word] = summary.get(word, 0) + count
    if len(summary) <= capacity:
        return 0
    values = np.fromiter(summary.values(), np.int64, len(summary))
    loss = int(np.partition(values, len(values) - capacity - 1)[len(values) - capacity - 1])
    left = [(word, count - loss) for word, count in summary.items() if count > loss]
    summary.clear()
    summary.update(left)
    return loss


def summaries(words: DataFrame, capacity: int) -> DataFrame:
    """``word, at_least`` of each task from lists of words, and a row without a word for how much may be missing."""
    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, loss = {}, 0
        for batch in batches:
            counted = batch.column(0).flatten().value_counts()
            loss += add_counts(summary, counted.field("values").to_pylist(), counted.field("counts").to_pylist(), capacity)
        yield pa.RecordBatch.from_pydict({"word": pa.array([*summary, None], pa.string()),
                                          "at_least": pa.array([*summary.values(), loss], pa.int64())})

    return words.mapInArrow(summarize, "word string, at_least bigint")


def heavy_words(df: DataFrame, column: str, n: int = 30, capacity: int = CAPACITY) -> DataFrame:
    """``word, cnt``: the ``n`` most common words, exactly; ties go to the alphabetically first.

    Null texts have no words. Summaries grow fourfold until their bounds prove that no word was missed; at the
    latest they hold every word of a task and need no second pass. A task shuffles at most ``capacity + 1`` rows first,
    then a row per word that can be among the ``n``.
    """
    words = df.where(F.col(column).isNotNull()).select(whitespace_words(F.col(column)).alias("words"))
    while True:
        found = stage(summaries(words, capacity).groupBy("word").agg(F.sum("at_least").alias("at_least")), "summaries")
        missing = found.where("word IS NULL").agg(F.coalesce(F.sum("at_least"), F.lit(0))).first()[0]
        known = found.where("word IS NOT NULL")
        if missing == 0:
            return known.orderBy(F.desc("at_least"), "word").limit(n).withColumnRenamed("at_least", "cnt")
        top = known.orderBy(F.desc("at_least")).limit(n).agg(F.min("at_least"), F.count("*")).first()
        # A word in no summary occurs at most as often as counts may be too low.
        if top[1] == n and top[0] > missing:
            break
        capacity *= 4
    candidates = known.where(F.col("at_least") + missing >= top[0]).select("word")
    counted = join_lookup(words.select(F.explode("words").alias("word")), candidates, "word", "inner")
    return counted.groupBy("word").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "word").limit(n)

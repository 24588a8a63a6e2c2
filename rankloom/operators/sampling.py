"""Repeatable samples and splits: rows are ordered by the md5 of their id and a seed."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.operators.joins import fits_broadcast
from rankloom.operators.ranking import rank_top
from rankloom.staging import stage

# The summaries below travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD_ROWS = 1 << 16
_PREFIX = 4     # hex digits: 65,536 buckets of equal expected size


def hash_key(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))


def smallest_hashes(df: DataFrame, id_column: str, seed: int, n: int) -> Column:
    """True for exactly the ``n`` rows with the smallest hash; ids must be unique.

    Finds the n-th hash from a bounded histogram of hash prefixes and one bucket, so the rows
    themselves are neither sorted nor shuffled.
    """
    if n <= 0:
        return F.lit(False)
    hashes = df.select(hash_key(id_column, seed).alias("h"))
    buckets = hashes.groupBy(F.substring("h", 1, _PREFIX).alias("b")).count().orderBy("b").collect()
    before = 0
    for bucket, count in buckets:
        if before + count >= n:
            cut = (hashes.where(F.col("h").startswith(bucket)).orderBy("h").limit(n - before)
                   .agg(F.max("h")).first()[0])
            return hash_key(id_column, seed) <= F.lit(cut)
        before += count
    return F.lit(True)


def sample_exact(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement; asking for more than there are is an error."""
    available = df.count()
    if n > available:
        raise ValueError(f"cannot sample {n} of {available} rows")
    return df.where(smallest_hashes(df, id_column, seed, n))


def train_validation_split(df: DataFrame, id_column: str, fraction: float = 0.1,
                           seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ceil(fraction * rows) are 'validation'; fraction 0 leaves none."""
    held_out = smallest_hashes(df, id_column, seed, math.ceil(df.count() * fraction))
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))


def rows_per_title(n_titles: int, total: int) -> int:
    """An equal share of ``total`` for each distinct title, at least one row."""
    return max(1, total // max(n_titles, 1))


def stratified_sample(df: DataFrame, id_column: str, total: int = 100_000, seed: int = 42,
                      title: str = "title") -> DataFrame:
    """Up to an equal number of rows of each title; rows without a title are left out.

    Only ids, titles and hashes are ranked; the chosen ids then pick the full rows.
    """
    n_titles = df.agg(F.countDistinct(title)).first()[0]
    share = rows_per_title(n_titles, total)
    keys = df.where(F.col(title).isNotNull()).select(id_column, title, hash_key(id_column, seed).alias("_h"))
    chosen = rank_top(keys, title, [F.asc("_h")], share, id_column).select(id_column)
    # About 40 bytes a row; ids of any type are measured only where the number of rows allows a broadcast at all.
    if share * n_titles <= 1_000_000 and fits_broadcast(chosen):
        chosen = F.broadcast(chosen)
    return df.join(chosen, id_column, "left_semi")


def smallest_per_title(rows: pa.Table, total: int) -> pa.Table:
    """Of ``title, h, ...`` the rows with the smallest hashes of each title, as many as the titles seen so far allow.

    More titles can only lower the share, so no row goes that the whole sample needs.
    """
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("title", "ascending"), ("h", "ascending")]))
    titles = rows["title"].combine_chunks()
    titles = titles.chunk(0) if isinstance(titles, pa.ChunkedArray) else titles
    encoded = titles.dictionary_encode()
    code = encoded.indices.to_numpy()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return rows.filter(pa.array(place < rows_per_title(len(first), total)))


def stratified_summary(df: DataFrame, id_column: str, total: int = 100_000, seed: int = 42, title: str = "title",
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """``title, id, keep...``: the rows of ``stratified_sample`` by one scan of the table; ids must be unique.

    A task keeps a summary of the smallest hashes of each title it meets, at most ``total`` rows or one for each title,
    and only summaries are shuffled; they are merged in salted parts, so a hot title has many tasks. Rows carry ``keep`` along;
    of wide rows rather take ``stratified_sample``, which fetches the chosen ones by a second scan.
    """
    rows = df.where(F.col(title).isNotNull()).select(
        F.col(title).cast("string").alias("title"), hash_key(id_column, seed).alias("h"), F.col(id_column).alias("id"), *keep)
    schema = rows.schema

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > 2 * max(HELD_ROWS, total):
                held = smallest_per_title(pa.Table.from_batches(held), total).to_batches()
                n = sum(b.num_rows for b in held)
        if n:
            yield from smallest_per_title(pa.Table.from_batches(held), total).to_batches()

    summaries = stage(rows.mapInArrow(summarize, schema), "samples")
    # Every title of the table is in a summary.
    n_titles = summaries.agg(F.countDistinct("title")).first()[0]
    chosen = rank_top(summaries, "title", [F.asc("h")], rows_per_title(n_titles, total), "id")
    return chosen.select("title", F.col("id").alias(id_column), *keep)

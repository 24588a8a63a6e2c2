"""Standing rankings: documents arrive as a stream and compete for the k places of each job description.

The k best documents of a job description so far are its state, in Spark's state store. A task scores what arrives
against all job descriptions and sends on k rows of each at most, so what is shuffled and kept grows with the
number of job descriptions, not with the stream.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankloom.functions.text import clean_text
from rankloom.operators.joins import fits_broadcast
from rankloom.operators.search import Block, batch_blocks, search_block
from rankloom.operators.tfidf import TfidfSettings, token_table, vectorizer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD_ROWS = 1 << 18


def best_per_query(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query: higher score first, then lower id."""
    order = [("query_id", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
    found = found.take(pc.sort_indices(found, sort_keys=order))
    queries = found["query_id"].combine_chunks()
    queries = queries.chunk(0) if isinstance(queries, pa.ChunkedArray) else queries
    code = queries.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return found.filter(pa.array(place < k))


def arriving_winners(batches: Iterator[pa.RecordBatch], queries: Block, k: int) -> Iterator[pa.RecordBatch]:
    """``query_id, doc_id, score``: the k best documents of this task for each query."""
    held, rows = [], 0
    for block in batch_blocks(batches):
        for part in search_block(queries, block, k):
            held.append(part.select(["query_id", "doc_id", "score"]))
            rows += part.num_rows
        if rows > HELD_ROWS:
            kept = best_per_query(pa.Table.from_batches(held), k)
            held, rows = kept.to_batches(), 0
    if held:
        yield from best_per_query(pa.Table.from_batches(held), k).to_batches()


def standing_top_k(documents: DataFrame, query_vectors: DataFrame, vocabulary: DataFrame, settings: TfidfSettings,
                   top_k: int) -> DataFrame:
    """``query_id, rank, doc_id, score`` as a stream: the whole ranking of each query that an arrival changed.

    documents  ``doc_id, text``, a stream. Ordered by score at 9 places, then by ``doc_id``; score 0 takes part, a null
    text counts as ''. Every arriving row takes part, as in a search of a table; a source that may deliver a document
    twice goes through ``dropDuplicatesWithinWatermark`` first. Job descriptions stand for as long as the stream runs
    and must fit a broadcast, which is checked.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    held = query_vectors.select("doc_id", "term_ids", "weights")
    if not fits_broadcast(held):
        raise ValueError("the standing queries are too large for a broadcast: run several streams over parts of them")
    queries = documents.sparkSession.sparkContext.broadcast(held.toArrow())
    tokens = token_table(documents, "doc_id", clean_text(F.col("text")), settings.stop_words, ascii_only=True)
    vectors = vectorizer(documents.sparkSession, vocabulary, settings)(tokens)
    query_type, doc_type = held.schema["doc_id"].dataType, vectors.schema["doc_id"].dataType
    winners = vectors.mapInArrow(
        lambda batches: arriving_winners(batches, Block(queries.value), top_k),
        T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", doc_type),
                      T.StructField("score", T.DoubleType())]))

    def compete(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = pd.DataFrame(dict(zip(("doc_id", "score"), state.get))) if state.exists else None
        frames = [f[["doc_id", "score"]] for f in frames]
        every = pd.concat(frames if before is None else [before, *frames], ignore_index=True)
        best = every.sort_values(["score", "doc_id"], ascending=[False, True], kind="stable").head(top_k)
        best = best.reset_index(drop=True)
        if before is None or not best.equals(before.astype(best.dtypes.to_dict())):
            state.update((best["doc_id"].tolist(), best["score"].tolist()))
            yield best.assign(query_id=key[0], rank=best.index + 1)[["query_id", "rank", "doc_id", "score"]]

    return winners.groupBy("query_id").applyInPandasWithState(
        compete,
        T.StructType([T.StructField("query_id", query_type), T.StructField("rank", T.LongType()),
                      T.StructField("doc_id", doc_type), T.StructField("score", T.DoubleType())]),
        T.StructType([T.StructField("doc_ids", T.ArrayType(doc_type)),
                      T.StructField("scores", T.ArrayType(T.DoubleType()))]),
        "update", GroupStateTimeout.NoTimeout)


def follow_standings(standings: DataFrame, output: str, checkpoint: str, **trigger):
    """Start the query that keeps changed rankings below ``output``.

    Every micro-batch writes its own folder and a repeated one overwrites it, with the state it started from, so
    failures and replays leave no trace.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (standings.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_standings(spark: SparkSession, output: str) -> DataFrame:
    """``query_id, rank, doc_id, score``: of each query the ranking that was written last."""
    written = spark.read.parquet(output)
    last = written.groupBy(F.col("query_id").alias("_query")).agg(F.max("batch_id").alias("_last"))
    latest = written["query_id"].eqNullSafe(last["_query"]) & (written["batch_id"] == last["_last"])
    return written.join(last, latest, "left_semi").select("query_id", "rank", "doc_id", "score")

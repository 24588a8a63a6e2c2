"""Scores inside requests: each request brings one query and its own documents."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from rankloom.operators.grams import token_slices
from rankloom.operators.joins import fits_broadcast

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def slices_to_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of a bounded number of vector entries, however long a vector is."""
    for part in token_slices(batches, "term_ids"):
        yield from token_slices(iter([part]), "query_terms") if "query_terms" in part.schema.names else [part]


def _entries(lists: pa.ListArray, weights: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of sparse vectors; a null vector has none."""
    lists, weights = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lists, weights))
    lists, weights = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lists, weights))
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lengths)
    return row, lists.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy()


def paired_scores(query_rows: tuple, rows: tuple, owner: np.ndarray, n: int) -> np.ndarray:
    """Inner product of each of n rows with query ``owner[row]`` (-1 for none), rounded to 9 places."""
    query, query_term, query_weight = query_rows
    row, term, weight = rows
    known = owner[row] >= 0
    row, term, weight = row[known], term[known], weight[known]
    if not len(query) or not len(row):
        return np.zeros(n)
    size = np.int64(max(query_term.max(), term.max()) + 1)
    keys = query * size + query_term
    order = np.argsort(keys, kind="stable")
    keys, query_weight = keys[order], query_weight[order]
    wanted = owner[row] * size + term
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[place] == wanted
    # Without any hit bincount gives integers.
    return np.round(np.bincount(row[hit], weight[hit] * query_weight[place[hit]], n).astype(float), 9)


def request_scores(requests: DataFrame, documents: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``request_id, doc_id, score`` for every document of every request, 0 without a shared term.

    requests   sparse vectors, ``doc_id`` being the request, one row each
    documents  sparse vectors with a ``request_id``
    A document stays one row and is scored in the task that holds it. Requests that are measured to be small are broadcast;
    others are joined to their documents by request, where adaptive execution splits a hot one.
    """
    queries = requests.select(F.col("doc_id").alias("request_id"), "term_ids", "weights")
    rows = documents.select("request_id", "doc_id", "term_ids", "weights")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("request_id", "doc_id")}
    schema = f"request_id {kinds['request_id']}, doc_id {kinds['doc_id']}, score double"

    def result(batch: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("request_id"), batch.column("doc_id"), pa.array(scores)],
                                          names=["request_id", "doc_id", "score"])

    if fits_broadcast(queries, max_bytes):
        held = requests.sparkSession.sparkContext.broadcast(queries.toArrow().combine_chunks())

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = held.value
            names, vectors = table["request_id"].combine_chunks(), _entries(table["term_ids"], table["weights"])
            for batch in slices_to_score(batches):
                owner = pc.index_in(batch.column("request_id"), value_set=names).fill_null(-1).to_numpy()
                own = _entries(batch.column("term_ids"), batch.column("weights"))
                yield result(batch, paired_scores(vectors, own, owner, batch.num_rows))

        return rows.mapInArrow(beside, schema)
    joined = rows.join(queries.withColumnsRenamed({"term_ids": "query_terms", "weights": "query_weights"}),
                       "request_id", "left")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_to_score(batches):
            scores = paired_scores(_entries(batch.column("query_terms"), batch.column("query_weights")),
                                   _entries(batch.column("term_ids"), batch.column("weights")),
                                   np.arange(batch.num_rows), batch.num_rows)
            yield result(batch, scores)

    return joined.mapInArrow(inside, schema)

"""An inverted index over TF-IDF vectors, with upper bounds per block of documents.

The index is a table with a row per segment: its documents in id order, and for each term the places and weights of the
documents that hold it, and the largest weight in every block of ``BLOCK_DOCS`` places. It is written once and read for any
number of searches.

A search adds the bounds of a query's terms for all blocks of a segment, goes through the blocks by falling bound, and stops
at the first block whose bound lies below the k-th best score so far; only documents of the blocks before it are
scored. Rows that score 0 take part, so results are those of the search that scores everything.

Queries go to all tasks while their measured size allows a broadcast, and the index is read in place. More queries come in blocks
that meet all segments through a join, so neither side passes the driver. Defined cases: a query
without known terms gets the lowest ids with score 0; rows that share an id are indexed each; an empty side gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rankloom.operators.blocks import from_bytes, meet_blocks, packed, to_bytes
from rankloom.operators.joins import fits_broadcast
from rankloom.operators.ranking import rank_top
from rankloom.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_DOCS = 64
# A segment is one row of a few MB, since rows of any table are held whole, and several at once.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 12, 1 << 17
PLACES = 9
# Parquet looks at the size of a page and of a row group after every 100 rows by itself, which would be hundreds of MB of segments in
# the memory of the task that writes, and of each one that reads: a page is one row, and a group about eight.
FEW_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
            "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def _spelled(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``at``, place) of all places from ``starts[at]`` to the next start."""
    first = starts[at].astype(np.int64)
    counts = starts[at + 1] - first
    which = np.repeat(np.arange(len(at)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]


class Segment:
    """One segment's lists, from its documents' vectors or from a written row."""

    def __init__(self, table: pa.Table):
        row = {name: table[name].chunk(0)[0].values for name in table.column_names}
        self.names = row.pop("names")
        for name, values in row.items():
            setattr(self, name, values.to_numpy())
        self.n_blocks = -(-len(self.names) // BLOCK_DOCS)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each known term in the lists, its weight in the query, bound of every block)."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.zeros(0, np.int64)
        at, weights = at[known], weights[known]
        term, entry = _spelled(self.block_starts, at)
        bound = np.bincount(self.block_of[entry], weights[term] * self.block_most[entry], self.n_blocks)
        return at, weights, bound

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the k best documents, and the number of postings that were scored."""
        at, weights, bound = self.bounds(terms, weights)
        term, entries = _spelled(self.block_starts, at)
        weight_of, row = weights[term], np.full(self.n_blocks, -1)
        by_bound, n_docs, scored = np.argsort(-bound, kind="stable"), len(self.names), 0
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, max(1, -(-k // BLOCK_DOCS))
        while done < len(by_bound):
            # Scores are rounded, so a bound counts as reached from half a unit below.
            if len(scores) == k and bound[by_bound[done]] + 10.0 ** -PLACES < scores[-1]:
                break
            some = np.sort(by_bound[done:done + step])
            done, step = done + step, step * 2
            row[some] = np.arange(len(some))
            # Postings by term, so that a document's weights are summed in the order of its query's terms.
            own = np.flatnonzero(row[self.block_of[entries]] >= 0)
            entry, posting = _spelled(self.posting_starts, entries[own])
            cell = row[self.block_of[entries[own]]][entry] * BLOCK_DOCS + self.places[posting] % BLOCK_DOCS
            total = np.bincount(cell, weight_of[own][entry] * self.weights[posting], len(some) * BLOCK_DOCS)
            row[some], scored = -1, scored + len(posting)
            found = (some[:, None] * BLOCK_DOCS + np.arange(BLOCK_DOCS)).ravel()
            inside = found < n_docs
            places = np.append(places, found[inside])
            scores = np.append(scores, np.round(total[inside], PLACES))
            best = np.lexsort((places, -scores))[:k]
            places, scores = places[best], scores[best]
        return places, scores, scored


def segment_columns(names: pa.Array, lists: pa.ListArray, weights: np.ndarray) -> dict[str, pa.Array]:
    """The lists of a segment from vectors ``term_ids, weights``."""
    order = pc.sort_indices(names)
    place_of = np.empty(len(names), np.int64)
    place_of[order.to_numpy()] = np.arange(len(names))
    place = place_of[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))]
    term = lists.flatten().to_numpy()
    by_term = np.lexsort((place, term))
    place, term, weights = place[by_term], term[by_term], weights[by_term]
    block = place // BLOCK_DOCS
    new_term = np.diff(term, prepend=-1) != 0
    starts = np.flatnonzero(new_term | (np.diff(block, prepend=-1) != 0))
    most = np.maximum.reduceat(weights, starts) if len(starts) else np.zeros(0)
    # A segment has fewer than 2^31 postings: a row would be too large before.
    short = lambda x: pa.array(x.astype(np.int32))
    return {"names": names.take(order), "terms": short(term[new_term]),
            "block_starts": short(np.append(np.searchsorted(starts, np.flatnonzero(new_term)), len(starts))),
            "block_of": short(block[starts]), "block_most": pa.array(most),
            "posting_starts": short(np.append(starts, len(place))), "places": short(place), "weights": pa.array(weights)}


def build_index(vectors: DataFrame) -> DataFrame:
    """``block, data``: the segments of ``doc_id, term_ids, weights``, for ``save_index`` or ``search_index``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
            part = np.maximum(np.arange(len(sizes)) // SEGMENT_DOCS, np.cumsum(sizes) // SEGMENT_POSTINGS)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            for start, stop in zip(starts, np.append(starts[1:], len(part))):
                own = pa.Table.from_batches([batch.slice(start, stop - start)]).combine_chunks()
                flat = own["weights"].chunk(0).flatten().to_numpy()
                columns = segment_columns(own["doc_id"].chunk(0), own["term_ids"].chunk(0), flat)
                table = pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                                  for name, v in columns.items()})
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()),
                                                  "data": pa.array([to_bytes(table)], pa.binary())})
                number += 1

    return vectors.select("doc_id", "term_ids", "weights").mapInArrow(run, "block bigint, data binary")


def save_index(vectors: DataFrame, path: str) -> str:
    build_index(vectors).write.options(**FEW_ROWS).mode("overwrite").parquet(path)
    return path


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search_index(queries: DataFrame, index: DataFrame, k: int, id_type: T.DataType = T.LongType()) -> DataFrame:
    """``query_id, rank, doc_id, score``: the k best documents per query ``doc_id, term_ids, weights``, zeros included.

    ``index`` is a written index, and ``id_type`` the type of its documents' ids.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    schema = T.StructType([T.StructField("query_id", queries.schema["doc_id"].dataType), T.StructField("doc_id", id_type),
                           T.StructField("score", T.DoubleType())])

    def opened(table: pa.Table):
        return Segment(table) if "block_starts" in table.column_names else table.combine_chunks()

    def kernel(asked: pa.Table, segment: Segment) -> Iterator[pa.RecordBatch]:
        lists, flat = asked["term_ids"].chunk(0), asked["weights"].chunk(0).flatten().to_numpy()
        terms, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = [segment.search(terms[a:b], flat[a:b], k)[:2] for a, b in zip(at, at[1:])]
        counts = [len(p) for p, _ in found]
        yield pa.RecordBatch.from_pydict({
            "query_id": asked["doc_id"].chunk(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))),
            "doc_id": segment.names.take(pa.array(np.concatenate([p for p, _ in found]))),
            "score": pa.array(np.concatenate([s for _, s in found]))})

    queries = queries.select("doc_id", "term_ids", "weights")
    if fits_broadcast(queries):
        # The index stays where it is: its rows are too large to be sorted and sent for nothing.
        held = queries.sparkSession.sparkContext.broadcast(queries.toArrow().combine_chunks())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data") if held.value.num_rows else ():
                    yield from kernel(held.value, opened(from_bytes(data.as_buffer())))

        found = index.mapInArrow(scan, schema)
    else:
        found = meet_blocks(stage(packed(queries, "term_ids"), "blocks"), index, opened, kernel, schema)
    ranked = rank_top(found, "query_id", [F.desc("score"), F.asc("doc_id")], k, "doc_id")
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")

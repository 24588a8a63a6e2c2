"""Exact top-k search of every query vector over every indexed vector.

Scores of all pairs are computed inside tasks, block by block, and each block keeps only the k best rows
per query; pairs are never rows of a table. The smaller side is broadcast when its measured size
allows it, so the larger one is scanned in place without a shuffle; when neither side is small, both are
packed into blocks that meet by a join, and nothing of them passes the driver. Dense vectors can be written once as cells
around pivots instead (``save_cells``), where blocks that cannot hold an answer are passed over.

A vector table has ``doc_id`` and either ``term_ids, weights`` (sparse) or ``embedding`` (dense),
and optionally ``title`` for one-row-per-title search.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rankloom.operators import cells
from rankloom.operators.blocks import meet_tables
from rankloom.operators.grams import token_slices
from rankloom.operators.ranking import rank_top
from rankloom.staging import stage

# The kernels below travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BROADCAST_CELLS = 4_000_000     # numbers in a broadcast side: at most 48 MB
QUERY_CHUNK = 256                   # queries scored together
SCORE_CELLS = 1 << 20               # scores held at once
INDEX_ROWS = 1 << 12                # vectors of a batch that are scored together,
INDEX_ENTRIES = 1 << 20             # unless they have more numbers than this, or are one
ENTRY_CHUNK = 1 << 12               # sparse entries expanded together


class Block:
    """Vectors of one table or batch as flat arrays, in id order."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending")])
        table = table.take(order).combine_chunks()
        self.names = _one_chunk(table["doc_id"])
        self.ids = np.arange(len(self.names))       # places in id order stand for ids
        self.titles = table["title"].combine_chunks() if "title" in table.column_names else None
        name = "embedding" if "embedding" in table.column_names else "term_ids"
        lists = _one_chunk(table[name])
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        self.dense = self.terms = self.weights = None
        if name == "embedding":
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            dim = len(flat) // max(len(self.ids), 1)
            if not np.all(np.diff(self.offsets) == dim):
                raise ValueError("all vectors need the same number of dimensions")
            self.dense = flat.reshape(len(self.ids), dim)
        else:
            self.terms = lists.flatten().to_numpy(zero_copy_only=False)
            self.weights = _one_chunk(table["weights"]).flatten().to_numpy(zero_copy_only=False)
        self.offsets = self.offsets - self.offsets[0]


def batch_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The rows of the batches in blocks, none larger than its scores may be."""
    for batch in batches:
        lists = "embedding" if "embedding" in batch.schema.names else "term_ids"
        for part in token_slices(iter([batch]), lists, INDEX_ENTRIES):
            for start in range(0, part.num_rows, INDEX_ROWS):
                yield Block(pa.Table.from_batches([part.slice(start, INDEX_ROWS)]))


def _one_chunk(column: pa.ChunkedArray) -> pa.Array:
    combined = column.combine_chunks()
    return combined.chunk(0) if isinstance(combined, pa.ChunkedArray) else combined


def query_chunks(queries: Block, index: Block) -> Iterator[tuple[int, int]]:
    """Ranges of queries whose scores against the index block fit in memory together."""
    step = max(1, min(QUERY_CHUNK, SCORE_CELLS // max(len(index.ids), 1)))
    for start in range(0, len(queries.ids), step):
        yield start, min(start + step, len(queries.ids))


def score_block(queries: Block, index: Block, start: int, stop: int) -> np.ndarray:
    """Inner products of queries[start:stop] with all indexed vectors, rounded to 9 places."""
    if index.dense is not None:
        return np.round(queries.dense[start:stop] @ index.dense.T, 9)
    scores = np.zeros((len(index.ids), stop - start))
    low, high = queries.offsets[start], queries.offsets[stop]
    terms, rows = np.unique(queries.terms[low:high], return_inverse=True)
    if len(terms) == 0 or len(index.terms) == 0:
        return scores.T
    table = np.zeros((len(terms), stop - start))
    lengths = np.diff(queries.offsets[start:stop + 1])
    table[rows, np.repeat(np.arange(stop - start), lengths)] = queries.weights[low:high]

    place = np.minimum(np.searchsorted(terms, index.terms), len(terms) - 1)
    hit = np.flatnonzero(terms[place] == index.terms)
    owner = np.repeat(np.arange(len(index.ids)), np.diff(index.offsets))[hit]
    place, weights = place[hit], index.weights[hit]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    docs, first = owner[first], np.append(first, len(owner))
    at = 0
    while at < len(docs):
        end = max(at + 1, int(np.searchsorted(first, first[at] + ENTRY_CHUNK, side="right")) - 1)
        end = min(end, len(docs))
        part = slice(first[at], first[end])
        products = table[place[part]] * weights[part, None]
        scores[docs[at:end]] = np.add.reduceat(products, first[at:end] - first[at], axis=0)
        at = end
    return np.round(scores, 9).T


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank) of the k best columns per row: higher score first, then lower id.

    ``ids`` is one id per column, or one per cell.
    """
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = np.nonzero(np.ones(scores.shape, dtype=bool))
    tie = ids[row, column] if ids.ndim == 2 else ids[column]
    order = np.lexsort((tie, -scores[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(scores.shape[0]))
    rank = np.arange(len(row)) - starts[row] + 1
    keep = rank <= k
    return row[keep], column[keep], rank[keep]


def best_of_title(scores: np.ndarray, ids: np.ndarray,
                  codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row and title the best score and, among equals, the lowest id; with the title codes."""
    order = np.argsort(codes, kind="stable")
    present, starts = np.unique(codes[order], return_index=True)
    by_title, ids = scores[:, order], ids[order]
    best = np.maximum.reduceat(by_title, starts, axis=1)
    lengths = np.diff(np.append(starts, len(order)))
    tied = np.where(by_title == np.repeat(best, lengths, axis=1), ids, np.iinfo(np.int64).max)
    return best, np.minimum.reduceat(tied, starts, axis=1), present


def search_block(queries: Block, index: Block, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of this index block for each of these queries."""
    if len(queries.ids) == 0 or len(index.ids) == 0:
        return
    if index.titles is not None:
        encoded = index.titles.dictionary_encode(null_encoding="encode")
        codes, names = encoded.indices.to_numpy(), encoded.dictionary
    for start, stop in query_chunks(queries, index):
        scores = score_block(queries, index, start, stop)
        if index.titles is None:
            row, column, rank = best_rows(scores, index.ids, k)
            found, title = index.ids[column], None
        else:
            scores, ids, present = best_of_title(scores, index.ids, codes)
            row, column, rank = best_rows(scores, ids, k)
            found, title = ids[row, column], names.take(pa.array(present[column]))
        columns = {"query_id": queries.names.take(pa.array(start + row)),
                   "doc_id": index.names.take(pa.array(found))}
        if title is not None:
            columns["title"] = title
        columns["score"] = pa.array(scores[row, column])
        columns["rank"] = pa.array(rank.astype(np.int32))
        yield pa.RecordBatch.from_pydict(columns)


def _cells(vectors: DataFrame) -> int:
    """How many numbers the vectors hold; ids and titles count as one for every 8 bytes."""
    size = F.greatest(F.size("embedding" if "embedding" in vectors.columns else "term_ids"), F.lit(0))
    names = [F.ceil(F.coalesce(F.octet_length(c), F.lit(0)) / 8) + 1 for c in ("doc_id", "title")
             if c in vectors.columns and vectors.schema[c].dataType.simpleString() == "string"]
    return vectors.agg(F.sum((size + 1 + sum(names, F.lit(0))).cast("long"))).first()[0] or 0


def _vector_columns(vectors: DataFrame, with_title: bool) -> DataFrame:
    names = ["embedding"] if "embedding" in vectors.columns else ["term_ids", "weights"]
    columns = ["doc_id", *names]
    if with_title:
        columns.append(F.col("title").cast("string").alias("title"))
    return vectors.select(*columns)


def _found_schema(query_id: T.DataType, doc_id: T.DataType, with_title: bool) -> T.StructType:
    return T.StructType(
        [T.StructField("query_id", query_id), T.StructField("doc_id", doc_id)]
        + ([T.StructField("title", T.StringType())] if with_title else [])
        + [T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])


def save_cells(index: DataFrame, path: str, with_title: bool = False) -> str:
    """Write dense vectors once, in cells around pivots, for any number of searches by ``top_k_in_cells``."""
    return cells.build_cells(_vector_columns(index, with_title), path)


def top_k_in_cells(queries: DataFrame, index: cells.CellIndex, doc_id: T.DataType, k: int, one_per_title: bool = False) -> DataFrame:
    """``top_k`` against written cells (``cells.open_cells``), for queries and an index of any size.

    ``doc_id`` is the type of the index's ids. With ``one_per_title`` the cells need titles.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    queries = _vector_columns(queries, False)
    schema = _found_schema(queries.schema["doc_id"].dataType, doc_id, one_per_title)
    names = ["doc_id", "embedding"] + (["title"] if one_per_title else [])
    opened = lambda table: Block(table.select([n for n in names if n in table.column_names]))
    return cells.search_cells(queries, index, k, opened, lambda q, d: search_block(q, d, k),
                              lambda found: _merge(found, k, one_per_title), schema)


def top_k(queries: DataFrame, index: DataFrame, k: int, one_per_title: bool = False,
          max_broadcast_cells: int | None = None) -> DataFrame:
    """The k best indexed rows per query: ``query_id, rank, [title,] doc_id, score``.

    Ordered by the score rounded to 9 places, then by ``doc_id``; rows with score 0 take part.
    With ``one_per_title`` only the best row of each title counts.
    The queries should be a written table, since their size is measured first. The index is scanned once
    as long as the queries fit a broadcast, and is written here when they do not.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    limit = MAX_BROADCAST_CELLS if max_broadcast_cells is None else max_broadcast_cells
    context = queries.sparkSession.sparkContext
    queries, index = _vector_columns(queries, False), _vector_columns(index, one_per_title)
    schema = _found_schema(queries.schema["doc_id"].dataType, index.schema["doc_id"].dataType, one_per_title)
    if _cells(queries) <= limit:
        scan_index = _scan(context.broadcast(queries.toArrow()), lambda q, d: search_block(q, d, k))
        return _merge(index.mapInArrow(scan_index, schema), k, one_per_title)
    index = stage(index, "index")
    if _cells(index) <= limit:
        held = context.broadcast(index.toArrow())

        def scan_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = Block(held.value)
            for block in batch_blocks(batches):
                yield from search_block(block, kept, k)

        # Each query has met the whole index in one task: its ranks are final.
        return _arranged(queries.mapInArrow(scan_queries, schema), one_per_title)
    return _merge(_in_blocks(queries, index, lambda q, d: search_block(q, d, k), schema), k, one_per_title)


def all_scores(queries: DataFrame, index: DataFrame, max_broadcast_cells: int | None = None) -> DataFrame:
    """``query_id, doc_id, score``: a row for every query and every indexed row, no k being asked for.

    Scores are those of ``top_k``, and the sides meet as there. The rows are as many as there are pairs.
    """
    limit = MAX_BROADCAST_CELLS if max_broadcast_cells is None else max_broadcast_cells
    queries, index = _vector_columns(queries, False), _vector_columns(index, False)
    schema = T.StructType([T.StructField("query_id", queries.schema["doc_id"].dataType),
                           T.StructField("doc_id", index.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return _over_pairs(queries, index, list_scores, schema, limit)


def list_scores(queries: Block, index: Block) -> Iterator[pa.RecordBatch]:
    """``query_id, doc_id, score`` of all pairs of two blocks."""
    for start, stop in query_chunks(queries, index):
        scores = score_block(queries, index, start, stop)
        row, column = np.divmod(np.arange(scores.size), max(len(index.ids), 1))
        yield pa.RecordBatch.from_pydict({"query_id": queries.names.take(pa.array(start + row)),
                                          "doc_id": index.names.take(pa.array(column)), "score": pa.array(scores.ravel())})


def _scan(held: Broadcast, kernel: Callable[[Block, Block], Iterator[pa.RecordBatch]]) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Block(held.value)
        for block in batch_blocks(batches):
            yield from kernel(kept, block)

    return scan


def _in_blocks(queries: DataFrame, index: DataFrame, kernel: Callable, schema: T.StructType | str) -> DataFrame:
    """The answers for two sides of any size, whose blocks meet by a join."""
    lists = "embedding" if "embedding" in index.columns else "term_ids"
    return meet_tables(queries, index, lists, Block, kernel, schema)


def _arranged(found: DataFrame, with_title: bool) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"),
                        *(["title"] if with_title else []), "doc_id", "score")


def _merge(found: DataFrame, k: int, one_per_title: bool) -> DataFrame:
    """Rank the block winners of each query; the best k overall are among them."""
    best_first = [F.desc("score"), F.asc("doc_id")]
    if one_per_title:
        per_title = Window.partitionBy("query_id", "title").orderBy(*best_first)
        found = found.withColumn("_n", F.row_number().over(per_title)).where("_n = 1").drop("_n")
    return _arranged(rank_top(found, "query_id", best_first, k, "doc_id"), one_per_title)


def _bucket(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6).astype(np.int64)


def count_scores(queries: Block, index: Block) -> Iterator[pa.RecordBatch]:
    """``bucket, pairs, total, low, high`` over all pairs of two blocks, per millionth of the score."""
    for start, stop in query_chunks(queries, index):
        scores = np.sort(score_block(queries, index, start, stop).ravel())
        if not len(scores):
            continue
        place = _bucket(scores)
        first = np.flatnonzero(np.diff(place, prepend=place[0] - 1))
        last = np.append(first[1:], len(scores))
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(place[first]), "pairs": pa.array(last - first), "total": pa.array(np.add.reduceat(scores, first)),
            "low": pa.array(scores[first]), "high": pa.array(scores[last - 1])})


def scores_within(queries: Block, index: Block, buckets: list[int]) -> Iterator[pa.RecordBatch]:
    """``score, pairs`` of the scores that fall into the given buckets."""
    for start, stop in query_chunks(queries, index):
        scores = score_block(queries, index, start, stop).ravel()
        found, pairs = np.unique(scores[np.isin(_bucket(scores), buckets)], return_counts=True)
        yield pa.RecordBatch.from_pydict({"score": pa.array(found), "pairs": pa.array(pairs.astype(np.int64))})


def _over_pairs(small: DataFrame, large: DataFrame, kernel: Callable, schema: T.StructType | str, limit: int) -> DataFrame:
    if _cells(small) <= limit:
        return large.mapInArrow(_scan(small.sparkSession.sparkContext.broadcast(small.toArrow()), kernel), schema)
    return _in_blocks(small, large, kernel, schema)


def similarity_summary(queries: DataFrame, index: DataFrame, max_broadcast_cells: int | None = None) -> DataFrame:
    """``min, max, mean, median`` over the scores of all pairs, exact at 9 places.

    A first pass counts scores by millionths, in the tasks. A second one lists the distinct scores of the one or two
    buckets in the middle, at most about a thousand each. The sides meet as in ``top_k``.
    """
    limit = MAX_BROADCAST_CELLS if max_broadcast_cells is None else max_broadcast_cells
    small, large = _vector_columns(queries, False), stage(_vector_columns(index, False), "index")
    counted = stage(_over_pairs(small, large, count_scores,
                                "bucket bigint, pairs bigint, total double, low double, high double", limit)
                    .groupBy("bucket").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"),
                                           F.min("low").alias("low"), F.max("high").alias("high")), "score-counts")
    low, high, mean, n = counted.agg(F.min("low"), F.max("high"), F.sum("total") / F.sum("pairs"), F.sum("pairs")).first()
    spark, schema = queries.sparkSession, "min double, max double, mean double, median double"
    if not n:
        return spark.createDataFrame([(None, None, None, None)], schema)
    # At most one row per millionth of the range of scores: a running total in one task.
    running = counted.withColumn("upto", F.sum("pairs").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    places = [(n + 1) // 2, n // 2 + 1]
    middle = [running.where(F.col("upto") >= p).agg(F.min_by(F.struct("bucket", F.col("upto") - F.col("pairs")), "bucket"))
              .first()[0] for p in places]
    within = sorted({m[0] for m in middle})
    listed = (_over_pairs(small, large, lambda q, d: scores_within(q, d, within), "score double, pairs bigint", limit)
              .groupBy("score").agg(F.sum("pairs").alias("pairs")).orderBy("score").collect())
    values = []
    for place, (bucket, before) in zip(places, middle):
        for row in listed:
            if _bucket(np.array([row["score"]]))[0] == bucket:
                before += row["pairs"]
                if before >= place:
                    values.append(row["score"])
                    break
    return spark.createDataFrame([(low, high, mean, sum(values) / 2)], schema)

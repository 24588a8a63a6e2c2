"""Exact search of dense vectors by cells around pivots.

Every indexed vector lies in the cell of the pivot that it makes the smallest angle with. Blocks of a cell hold rings of it: vectors
whose angles to the pivot lie close together. On the sphere an angle between two vectors is at least the difference of
their angles to a third one, so a query at angle a to a pivot scores at most ``|q| |x| cos(a - ring)`` in a ring that it lies outside of.

A search first visits the cells with the highest bounds that hold k rows together. The k-th best score found there is the floor of
the query: cells and rings with a lower bound cannot hold an answer. What is left is visited in a second round. Visits are counted
first: where too little can be passed over, so that visiting would move more rows than bringing all blocks together, the second
round does that, and nothing moves more often than in a search without cells.

Queries travel to the cells that they visit, and meet blocks by an equi-join on cell and slot; the slots of a cell follow from the
numbers of blocks on both sides, so that a cell with a third of all rows is many tasks. The driver sees pivots and one summary
row a cell, at most ``MAX_PIVOTS`` of each.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rankloom.operators.blocks import BLOCK_CELLS, from_bytes, meet_blocks, packed, slots, to_bytes
from rankloom.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PIVOTS = 1024
BLOCKS_MEETING = 8          # blocks of a side that one task joins, at most about
VISITS_TOGETHER = 1 << 15   # visiting queries per record batch
ROWS_TOGETHER = 1 << 10     # rows whose angles to all pivots are held at once


@dataclass(frozen=True)
class CellIndex:
    """Pivots (unit rows), one summary row per non-empty cell, and the written blocks."""

    pivots: np.ndarray
    summary: dict[str, np.ndarray]      # cell, rows, blocks, near, far (angles), low, high (norms)
    blocks: DataFrame                   # block, cell, rows, near, far, low, high, data


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """The rows of a list column as doubles; all need the same number of dimensions."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = len(flat) // max(len(column), 1) if dim is None else dim
    if not np.all(np.diff(offsets) == dim):
        raise ValueError("all vectors need the same number of dimensions")
    return flat.reshape(len(column), dim)


def angles(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norm of each row, its angle to every pivot); a row of norm 0 has angle 0 to all."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    cosines = np.where(norms[:, None] > 0, vectors @ pivots.T / np.where(norms > 0, norms, 1.0)[:, None], 1.0)
    return norms, np.arccos(np.clip(cosines, -1.0, 1.0))


def upper_bound(angle: np.ndarray, norm: np.ndarray, near, far, low, high) -> np.ndarray:
    """No vector of a ring scores more with a query at ``angle`` to the pivot; rounding is allowed for."""
    cosine = np.cos(np.maximum(0.0, np.maximum(angle - far, near - angle)))
    return norm * np.maximum(cosine * low, cosine * high) + 1e-6 * norm * high + 1e-8


def choose_pivots(vectors: DataFrame, limit: int = MAX_PIVOTS) -> np.ndarray:
    """About as many different vectors as the root of the table's size, chosen by hash, as unit rows."""
    rows = vectors.count()
    wanted = int(min(max(round(rows ** 0.5), 1), limit))
    drawn = F.pmod(F.xxhash64("embedding", F.lit(11)), F.lit(1 << 30))
    # Copies share a hash and are one row before anything is ordered.
    sample = (vectors.where(F.col("embedding").isNotNull()).select("embedding", drawn.alias("drawn"))
              .where(F.col("drawn") < int(min(1.0, 8 * wanted / max(rows, 1)) * (1 << 30)) + 1)
              .groupBy("drawn").agg(F.first("embedding").alias("embedding")).orderBy("drawn").limit(wanted))
    found = [np.asarray(r["embedding"], dtype=np.float64) for r in sample.collect()]
    found = [v / np.linalg.norm(v) for v in found if np.all(np.isfinite(v)) and np.linalg.norm(v) > 0]
    if found:
        return np.array(found)
    # Nothing was drawn, or zeros alone: one cell around an axis is right too.
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    return np.eye(1, max(dim, 1))


def _placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each vector with its ``cell``, its ``angle`` to the pivot, its ``norm`` and a ``row`` number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(start, ROWS_TOGETHER)
                norms, angle = angles(matrix(part.column("embedding"), pivots.shape[1]), pivots)
                cell = np.argmin(angle, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell]), pa.array(norms),
                     pa.array(np.arange(number, number + len(cell)))], [*part.schema.names, "cell", "angle", "norm", "row"])
                number += len(cell)

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, *_PLACE.fields]))


_PLACE = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()),
                       T.StructField("norm", T.DoubleType()), T.StructField("row", T.LongType())])
_BLOCK = "block bigint, cell int, rows bigint, near double, far double, low double, high double, data binary"


def _packed(placed: DataFrame, size: int) -> DataFrame:
    """Blocks of one cell with at most ``size`` numbers, or one row, in order of the angle."""
    ordered = placed.repartitionByRange("cell", "angle", "row").sortWithinPartitions("cell", "angle", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            angle, norm = table["angle"].to_numpy(), table["norm"].to_numpy()
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "cell": pa.array([held[0].column("cell")[0].as_py()], pa.int32()),
                "rows": pa.array([table.num_rows], pa.int64()), "near": [angle.min()], "far": [angle.max()],
                "low": [norm.min()], "high": [norm.max()], "data": pa.array([to_bytes(table)], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            most = max(1, size // (matrix(batch.column("embedding").slice(0, 1)).shape[1] + 1))
            borders = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for start, stop in zip(borders, borders[1:]):
                if held and held[0].column("cell")[0].as_py() != cell[start]:
                    yield block()
                    number, held, count = number + 1, [], 0
                while start < stop:
                    if count >= most:
                        yield block()
                        number, held, count = number + 1, [], 0
                    taken = min(stop - start, most - count)
                    held.append(batch.slice(start, taken))
                    start, count = start + taken, count + taken
        if held:
            yield block()

    return ordered.mapInArrow(run, _BLOCK)


def build_cells(vectors: DataFrame, path: str, size: int = BLOCK_CELLS, max_pivots: int = MAX_PIVOTS) -> str:
    """Write the cells of ``doc_id, embedding[, title]`` to a folder; vectors should be a written table, it is read three times.

    All vectors need the same number of dimensions, which may be of any length. Repeated rows and ids stay as they are.
    """
    pivots = choose_pivots(vectors, max_pivots)
    vectors.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>") \
        .coalesce(1).write.parquet(f"{path}/pivots")
    _packed(_placed(vectors, pivots), size).write.parquet(f"{path}/blocks")
    return path


def open_cells(spark: SparkSession, path: str) -> CellIndex:
    pivots = np.array([r["pivot"] for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()])
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    rows = blocks.groupBy("cell").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("blocks"), F.min("near").alias("near"), F.max("far").alias("far"),
        F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell").collect()
    names = ("cell", "rows", "blocks", "near", "far", "low", "high")
    return CellIndex(pivots, {n: np.array([r[n] for r in rows]) for n in names}, blocks)


def _bounds(part: pa.RecordBatch, index: CellIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bound, angle) of every row to every non-empty cell, and the norm of every row."""
    s = index.summary
    norms, angle = angles(matrix(part.column("embedding"), index.pivots.shape[1]), index.pivots[s["cell"]])
    return upper_bound(angle, norms[:, None], s["near"], s["far"], s["low"], s["high"]), angle, norms


def _with_homes(queries: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """``home``: places of the cells with the highest bounds that hold at least k rows together."""
    index = CellIndex(index.pivots, index.summary, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(start, ROWS_TOGETHER)
                order = np.argsort(-_bounds(part, index)[0], axis=1, kind="stable")
                within = np.cumsum(index.summary["rows"][order], axis=1)
                needed = 1 + np.sum(within < k, axis=1)
                homes = [o[:n].tolist() for o, n in zip(order, needed)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(homes, pa.list_(pa.int32()))], [*part.schema.names, "home"])

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("home", T.ArrayType(T.IntegerType()))]))


def _chosen(part: pa.RecordBatch, bounds: np.ndarray, at_home: bool) -> np.ndarray:
    """Which cells each query visits."""
    home = np.zeros(bounds.shape, dtype=bool)
    lists = part.column("home")
    home[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
    # Written so that bounds which are no numbers are visited.
    return home if at_home else ~home & ~(bounds < part.column("floor").to_numpy()[:, None])


def _visits_after(queries: DataFrame, index: CellIndex) -> int:
    """How many rows the second round of visits would move."""
    index = CellIndex(index.pivots, index.summary, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(start, ROWS_TOGETHER)
                yield pa.RecordBatch.from_pydict({"n": pa.array([int(_chosen(part, _bounds(part, index)[0], False).sum())])})

    return queries.select("embedding", "home", "floor").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _visits(queries: DataFrame, index: CellIndex, at_home: bool) -> DataFrame:
    """A row per query and cell that it visits: its home, or all other cells whose bound reaches its floor."""
    index = CellIndex(index.pivots, index.summary, None)
    kept = [f for f in queries.schema.fields if f.name != "home"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(start, ROWS_TOGETHER)
                bounds, angle, norms = _bounds(part, index)
                rows, places = np.nonzero(_chosen(part, bounds, at_home))
                own = part.select([f.name for f in kept])
                for low in range(0, len(rows), VISITS_TOGETHER):
                    row, place = rows[low:low + VISITS_TOGETHER], places[low:low + VISITS_TOGETHER]
                    yield pa.RecordBatch.from_arrays(
                        [*own.take(pa.array(row)).columns, pa.array(index.summary["cell"][place].astype(np.int32)),
                         pa.array(angle[row, place]), pa.array(norms[row]), pa.array(np.arange(number, number + len(row)))],
                        [*own.schema.names, "cell", "angle", "norm", "row"])
                    number += len(row)

    return queries.mapInArrow(run, T.StructType([*kept, *_PLACE.fields]))


def reached(visitors: pa.Table, near: float, far: float, low: float, high: float) -> pa.Table:
    """The visiting queries whose floor a ring can reach."""
    bound = upper_bound(visitors["angle"].to_numpy(), visitors["norm"].to_numpy(), near, far, low, high)
    return visitors.filter(pa.array(~(bound < visitors["floor"].to_numpy())))


def _meet(visits: DataFrame, index: CellIndex, size: int, opened: Callable, kernel: Callable, schema: T.StructType) -> DataFrame:
    """What the kernel finds for the visiting queries in the rings that they can reach."""
    spark = visits.sparkSession
    visitors = stage(_packed(visits, size), "visitors")
    arrived = dict(visitors.groupBy("cell").count().collect())
    slots = spark.createDataFrame(
        [(int(c), -(-int(n) // BLOCKS_MEETING), -(-arrived[c] // BLOCKS_MEETING))
         for c, n in zip(index.summary["cell"], index.summary["blocks"]) if c in arrived], "cell int, n_own int, n_come int")
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # At most a row per pivot.
    slots = F.broadcast(slots)
    own = index.blocks.join(slots, "cell").select("cell", dealt("n_own").alias("own"), every("n_come").alias("come"),
                                                  "near", "far", "low", "high", F.col("data").alias("vectors"))
    come = visitors.join(slots, "cell").select("cell", every("n_own").alias("own"), dealt("n_come").alias("come"),
                                               F.col("data").alias("visitors"))
    met = own.join(come, ["cell", "own", "come"]).select("near", "far", "low", "high", "vectors", "visitors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asking = from_bytes(batch.column("visitors")[i].as_buffer())
                asking = reached(asking, *(batch.column(j)[i].as_py() for j in range(4)))
                if not asking.num_rows:
                    continue
                block, floors = opened(from_bytes(batch.column("vectors")[i].as_buffer())), asking["floor"].combine_chunks()
                for found in kernel(opened(asking), block):
                    place = pc.index_in(found.column("query_id"), value_set=asking["doc_id"].combine_chunks())
                    enough = pc.greater_equal(found.column("score"), floors.take(place))
                    yield found.filter(pc.fill_null(enough, True))

    return met.mapInArrow(run, schema)


def search_cells(queries: DataFrame, index: CellIndex, k: int, opened: Callable, kernel: Callable,
                 merge: Callable[[DataFrame], DataFrame], schema: T.StructType, size: int = BLOCK_CELLS) -> DataFrame:
    """The rows that ``merge`` keeps of what ``kernel`` finds for ``doc_id, embedding`` in all vectors of the index.

    ``opened`` makes of an Arrow table what the kernel takes; ``merge`` ranks found rows as ``query_id, rank, ..., score``.
    Queries with an equal or null id share a floor or have none; they are answered like in a search without cells.
    An empty index has no answers.
    """
    spark = queries.sparkSession
    if not len(index.summary["cell"]):
        return merge(spark.createDataFrame([], schema))
    asked = stage(_with_homes(queries.select("doc_id", "embedding"), index, k), "queries")
    at_home = _visits(asked.withColumn("floor", F.lit(float("-inf"))), index, True)
    first = stage(_meet(at_home, index, size, opened, kernel, schema), "first-round")
    floors = merge(first).where(F.col("rank") == k).groupBy("query_id").agg(F.max("score").alias("floor"))
    bounded = (asked.join(floors.withColumnRenamed("query_id", "doc_id"), "doc_id", "left")
               .withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    bounded = stage(bounded, "bounded")
    if _visits_after(bounded, index) > bounded.count() * slots(int(index.summary["blocks"].sum())):
        together = stage(packed(asked.select("doc_id", "embedding"), "embedding", size), "blocks")
        return merge(meet_blocks(together, index.blocks.select("block", "data"), opened, kernel, schema))
    second = _meet(_visits(bounded, index, False), index, size, opened, kernel, schema)
    return merge(first.unionByName(second))

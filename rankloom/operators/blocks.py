"""Two tables whose rows all meet, block by block, in tasks.

Both sides are packed into blocks of bounded size, one row each. The blocks of a side are dealt into slots; slot meets slot in a
task, each block travelling once to every slot of the other side. Nothing but counts reaches the driver, and no
row of a pair is made before a kernel has seen the two blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_CELLS = 1 << 18
# Blocks of a slot, about, and slots of a side that has as many blocks.
SLOT_BLOCKS, LEAST_SLOTS = 8, 4
# How much larger the blocks are that pass by.
RIGHT_TIMES = 4


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: pa.Buffer) -> pa.Table:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_all()


def packed(vectors: DataFrame, list_column: str, cells: int = BLOCK_CELLS) -> DataFrame:
    """``block, data``: consecutive rows with at most ``cells`` numbers in a list column, or one row, as Arrow data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()),
                                               "data": pa.array([to_bytes(pa.Table.from_batches(held))], pa.binary())})

        for batch in batches:
            sizes = np.diff(batch.column(batch.schema.get_field_index(list_column)).offsets.to_numpy()).astype(np.int64) + 1
            part = np.cumsum(sizes) // cells
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            for start, stop in zip(starts, np.append(starts[1:], len(part))):
                own = int(sizes[start:stop].sum())
                if held and size + own > cells:
                    yield block()
                    held, size, number = [], 0, number + 1
                held.append(batch.slice(start, stop - start))
                size += own
        if held:
            yield block()

    return vectors.mapInArrow(run, "block bigint, data binary")


def _dealt(blocks: DataFrame, side: int, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    return blocks.select(F.pmod(F.xxhash64("block"), F.lit(n_own)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
                         F.lit(side).alias("side"), "block", "data").select("l", "r", "side", "block", "data")


def slots(blocks: int) -> int:
    """Into how many slots that many blocks are dealt: a block travels once to each slot of the other side."""
    return max(-(-blocks // SLOT_BLOCKS), min(blocks, LEAST_SLOTS), 1)


def meet_blocks(left: DataFrame, right: DataFrame, opened: Callable, kernel: Callable, schema: T.StructType | str) -> DataFrame:
    """What ``kernel`` yields for every block of ``left`` with every block of ``right``, both packed and written.

    ``opened`` makes of a block's Arrow table what the kernel takes. A task holds the blocks of one slot of ``left``, and those
    of a slot of ``right`` pass by them one at a time.
    """
    n_left, n_right = (slots(side.count()) for side in (left, right))
    met = (_dealt(left, 0, "l", n_left, "r", n_right).unionByName(_dealt(right, 1, "r", n_right, "l", n_left))
           .repartition("l", "r").sortWithinPartitions("l", "r", "side", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("l", "r", "side")))
            for i, (l, r, side) in enumerate(places):
                if key != (l, r):
                    key, held = (l, r), []
                block = opened(from_bytes(batch.column("data")[i].as_buffer()))
                if side == 0:
                    held.append(block)
                    continue
                for one in held:
                    yield from kernel(one, block)

    return met.mapInArrow(run, schema)


def meet_tables(left: DataFrame, right: DataFrame, list_column: str, opened: Callable, kernel: Callable,
                schema: T.StructType | str, cells: int = BLOCK_CELLS) -> DataFrame:
    """``meet_blocks`` of two tables of vectors; larger blocks on the right give a row of the left fewer answers to merge."""
    sides = [stage(packed(side, list_column, most), "blocks") for side, most in ((left, cells), (right, RIGHT_TIMES * cells))]
    return meet_blocks(*sides, opened, kernel, schema)

"""Groups in sorted partitions, as they stream through a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold every group they touch completely; the rows come sorted by ``keys``."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        values = [held[c].combine_chunks() for c in keys]
        open_rows = np.logical_and.reduce([k.to_numpy(zero_copy_only=False) == k[-1].as_py() for k in values])
        whole = int(np.argmax(open_rows))
        if whole:
            yield held.slice(0, whole).combine_chunks()
            held = held.slice(whole)
    if held is not None:
        yield held.combine_chunks()


def group_bounds(table: pa.Table, keys: Sequence[str]) -> list[tuple[int, int]]:
    """(start, end) of each group of a table from ``whole_groups``."""
    values = [table[c].to_numpy() for c in keys]
    starts = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in values])))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]))


def meet_in_parts(members: DataFrame, part: Column, parts: Column) -> DataFrame:
    """Every member once for each part of its group: ``left_part, right_part`` name the two parts that meet, ``side``
    is 1 for members of the right one (0 where a part meets itself)."""
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    return (members.withColumn("own", part).withColumn("other", other)
            .withColumn("left_part", F.least("own", "other")).withColumn("right_part", F.greatest("own", "other"))
            .withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0)).drop("own", "other"))


def chains(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of n places reaches along the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(before, root):
            return root

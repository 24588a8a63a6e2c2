"""Packing documents into training sequences of several lengths.

Windows have lengths 2048, 1024, 512, ... A document goes to the tier of the smallest window that holds it; one longer
than the largest window first fills whole ones. From the longest tier down, each document opens a window, and the gap
behind it is filled from the shorter tiers, the best fitting piece first; if none fits, one is cut to fill the gap
exactly. What the last open windows hold is cut into windows of powers of two, so that no sequence needs padding.
Sequences of one length are dealt to step groups of equal tokens so that their attention work (the sum of squared piece
lengths) is balanced. Sequences that do not fill a group yet wait for the next ones of their length, so only the last group
of a length in a task has fewer tokens.

Each input partition is packed as it streams by, a bounded pool at a time, without a shuffle: no task holds more than its
pool, and a lost task is packed again from its own rows. Sequence ids hold the partition's number.

Defined cases: null text counts as '', which is one piece of one token (the end id). Repeated rows are documents of their
own; null ids stay null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.llm.tokens import text_slices, word_encoder

END_ID = 1
PARTITION_BITS = 36


class Pool:
    """Pieces that wait for a window, by length; the longest of at most a given length is found in one step."""

    def __init__(self):
        self.waiting: dict[int, list[tuple[int, int]]] = {}
        self.lengths = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.waiting.setdefault(length, []).append((doc, start))
        self.lengths |= 1 << length

    def longest(self, most: int) -> int:
        """The largest waiting length up to ``most``, or 0."""
        return max((self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)

    def shortest_above(self, least: int) -> int:
        above = self.lengths >> (least + 1)
        return least + (above & -above).bit_length() if above else 0

    def take(self, length: int) -> tuple[int, int]:
        found = self.waiting[length]
        piece = found.pop()
        if not found:
            del self.waiting[length]
            self.lengths &= ~(1 << length)
        return piece


def fill_windows(pool: Pool, windows: list[int], last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(window, pieces) with pieces (document, start, length) that fill the window exactly.

    Unless ``last``, what cannot fill a window any more goes back to the pool.
    """
    for window in windows:
        while opener := pool.longest(window):
            if opener <= window // 2 and window != windows[-1]:
                break
            pieces = [(*pool.take(opener), opener)]
            gap = window - opener
            while gap:
                if fits := pool.longest(gap):
                    pieces.append((*pool.take(fits), fits))
                    gap -= fits
                elif longer := pool.shortest_above(gap):
                    doc, start = pool.take(longer)
                    pieces.append((doc, start, gap))
                    pool.add(doc, start + gap, longer - gap)
                    gap = 0
                else:
                    break
            if not gap:
                yield window, pieces
                continue
            if not last:
                for piece in pieces:
                    pool.add(*piece)
                return
            yield from cut_in_powers(pieces, window)


def cut_in_powers(pieces: list[tuple[int, int, int]], window: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces in order, cut into windows that are powers of two, the largest first."""
    left = sum(length for _, _, length in pieces)
    pieces = pieces[::-1]
    while left:
        size, part = 1 << (left.bit_length() - 1), []
        gap = size
        while gap:
            doc, start, length = pieces.pop()
            part.append((doc, start, min(length, gap)))
            if length > gap:
                pieces.append((doc, start + gap, length - gap))
            gap -= part[-1][2]
        left -= size
        yield size, part


def balanced_groups(sequences: list[tuple[int, list]], step_tokens: int) -> list[int]:
    """The step group of each sequence, from 0: equal tokens, sequences of one length, attention work spread evenly."""
    groups, first = [0] * len(sequences), 0
    for window in sorted({w for w, _ in sequences}, reverse=True):
        members = [i for i, (w, _) in enumerate(sequences) if w == window]
        work = {i: sum(length * length for _, _, length in sequences[i][1]) for i in members}
        members.sort(key=lambda i: -work[i])
        n = -(-len(members) * window // step_tokens)
        for place, i in enumerate(members):
            turn, at = divmod(place, n)
            groups[i] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return groups


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text_column: str = "text", largest: int = 2048,
         tiers: int = 4, pool_tokens: int = 1 << 20, step_tokens: int = 1 << 14) -> DataFrame:
    """One row per piece: ``key, start, length, ids, doc_tokens, sequence_id, offset, window, step_group``.

    ``ids`` holds the token ids as little-endian unsigned 32-bit numbers. A document's ids end with the end id.
    """
    windows = [largest >> i for i in range(tiers)]
    id_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("window", T.IntegerType()), T.StructField("step_group", T.LongType())])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_id = TaskContext.get().partitionId() << PARTITION_BITS
        yield from pack_stream(batches, word_encoder(tokenizer_path).encode, windows, pool_tokens, step_tokens,
                               first_id, arrow_schema)

    return docs.select(docs[key], docs[text_column]).toDF(key, "_text").mapInArrow(run, schema)


def pack_stream(batches: Iterator[pa.RecordBatch], encode: Callable, windows: list[int], pool_tokens: int,
                step_tokens: int, first_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pool, held, state = Pool(), {}, {"doc": 0, "tokens": 0, "sequence": first_id, "group": first_id}
    waiting: dict[int, list[tuple[int, list]]] = {}

    def grouped(sequences: Iterator[tuple[int, list]], last: bool) -> list[tuple[int, list]]:
        """The sequences that fill whole step groups; at the end, all."""
        for sequence in sequences:
            waiting.setdefault(sequence[0], []).append(sequence)
            state["tokens"] -= sequence[0]
        ready = []
        for window, own in waiting.items():
            per_group = max(step_tokens // window, 1)
            n = len(own) if last else len(own) - len(own) % per_group
            ready += own[:n]
            waiting[window] = own[n:]
        return ready

    def emit(sequences: list[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
        rows, groups = [[] for _ in schema], balanced_groups(sequences, step_tokens)
        for (window, pieces), group in zip(sequences, groups):
            offset = 0
            for doc, start, length in pieces:
                name, ids, _ = held[doc]
                for column, value in zip(rows, (name, start, length, ids[start:start + length].tobytes(), len(ids),
                                                state["sequence"], offset, window, state["group"] + group)):
                    column.append(value)
                offset += length
                held[doc][2] -= length
                if not held[doc][2]:
                    del held[doc]
            state["sequence"] += 1
        state["group"] += max(groups, default=-1) + 1
        if sequences:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, schema)], schema=schema)

    for batch in batches:
        for part in text_slices(batch, "_text"):
            flat, counts = encode(part.column(1))
            ends = np.cumsum(counts)
            for name, end, count in zip(part.column(0).to_pylist(), ends, counts):
                ids = np.append(flat[end - count:end], np.uint32(END_ID)).astype("<u4")
                doc, whole = state["doc"], len(ids) - len(ids) % windows[0]
                held[doc] = [name, ids, len(ids)]
                state["doc"] += 1
                state["tokens"] += len(ids)
                for start in range(0, whole, windows[0]):
                    pool.add(doc, start, windows[0])
                if len(ids) > whole:
                    pool.add(doc, whole, len(ids) - whole)
                if state["tokens"] >= pool_tokens:
                    yield from emit(grouped(fill_windows(pool, windows, False), False))
    yield from emit(grouped(fill_windows(pool, windows, True), False))
    yield from emit(grouped(iter(()), True))

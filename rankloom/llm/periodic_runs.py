"""Maximal periodic runs of words, found with a difference cover.

A run is a stretch of words with smallest period q, at least ``max(min_length, min_repeats * q)`` long, that neither
neighbouring word extends.

1. Sampled suffixes: of every ``COVER_SIZE`` places those whose remainder is in ``COVER``. Any two places reach sampled ones
   after the same number of at most ``COVER_SIZE - 1`` words. Only sampled suffixes are sorted, by blocks of words and then by
   prefix doubling; a sparse table over the common prefixes of neighbours in that order answers range minima.
2. The longest common extension of two places compares the few words up to the synchronised samples, then looks up the
   minimum between their ranks. The same over the words in reverse gives extensions to the left.
3. For each period q the places 0, q, 2q, ... form a grid, n/1 + n/2 + ... places in all. A run covers three grid places in
   a row whose words recur q words on; where that is so, the extensions to both sides give its borders. Of runs with equal
   borders the one with the smallest period counts.

A slice of texts is handled as one sequence of word numbers with a gap between texts. Texts are never cut: a slice is one
text, or several of ``SLICE_BYTES`` together. Memory in a task is about 250 bytes per word of texts with candidates, besides
``GRID`` grid places at a time.

Defined cases: null or blank text has no words, no runs and collapses to ''. Texts shorter than a run have none. Repeated
rows are documents of their own. An empty table gives an empty result. Only the key and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, ArrayType, LongType

from rankloom.llm.tokens import ragged, text_slices
from rankloom.llm.words import arrow_words

MIN_LENGTH, MIN_REPEATS = 6, 4
# Every difference modulo 13 is one of two members.
COVER_SIZE, COVER = 13, (0, 1, 3, 9)
SLICE_BYTES = 2 << 20
GRID = 1 << 20
# Candidates that are extended at once, and the length from which a run is held against later candidates.
EXTENDED = 1 << 17
LARGE = 1 << 12

IN_COVER = np.isin(np.arange(2 * COVER_SIZE) % COVER_SIZE, COVER)
# Number of sampled places before a remainder, and words until two remainders are both sampled.
SLOT = np.cumsum(IN_COVER[:COVER_SIZE]) - IN_COVER[:COVER_SIZE]
SYNC = np.array([[next(d for d in range(COVER_SIZE) if IN_COVER[a + d] and IN_COVER[b + d]) for b in range(COVER_SIZE)]
                 for a in range(COVER_SIZE)])

RUN_FIELDS = [StructField(name, LongType()) for name in ("start", "length", "period")]


@dataclass
class Runs:
    """Runs by text, start and period; ``start`` and ``end`` are places in the whole sequence."""
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


class Extensions:
    """Longest common extensions to the right in a sequence of word numbers; 0 stands between and behind texts."""

    def __init__(self, symbols: np.ndarray):
        # The last block lies behind all words.
        self.size = len(symbols)
        blocks = len(symbols) // COVER_SIZE + 2
        self.symbols = np.zeros((blocks + 1) * COVER_SIZE, np.int64)
        self.symbols[:len(symbols)] = symbols
        self.places = (np.arange(blocks)[:, None] * COVER_SIZE + np.array(COVER)).ravel()
        levels = self._sort()
        order = np.argsort(levels[-1], kind="stable")
        self.rank = levels[-1]
        self.minima = self._sparse_table(self._common_prefixes(order, levels))

    def _sort(self) -> list[np.ndarray]:
        """Ranks of the samples by their first 13, 26, 52, ... words, until all are told apart."""
        bits = max(int(self.symbols.max()).bit_length(), 1)
        per_column = max(63 // bits, 1)
        columns = []
        for first in range(0, COVER_SIZE, per_column):
            packed = np.zeros(len(self.places), np.int64)
            for k in range(first, min(first + per_column, COVER_SIZE)):
                packed = packed << bits | self.symbols[self.places + k]
            columns.append(packed)
        # Samples of the last block hold no words; their places tell them apart.
        columns[-1][-len(COVER):] = np.arange(len(COVER))
        order = np.lexsort(columns[::-1])
        changed = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
        levels, step = [self._ranks(order, changed)], len(COVER)
        while levels[-1].max() < len(self.places) - 1 and step < len(self.places):
            rank = levels[-1]
            behind = np.zeros(len(rank), np.int64)
            behind[:-step] = rank[step:] + 1
            both = rank * (len(rank) + 1) + behind
            order = np.argsort(both, kind="stable")
            levels.append(self._ranks(order, both[order[1:]] != both[order[:-1]]))
            step *= 2
        return levels

    @staticmethod
    def _ranks(order: np.ndarray, changed: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changed)])
        return rank

    def _common_prefixes(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sample has in common with the next one in order."""
        x, y, n = order[:-1].copy(), order[1:].copy(), len(order)
        common = np.zeros(len(x), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            rank, step = levels[level], len(COVER) << level
            inside = (x < n) & (y < n)
            same = np.flatnonzero(inside)
            same = same[rank[x[same]] == rank[y[same]]]
            common[same] += COVER_SIZE << level
            x[same] += step
            y[same] += step
        first, second = self.places[order[:-1]] + common, self.places[order[1:]] + common
        return common + self._compare(first, second, np.full(len(first), COVER_SIZE))

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from two places on, up to ``most``, and up to the end of the sequence."""
        equal, last = np.zeros(len(a), np.int64), len(self.symbols)
        open_pairs = np.arange(len(a))
        for k in range(COVER_SIZE):
            open_pairs = open_pairs[(most[open_pairs] > k) & (np.maximum(a, b)[open_pairs] + k < last)]
            if not len(open_pairs):
                break
            open_pairs = open_pairs[self.symbols[a[open_pairs] + k] == self.symbols[b[open_pairs] + k]]
            equal[open_pairs] += 1
        return equal

    @staticmethod
    def _sparse_table(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values.astype(np.int32)], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from the places ``a`` and ``b`` (never the same one) on, within a text."""
        ahead = SYNC[a % COVER_SIZE, b % COVER_SIZE]
        result = self._compare(a, b, ahead)
        met = np.flatnonzero(result == ahead)
        x, y = (p[met] + ahead[met] for p in (a, b))
        x, y = (self.rank[p // COVER_SIZE * len(COVER) + SLOT[p % COVER_SIZE]] for p in (x, y))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        least = np.empty(len(met), np.int64)
        for k in np.unique(level):
            at = level == k
            least[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k))])
        result[met] += least
        return result


def grid_candidates(codes: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of grid places that start three in a row whose words recur a period on, shorter periods of a
    text first, ``GRID`` grid places at a time."""
    longest = np.where(sizes >= MIN_LENGTH, sizes // MIN_REPEATS, 0)
    owner = np.repeat(np.arange(len(sizes)), longest)
    period = ragged(np.ones(len(sizes), np.int64), longest)
    count = np.maximum((sizes[owner] - 1) // period - 2, 0)
    part = np.cumsum(count) // GRID
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, stop in zip(starts, np.append(starts[1:], len(part))):
        q = np.repeat(period[start:stop], count[start:stop])
        text = np.repeat(owner[start:stop], count[start:stop])
        place = base[text] + q * ragged(np.zeros(stop - start, np.int64), count[start:stop])
        for k in range(MIN_REPEATS - 1):
            same = np.flatnonzero(codes[place + k * q] == codes[place + (k + 1) * q])
            text, place, q = text[same], place[same], q[same]
        if len(place):
            yield text, place, q


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> Runs:
    """Runs of all texts of a slice, given the numbers of their words one text behind the other."""
    base = np.cumsum(sizes) - sizes
    texts = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(t) for t, _, _ in grid_candidates(codes, base, sizes))]))
    if not len(texts):
        return Runs(*[np.zeros(0, np.int64)] * 3)
    # Only texts with candidates are sorted, with a gap before and behind each.
    lengths = sizes[texts]
    inner = np.cumsum(lengths + 1) - lengths
    symbols = np.zeros(int(lengths.sum()) + len(texts) + 1, np.int64)
    symbols[ragged(inner, lengths)] = codes[ragged(base[texts], lengths)] + 1
    _, symbols = np.unique(symbols, return_inverse=True)
    rightward, leftward = Extensions(symbols), Extensions(symbols[::-1])
    runs, large = np.zeros((3, 0), np.int64), np.zeros((3, 0), np.int64)
    for _, place, period in grid_candidates(symbols, inner, lengths):
        # Four periods inside of a run whose period divides them extend to that run.
        for start, end, q in large.T:
            other = (place < start) | (place + MIN_REPEATS * period > end) | (period % q != 0)
            place, period = place[other], period[other]
        found = _extend(rightward, leftward, place, period)
        runs = _distinct(np.concatenate([runs, found], axis=1))
        large = runs[:, runs[1] - runs[0] >= LARGE]
    shift = np.repeat(base[texts] - inner, lengths + 1)
    start, end, period = runs
    move = shift[start - 1]
    order = np.lexsort((period, start + move))
    return Runs((start + move)[order], (end + move)[order], period[order])


def _extend(rightward: Extensions, leftward: Extensions, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """``start, end, period`` of the stretches of grid places that are long enough for a run."""
    size, found = leftward.size, [np.zeros((3, 0), np.int64)]
    for at in range(0, len(place), EXTENDED):
        a, q = place[at:at + EXTENDED], period[at:at + EXTENDED]
        start = a - leftward.common(size - a, size - a - q)
        end = a + q + rightward.common(a, a + q)
        long_enough = end - start >= np.maximum(MIN_LENGTH, MIN_REPEATS * q)
        found.append(_distinct(np.stack([start, end, q])[:, long_enough]))
    return np.concatenate(found, axis=1)


def _distinct(runs: np.ndarray) -> np.ndarray:
    """By borders the run with the smallest period."""
    runs = runs[:, np.lexsort(runs[::-1])]
    first = np.ones(runs.shape[1], bool)
    first[1:] = (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])
    return runs[:, first]


def kept_words(runs: Runs, n_words: int) -> np.ndarray:
    """Whether each word stays when every run keeps its first period."""
    cover = np.zeros(n_words + 1, np.int64)
    np.add.at(cover, runs.start + runs.period, 1)
    np.add.at(cover, runs.end, -1)
    return np.cumsum(cover[:-1]) == 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``key, n_words, runs, collapsed`` of every row.

    ``runs`` has structs ``start, length, period`` in words, by start and period. ``collapsed`` is the text without
    the repeats: the words outside of runs and the first period of each, joined with one space.
    """
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("n_words", LongType()),
                         StructField("runs", ArrayType(StructType(RUN_FIELDS))), StructField("collapsed", StringType())])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE_BYTES):
                sizes, codes, distinct = arrow_words(part.column("_text"))
                sizes = sizes.astype(np.int64)
                base = np.cumsum(sizes) - sizes
                runs = find_runs(codes, sizes)
                kept = kept_words(runs, len(codes))
                owner = np.searchsorted(base + sizes, runs.start, side="right")
                counts = np.bincount(owner, minlength=len(sizes))
                fields = [runs.start - base[owner], runs.end - runs.start, runs.period]
                found = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(arrow_schema[2].type.value_type)))
                ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
                words = pa.LargeListArray.from_arrays(pa.array(ends.astype(np.int64)), distinct.take(pa.array(codes[kept])))
                collapsed = pc.binary_join(words, pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), found.cast(arrow_schema[2].type),
                     collapsed.cast(arrow_schema[3].type)], schema=arrow_schema)

    return docs.select(docs[key], docs[text_column].alias("_text")).mapInArrow(run, schema)


def longest_run(runs: Column) -> Column:
    """The run of greatest length, of several the one with the smallest start, then period; null without runs."""
    ordered = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-ordered["start"]).alias("start"), ordered["length"].alias("length"),
                                             (-ordered["period"]).alias("period")))

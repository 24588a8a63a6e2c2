"""Embeddings learnt from a corpus: co-occurrence counts, positive pointwise mutual information, truncated SVD.

1. Words that stand at most ``window`` tokens apart are counted, in the tasks first.
2. The value of a pair is the logarithm of its count over what independent words would have, where that is positive.
3. The matrix of values lies in square blocks. Block power iterations multiply it with a thin matrix, itself in blocks of rows, by
   joins; a thin matrix is made orthonormal through its Gram matrix. Only matrices as wide as it, and the list of words, which
   ``max_words`` bounds, reach the driver.
4. A word's vector is its row of the leading eigenvectors, each times the root of its singular value. A text is the mean of its
   words' vectors, less the mean over the corpus.

Sums run in a fixed order, so vectors repeat from run to run. Defined cases: null text and text without known words has
a zero vector. A corpus without words in a window of each other is an error. ``dim`` is cut to the rank of the matrix.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rankloom.functions.vectors import word_signs
from rankloom.operators.grams import token_slices
from rankloom.operators.tfidf import term_stats
from rankloom.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters of text, and words with their vectors, that an encoder holds at once.
CHARS_TOGETHER, WORDS_TOGETHER = 1 << 20, 1 << 14
# Cells of a block that are multiplied together, unless one row has more.
CELLS_TOGETHER = 1 << 13


@dataclass(frozen=True)
class WordModelSettings:
    max_words: int = 20_000
    min_df: int = 2
    window: int = 4
    dim: int = 64
    oversample: int = 16
    rounds: int = 4
    block: int = 1024
    seed: int = 42


@dataclass(frozen=True)
class WordModel:
    """``vectors``: ``word, word_id, tf, vector``; ``singular_values``, the largest first; ``mean``: over all tokens."""
    vectors: DataFrame
    singular_values: np.ndarray
    mean: np.ndarray


def word_table(tokens: DataFrame, settings: WordModelSettings) -> DataFrame:
    """``word, word_id, tf``: the most frequent words, numbered alphabetically; equal counts go by the alphabet."""
    kept = (term_stats(tokens, (1, 1)).where(F.col("df") >= settings.min_df)
            .orderBy(F.desc("tf"), "term").limit(settings.max_words))
    # max_words bounds this table, so numbering it in one task is safe.
    return stage(kept.select(F.col("term").alias("word"), (F.row_number().over(Window.orderBy("term")) - 1).cast("long")
                             .alias("word_id"), "tf"), "model-words")


def cooccurrences(tokens: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """``a, b, n``: how often the words of two numbers stand at most ``window`` tokens apart, both ways."""
    listed = words.orderBy("word_id").select("word").toArrow()["word"].combine_chunks().cast("large_string")
    held = tokens.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        size = max(len(known), 1)
        for batch in token_slices(batches):
            lists = batch.column("tokens")
            coded = lists.flatten().cast("large_string").dictionary_encode()
            number = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy().astype(np.int64)
            code = number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            keys = []
            for apart in range(1, window + 1):
                a, b = code[:-apart], code[apart:]
                met = (a >= 0) & (b >= 0) & (row[:-apart] == row[apart:])
                a, b = a[met], b[met]
                keys += [a * size + b, b * size + a]
            pairs, times = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs // size), "b": pa.array(pairs % size),
                                              "n": pa.array(times.astype(np.int64))})

    return (tokens.select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
            .mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")))


def positive_information(counts: DataFrame) -> DataFrame:
    """``a, b, n, value``: ln(n * total / (row sum * column sum)), or 0 where that is negative; ``counts`` is written."""
    sums = stage(counts.groupBy("a").agg(F.sum("n").alias("row_sum")), "row-sums")
    total = sums.agg(F.sum("row_sum")).first()[0] or 0
    other = sums.select(F.col("a").alias("b"), F.col("row_sum").alias("column_sum"))
    ratio = F.col("n") * F.lit(float(total)) / (F.col("row_sum") * F.col("column_sum").cast("double"))
    return counts.join(sums, "a").join(other, "b").select("a", "b", "n", F.greatest(F.log(ratio), F.lit(0.0)).alias("value"))


BLOCK_SCHEMA = "b bigint, data binary"


def _blocks(data: pa.Array, width: int) -> list[np.ndarray]:
    return [np.frombuffer(d.as_buffer(), np.float64).reshape(-1, width) for d in data]


def _block_rows(numbers: list[int], blocks: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"b": pa.array(numbers, pa.int64()),
                                       "data": pa.array([np.ascontiguousarray(b).tobytes() for b in blocks], pa.binary())})


class ThinMatrix:
    """A matrix of few columns as rows ``b, data``, one per block of rows."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width = rows, width

    def times(self, right: np.ndarray) -> ThinMatrix:
        """This matrix times a small one."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _block_rows(batch.column("b").to_pylist(), [x @ right for x in _blocks(batch.column("data"), width)])

        return ThinMatrix(stage(self.rows.mapInArrow(run, BLOCK_SCHEMA), "thin"), right.shape[1])

    def unit_rows(self) -> ThinMatrix:
        """Its rows at length 1; rows of zeros stay."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = _blocks(batch.column("data"), width)
                norms = [np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in blocks]
                yield _block_rows(batch.column("b").to_pylist(), [x / np.where(n == 0, 1.0, n) for x, n in zip(blocks, norms)])

        return ThinMatrix(stage(self.rows.mapInArrow(run, BLOCK_SCHEMA), "thin"), width)

    def plus(self, other: ThinMatrix) -> ThinMatrix:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(_blocks(batch.column("data"), width), _blocks(batch.column("second"), width))
                yield _block_rows(batch.column("b").to_pylist(), [x + y for x, y in pairs])

        both = self.rows.join(other.rows.withColumnRenamed("data", "second"), "b").select("b", "data", "second")
        return ThinMatrix(stage(both.mapInArrow(run, BLOCK_SCHEMA), "thin"), width)

    def transposed_times(self, other: ThinMatrix) -> np.ndarray:
        """The small product of this matrix, transposed, with another one; blocks are summed in their order."""
        widths = self.width, other.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(_blocks(batch.column("data"), widths[0]), _blocks(batch.column("second"), widths[1]))
                yield _block_rows(batch.column("b").to_pylist(), [x.T @ y for x, y in pairs])

        both = self.rows.join(other.rows.withColumnRenamed("data", "second"), "b").select("b", "data", "second")
        parts = both.mapInArrow(run, BLOCK_SCHEMA).orderBy("b").toLocalIterator()
        return sum(np.frombuffer(p["data"]).reshape(widths) for p in parts)

    def orthonormal(self) -> ThinMatrix:
        """A basis of its columns; twice, since one round loses half of the digits."""
        found = self
        for _ in range(2):
            size, axes = np.linalg.eigh(found.transposed_times(found))
            kept = size > size[-1] * 1e-13
            found = found.times(axes[:, kept] / np.sqrt(size[kept]))
        return found


def add_block(total: np.ndarray, at: np.ndarray, to: np.ndarray, value: np.ndarray, other: np.ndarray) -> None:
    """Add to ``total`` the product of one block, its cells sorted by ``at``, with the rows of ``other``."""
    bounds = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CELLS_TOGETHER, side="right")) - 1)
        some, own = bounds[low:high], slice(bounds[low], bounds[high])
        total[at[some]] += np.add.reduceat(other[to[own]] * value[own, None], some - some[0])
        low = high


class BlockMatrix:
    """A square matrix as rows ``i, j, at, to, value``: the cells of one block."""

    def __init__(self, cells: DataFrame, n: int, block: int):
        self.n, self.block = n, block
        placed = cells.select((F.col("a") / block).cast("int").alias("i"), (F.col("b") / block).cast("int").alias("j"),
                              F.struct((F.col("a") % block).cast("int").alias("at"), (F.col("b") % block).cast("int").alias("to"),
                                       "value").alias("cell"))
        self.rows = stage(placed.groupBy("i", "j").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
                          .select("i", "j", F.col("cells.at").alias("at"), F.col("cells.to").alias("to"),
                                  F.col("cells.value").alias("value")), "matrix")

    def random(self, spark, width: int, seed: int) -> ThinMatrix:
        n, block = self.n, self.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield _block_rows(ids, [np.random.default_rng([seed, i]).standard_normal((min(block, n - i * block), width))
                                        for i in ids])

        return ThinMatrix(stage(spark.range(-(-n // block)).mapInArrow(run, BLOCK_SCHEMA), "thin"), width)

    def times(self, thin: ThinMatrix) -> ThinMatrix:
        """This matrix times a thin one: blocks meet by a join on the inner number, products by one on the outer."""
        n, block, width = self.n, self.block, thin.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_row, total = None, None
            for batch in batches:
                names = batch.column("i").to_pylist()
                for k, (i, other) in enumerate(zip(names, _blocks(batch.column("data"), width))):
                    if i != open_row:
                        if open_row is not None:
                            yield _block_rows([open_row], [total])
                        open_row, total = i, np.zeros((min(block, n - i * block), width))
                    add_block(total, *(batch.column(c)[k].values.to_numpy() for c in ("at", "to", "value")), other)
            if open_row is not None:
                yield _block_rows([open_row], [total])

        met = (self.rows.join(thin.rows.withColumnRenamed("b", "j"), "j").select("i", "j", "at", "to", "value", "data")
               .repartition("i").sortWithinPartitions("i", "j"))
        product = stage(met.mapInArrow(run, BLOCK_SCHEMA), "thin")
        # Blocks of rows without a cell are zero.
        empty = self.random(product.sparkSession, 1, 0).rows.select("b").join(product, "b", "left")

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, data = batch.column("b").to_pylist(), batch.column("data").to_pylist()
                yield _block_rows(ids, [np.zeros((min(block, n - i * block), width)) if d is None else
                                        np.frombuffer(d).reshape(-1, width) for i, d in zip(ids, data)])

        return ThinMatrix(stage(empty.mapInArrow(fill, BLOCK_SCHEMA), "thin"), width)


def leading_eigenvectors(matrix: BlockMatrix, spark, settings: WordModelSettings) -> tuple[np.ndarray, ThinMatrix]:
    """(eigenvalues by falling size, eigenvectors) of a symmetric matrix by power iterations on a random block."""
    width = min(settings.dim + settings.oversample, matrix.n)
    basis = matrix.times(matrix.random(spark, width, settings.seed)).orthonormal()
    for _ in range(settings.rounds):
        basis = matrix.times(basis).orthonormal()
    small = basis.transposed_times(matrix.times(basis))
    values, axes = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")
    order = order[np.abs(values[order]) > 1e-12][:settings.dim]
    axes = axes[:, order]
    # A vector and its negative are the same axis: the largest part is positive.
    axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])])
    return values[order], basis.times(axes)


def fit_word_model(tokens: DataFrame, settings: WordModelSettings = WordModelSettings()) -> WordModel:
    """Learn word vectors from a written table ``doc_id, tokens``."""
    spark = tokens.sparkSession
    words = word_table(tokens, settings)
    n = words.count()
    cells = positive_information(stage(cooccurrences(tokens, words, settings.window), "cooccurrences")).where("value > 0")
    matrix = BlockMatrix(cells, n, settings.block)
    if not n or matrix.rows.isEmpty():
        raise ValueError("no words stand close to each other: lower min_df or widen the window")
    values, thin = leading_eigenvectors(matrix, spark, settings)
    return _word_model(words, thin.times(np.diag(np.sqrt(np.abs(values)))), settings, np.abs(values))


def fit_propagated_model(tokens: DataFrame, settings: WordModelSettings = WordModelSettings()) -> WordModel:
    """Learn word vectors from a written table ``doc_id, tokens`` by ``settings.rounds`` rounds over the words that stand together.

    A word begins with the signs of its md5, as a vector that knows nothing of the corpus. In every round it takes the sum of its
    neighbours' vectors, each times the positive pointwise mutual information of the two, at length 1; its vector is the sum of all
    rounds (random projections of the powers of the matrix, as in FastRP). Unlike ``fit_word_model`` it has no eigenvectors, so any
    engine gets the same. Words without such neighbours have a zero vector, as all have in a corpus without words.
    """
    spark = tokens.sparkSession
    words = word_table(tokens, settings)
    listed = words.orderBy("word_id").select("word").toArrow()["word"].to_pylist()
    cells = positive_information(stage(cooccurrences(tokens, words, settings.window), "cooccurrences")).where("value > 0")
    n, block, dim = len(listed), settings.block, settings.dim
    matrix, held = BlockMatrix(cells, n, block), spark.sparkContext.broadcast(listed)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield _block_rows(ids, [word_signs(held.value[i * block:(i + 1) * block], dim) for i in ids])

    round_ = ThinMatrix(stage(spark.range(-(-n // block)).mapInArrow(signs, BLOCK_SCHEMA), "thin"), dim)
    total = None
    for _ in range(settings.rounds):
        round_ = matrix.times(round_).unit_rows()
        total = round_ if total is None else total.plus(round_)
    return _word_model(words, total, settings, np.zeros(0))


def _word_model(words: DataFrame, scaled: ThinMatrix, settings: WordModelSettings, singular_values: np.ndarray) -> WordModel:
    """The model whose vectors are the rows of a thin matrix."""
    block, width = settings.block, scaled.width

    def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column("b").to_pylist(), _blocks(batch.column("data"), width)):
                offsets = np.arange(len(data) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_pydict({
                    "word_id": pa.array(i * block + np.arange(len(data))),
                    "vector": pa.ListArray.from_arrays(pa.array(offsets), pa.array(data.ravel()))})

    vectors = stage(words.join(scaled.rows.mapInArrow(as_rows, "word_id bigint, vector array<double>"), "word_id")
                    .select("word", "word_id", "tf", "vector"), "word-vectors")
    listed = vectors.orderBy("word_id").select("tf", "vector").toArrow()
    rows = np.vstack([np.zeros((0, width)), listed["vector"].combine_chunks().flatten().to_numpy().reshape(-1, width)])
    tf = listed["tf"].to_numpy().astype(float)
    return WordModel(vectors, singular_values, tf @ rows / max(tf.sum(), 1.0))


def word_encoder(model: WordModel) -> Callable:
    """An encoder for ``embed_column``: the mean of the known words' vectors, less the corpus's mean.

    Words lie between white space and are taken in lower case. The vectors go to all tasks; ``max_words`` bounds them.
    """
    listed = model.vectors.orderBy("word_id").select("word", "vector").toArrow()
    width = len(model.mean)
    held = model.vectors.sparkSession.sparkContext.broadcast(
        (listed["word"].combine_chunks().cast("large_string"),
         listed["vector"].combine_chunks().flatten().to_numpy().reshape(-1, width) - model.mean))

    def encode(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("")
        # Texts of about as many characters go together.
        part = np.cumsum(texts.str.len().to_numpy(np.int64)) // CHARS_TOGETHER
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        rows = [encode_some(texts.iloc[a:b]) for a, b in zip(starts, np.append(starts[1:], len(texts)))]
        return pd.Series([vector for some in rows for vector in some])

    def encode_some(texts: pd.Series) -> np.ndarray:
        known, vectors = held.value
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        number = pc.index_in(lists.flatten(), value_set=known)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        met = pc.is_valid(number).to_numpy(zero_copy_only=False)
        row, number = row[met], number.drop_null().to_numpy()
        sums = np.zeros((len(lists), width))
        for low in range(0, len(row), WORDS_TOGETHER):
            some = slice(low, low + WORDS_TOGETHER)
            first = np.flatnonzero(np.diff(row[some], prepend=-1))
            sums[row[some][first]] += np.add.reduceat(vectors[number[some]], first)
        return sums / np.maximum(np.bincount(row, minlength=len(lists)), 1)[:, None]

    as_vectors = F.pandas_udf(encode, T.ArrayType(T.DoubleType()))
    return lambda text: as_vectors(F.lower(text))

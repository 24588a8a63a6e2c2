"""Model inputs of whole texts: words cut into the longest known pieces, then padded or truncated.

The vocabulary is a table ``piece, piece_id`` that comes from a file; nothing is learnt here. From the start of a word the longest piece
is taken that the vocabulary holds, then the longest one behind it, and so on. A piece inside a word may carry a mark in front
(``##``), and the piece that ends a word one behind (``</w>``). A word with a place where no piece fits is unknown as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PIECES = 1_000_000      # rows of a vocabulary, which travels with the tasks
MAX_REMEMBERED = 300_000    # words whose pieces a worker remembers; emptied when full


@dataclass(frozen=True)
class Pieces:
    """A vocabulary with its marks and the ids that are not words."""

    ids: dict[str, int]
    unknown: int
    pad: int
    first: int | None = None    # put before every text
    last: int | None = None     # put behind every text
    inside: str = "##"
    end: str = ""
    max_word: int = 100         # longer words are unknown

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=0)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``piece, piece_id`` of a tokenizer file in JSON that lists its vocabulary under ``model``."""
    vocabulary = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,int>")
    return spark.read.text(path, wholetext=True).select(F.explode(vocabulary).alias("piece", "piece_id"))


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """``piece, piece_id`` of the marks that such a file adds to its vocabulary; no word is cut into them."""
    added = F.from_json(F.get_json_object("value", "$.added_tokens"), "array<struct<content string, id int>>")
    return (spark.read.text(path, wholetext=True).select(F.explode(added).alias("mark"))
            .select(F.col("mark.content").alias("piece"), F.col("mark.id").alias("piece_id")))


def collect_pieces(table: DataFrame) -> dict[str, int]:
    """The vocabulary for the tasks, once it is known to be small. Rows without a piece or an id are left out."""
    table = table.select("piece", "piece_id").dropna()
    if table.limit(MAX_PIECES + 1).count() > MAX_PIECES:
        raise ValueError(f"a vocabulary has at most {MAX_PIECES} pieces")
    return {r["piece"]: r["piece_id"] for r in table.collect()}


def word_pieces(word: str, pieces: Pieces, longest: int) -> list[int]:
    """Ids of the longest pieces from left to right, or of the unknown word."""
    if len(word) > pieces.max_word:
        return [pieces.unknown]
    found, start = [], 0
    while start < len(word):
        mark = pieces.inside if start else ""
        for stop in range(min(len(word), start + longest), start, -1):
            number = pieces.ids.get(mark + word[start:stop] + (pieces.end if stop == len(word) else ""))
            if number is not None:
                break
        else:
            return [pieces.unknown]
        found.append(number)
        start = stop
    return found


def encode_words(texts: DataFrame, pieces: Pieces, length: int = 256) -> DataFrame:
    """``input_ids, attention_mask`` of ``length`` each, and ``n_pieces`` of the whole text, next to the other columns.

    texts  ``tokens`` (words) and any other columns; null counts as no words, null words are left out. The marks of start and
    end take part in ``length`` and are kept when pieces are cut off. One pass over the rows, without a shuffle; a distinct
    word of a batch is cut once.
    """
    frame = [i for i in (pieces.first, pieces.last) if i is not None]
    room = length - len(frame)
    if room < 0:
        raise ValueError("length leaves no room for the marks of start and end")
    kept = [f for f in texts.schema.fields if f.name != "tokens"]
    clash = {"input_ids", "attention_mask", "n_pieces"} & {f.name for f in kept}
    if clash:
        raise ValueError(f"columns that the result needs are taken: {sorted(clash)}")
    longest = pieces.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, list[int]] = {}
        for batch in batches:
            lists = batch.column("tokens")
            flat = lists.flatten().dictionary_encode()
            own = []
            for word in flat.dictionary.to_pylist():
                if word not in remembered:
                    if len(remembered) >= MAX_REMEMBERED:
                        remembered.clear()
                    remembered[word] = word_pieces(word, pieces, longest)
                own.append(remembered[word])
            sizes = np.array([len(p) for p in own], dtype=np.int64)
            ids = np.array([i for p in own for i in p], dtype=np.int32)
            code = flat.indices.to_numpy()
            starts, counts = (np.cumsum(sizes) - sizes)[code], sizes[code]
            # Pieces before each word of the batch, then before each text.
            before = np.concatenate([[0], np.cumsum(counts)])
            offsets = np.zeros(batch.num_rows + 1, dtype=np.int64)
            word_counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], dtype=np.int64)
            offsets[1:] = np.cumsum(word_counts)
            total = before[offsets[1:]] - before[offsets[:-1]]
            every = ids[np.repeat(starts, counts) + np.arange(before[-1]) - np.repeat(before[:-1], counts)]

            out = np.full((batch.num_rows, length), pieces.pad, dtype=np.int32)
            real = np.minimum(total, room)
            at = np.arange(length)
            lead = 0 if pieces.first is None else 1
            if lead:
                out[:, 0] = pieces.first
            row, column = np.nonzero(at[None, :room] < real[:, None])
            out[row, column + lead] = every[before[offsets[:-1]][row] + column]
            if pieces.last is not None:
                out[np.arange(batch.num_rows), real + lead] = pieces.last
            mask = (at[None, :] < (real + len(frame))[:, None]).astype(np.int32)
            edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * length)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.ListArray.from_arrays(edges, pa.array(out.ravel())),
                 pa.ListArray.from_arrays(edges, pa.array(mask.ravel())), pa.array(total)],
                [*(f.name for f in kept), "input_ids", "attention_mask", "n_pieces"])

    words = F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda w: w.isNotNull())
    integers = T.ArrayType(T.IntegerType())
    return texts.select(*(f.name for f in kept), words.alias("tokens")).mapInArrow(run, T.StructType(
        [*kept, T.StructField("input_ids", integers), T.StructField("attention_mask", integers),
         T.StructField("n_pieces", T.LongType())]))

"""Work on the tokens of a batch of documents, inside tasks.

A document's tokens are one row, so counting and weighing its terms needs no shuffle: these kernels
see a batch of rows as flat Arrow arrays and return term totals, or one vector per document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

LARGEST = 1 << 62       # an n-gram's number must stay below
SLICE_TOKENS = 1 << 17  # tokens that a kernel works on at once, unless one row has more

# The kernels below travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def token_slices(batches: Iterator[pa.RecordBatch], column: str = "tokens", most: int = SLICE_TOKENS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices with at most ``most`` tokens in a list column, or of one row.

    A batch is bounded in rows and bytes, but what a kernel makes of its tokens is many times as large.
    """
    for batch in batches:
        offsets = batch.column(batch.schema.get_field_index(column)).offsets.to_numpy().astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, min(stop, batch.num_rows) - start)
            start = stop


def batch_grams(tokens: pa.ListArray, low: int, high: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For each n the n-grams of all rows and the row each belongs to."""
    flat = tokens.flatten().cast(pa.large_string())
    row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
    for n in range(low, high + 1):
        start = np.arange(max(len(flat) - n + 1, 0))
        start = start[row[start] == row[start + n - 1]]
        yield _joined([flat.take(pa.array(start + i)) for i in range(n)]), row[start]


def _joined(words: list[pa.Array]) -> pa.Array:
    return words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))


def distinct_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.diff(first, append=len(keys))


def gram_totals(batches: Iterator[pa.RecordBatch], low: int, high: int,
                allowed: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """``term, df, tf`` of the n-grams of each slice of a batch; with ``allowed``, of those made of allowed words.

    An n-gram is counted as one number made of its words' numbers and its row, and spelled out only once.
    """
    for batch in token_slices(batches):
        tokens = batch.column("tokens")
        flat = tokens.flatten().cast(pa.large_string())
        row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
        encoded = flat.dictionary_encode()
        words, code = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        if allowed is not None:
            usable = pc.is_in(words, value_set=allowed).to_numpy(zero_copy_only=False)
            number = np.where(usable, np.cumsum(usable) - 1, -1)
            words, code = words.filter(pa.array(usable)), number[code]
        size, rows = max(len(words), 1), max(len(tokens), 1)
        if size ** high * rows >= LARGEST:
            if rows == 1:
                yield from _totals_of_one(code, words, low, high)
                continue
            halves = [batch.slice(0, rows // 2), batch.slice(rows // 2)]
            yield from gram_totals(iter(halves), low, high, allowed)
            continue
        for n in range(low, high + 1):
            start = np.arange(max(len(code) - n + 1, 0))
            keep = row[start] == row[start + n - 1]
            gram = np.zeros(len(start), dtype=np.int64)
            for i in range(n):
                keep &= code[start + i] >= 0
                gram = gram * size + code[start + i]
            in_row, tf = distinct_counts(gram[keep] * rows + row[start[keep]])
            gram, df = distinct_counts(in_row // rows)
            tf = np.add.reduceat(tf, np.cumsum(df) - df) if len(df) else tf
            places = [gram // size ** (n - 1 - i) % size for i in range(n)]
            yield pa.RecordBatch.from_pydict({
                "term": _joined([words.take(pa.array(p)) for p in places]).cast(pa.string()),
                "df": pa.array(df.astype(np.int64)), "tf": pa.array(tf.astype(np.int64))})


def _totals_of_one(code: np.ndarray, words: pa.Array, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The same for one row with so many words that the number of an n-gram would not fit: n-grams are numbered
    afresh for each n, by the (n-1)-gram they begin with and their last word."""
    number, usable = code, code >= 0
    for n in range(1, high + 1):
        if n > 1:
            usable = usable[:-1] & (code[n - 1:] >= 0) if len(usable) else usable
            _, number = np.unique(number[:-1] * max(len(words), 1) + code[n - 1:], return_inverse=True)
        if n < low:
            continue
        at = np.flatnonzero(usable)
        _, first, tf = np.unique(number[at], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_pydict({
            "term": _joined([words.take(pa.array(code[at[first] + i])) for i in range(n)]).cast(pa.string()),
            "df": pa.array(np.ones(len(first), np.int64)), "tf": pa.array(tf.astype(np.int64))})


def gram_rows(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, term, tf``: how often each row has each of its n-grams."""
    for batch in token_slices(batches):
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for grams, row in batch_grams(part.column("tokens"), low, high):
                encoded = grams.dictionary_encode()
                size = max(len(encoded.dictionary), 1)
                key, tf = distinct_counts(row * size + encoded.indices.to_numpy())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(pa.array(key // size)),
                    "term": encoded.dictionary.take(pa.array(key % size)).cast(pa.string()),
                    "tf": pa.array(tf.astype(np.int64))})


def gram_vectors(batches: Iterator[pa.RecordBatch], low: int, high: int, sublinear: bool, terms: pa.Array,
                 idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One unit vector per row over the vocabulary; term numbers are places in ``terms``."""
    size = np.int64(len(terms))
    for batch in token_slices(batches):
        tokens = batch.column("tokens")
        keys = []
        for grams, row in batch_grams(tokens, low, high):
            code = pc.index_in(grams, value_set=terms)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            keys.append(row[known] * size + code.drop_null().to_numpy())
        key, count = distinct_counts(np.concatenate(keys))
        row, term = key // size, (key % size).astype(np.int32)
        weight = (1.0 + np.log(count) if sublinear else count.astype(float)) * idf[term]
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(tokens)))
        offsets = pa.array(np.searchsorted(row, np.arange(len(tokens) + 1)).astype(np.int32))
        columns = [batch.column(n) for n in batch.schema.names if n != "tokens"]
        names = [n for n in batch.schema.names if n != "tokens"]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.ListArray.from_arrays(offsets, pa.array(term)),
             pa.ListArray.from_arrays(offsets, pa.array(weight / norm[row]))],
            names=[*names, "term_ids", "weights"])


SPEECH = {"J": "adj", "V": "verb", "R": "adv"}  # by the first letter of a Treebank tag; any other is a noun


def replace_words(batches: Iterator[pa.RecordBatch], column: str, known: dict[str, tuple[pa.Array, pa.Array]],
                  tags: str | None = None) -> Iterator[pa.RecordBatch]:
    """Words of a list column give way to what ``known[part of speech]`` (words, replacements) has for them; the others stay.

    ``tags`` is a list column with a tag for each word, and is dropped; words without a tag, or all without tags, are nouns,
    which ``known`` has first.
    """
    firsts = np.cumsum([0, *[len(words) for words, _ in known.values()]])
    lemmas = pa.concat_arrays([replaced for _, replaced in known.values()])
    for batch in token_slices(batches, column):
        lists = batch.column(column)
        flat, lengths = lists.flatten().cast(pa.large_string()), np.diff(lists.offsets.to_numpy())
        speech = np.zeros(len(flat), np.int8) if tags is None else _speeches(batch.column(tags), lengths, list(known))
        # A word stays where it is, or comes from the replacements behind all words.
        source = np.arange(len(flat))
        for pos, (first, (words, _)) in enumerate(zip(firsts, known.values())):
            at = np.flatnonzero(speech == pos)
            code = pc.fill_null(pc.index_in(flat.take(pa.array(at)), value_set=words), -1).to_numpy()
            source[at[code >= 0]] = len(flat) + first + code[code >= 0]
        batch = batch if tags is None else batch.drop_columns([tags])
        yield _with_lists(batch, column, lengths, pa.concat_arrays([flat, lemmas]).take(pa.array(source)))


def _speeches(tags: pa.ListArray, lengths: np.ndarray, names: list[str]) -> np.ndarray:
    """Part of speech, as its place in ``names``, of each word of lists with these lengths."""
    counts = pc.fill_null(pc.list_value_length(tags), 0).to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
    tagged = position < counts[row]
    encoded = tags.flatten().dictionary_encode()
    kinds = [names.index(SPEECH.get((tag or "")[:1], "noun")) for tag in encoded.dictionary.to_pylist()]
    codes = pc.fill_null(encoded.indices, len(kinds)).to_numpy()
    speech = np.zeros(len(row), np.int8)
    speech[tagged] = np.array([*kinds, 0], np.int8)[codes[((np.cumsum(counts) - counts)[row] + position)[tagged]]]
    return speech


def _with_lists(batch: pa.RecordBatch, column: str, lengths: np.ndarray, values: pa.Array) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, values.cast(pa.string()))
    return batch.set_column(batch.schema.get_field_index(column), column, lists)

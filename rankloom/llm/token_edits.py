"""Token counts that follow edits: a segment tree of counts per document.

A text is cut into pre-tokens, which a byte-level tokenizer encodes one by one. Runs of up to ``SEGMENT`` pre-tokens are the
leaves of a tree whose nodes sum characters and tokens. An edit cuts the text again from the last leaf border that it cannot
have touched (pre-tokens look at most ``CONTEXT`` characters ahead) until a new border meets an old one behind the edit;
only pre-tokens in between are encoded, and only the sums above the changed leaves are updated.

Defined cases: null text counts as '' and has no tokens; edits may still insert. Edits apply one after the other, each to the
text that the one before left; places beyond the text are moved to its end, a null replacement is '', a null list has no
edits. Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.llm.chat_tree import ByteTokens
from rankloom.llm.tokens import text_slices

SEGMENT = 32
CONTEXT = 3
MAX_REMEMBERED = 400_000
LETTER, NUMBER, SPACE, OTHER = range(4)


@cache
def character_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            kinds[[ord(c) for c in run[0]]] = kind
    return kinds


def piece_starts(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, as a mask over code points of texts that lie one behind the other.

    Letters, numbers and other characters form runs, each with one space before it; of white space before a run the last
    character stands apart; 's 'd 'm 't 'll 've 're are cut off where the apostrophe begins a pre-token.
    """
    n = len(points)
    kind = character_classes()[points]
    after = lambda mask, fill: np.append(mask[1:], fill)
    before = lambda mask, fill: np.append(fill, mask[:-1])
    last = after(text_start, True)
    same = before(kind, 255) == kind
    run = ~same | text_start
    space, blank = kind == SPACE, points == 32
    word = ~space
    next_word = after(word, False) & ~last
    # One space goes with the run behind it.
    joined = blank & next_word
    start = np.where(word, run & ~(before(joined, False) & ~text_start), False)
    # White space: the beginning of its run, and its last character before a word.
    start |= space & (run | next_word)

    mark = (points == 39) & start & ~last
    if mark.any():
        at = np.flatnonzero(mark)
        one = np.append(points, [0, 0])[at + 1]
        two = np.append(points, [0, 0])[at + 2]
        ends = np.append(text_start, [True, True])
        short = np.isin(one, [ord(c) for c in "sdmt"])
        pair = ~ends[at + 2] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("ll", "ve", "re")])
        for places, size in ((at[short], 2), (at[pair & ~short], 3)):
            start[places + 1] = False
            behind = places + size
            behind = behind[behind < n]
            # The rest of the letters is a pre-token of its own.
            start[behind[(kind[behind] == LETTER) & ~text_start[behind]]] = True
    return start


class PieceCounter:
    """Number of tokens of pre-tokens; a worker remembers those it has seen."""

    def __init__(self, path: str, pattern: str):
        self.encoding = ByteTokens(path, pattern).encoding
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > MAX_REMEMBERED:
            known.clear()
        new = list({p for p in pieces if p not in known})
        if new:
            known.update(zip(new, map(len, map(self.encoding.encode_ordinary, new))))
        return [known[p] for p in pieces]


def piece_counter(path: str, pattern: str) -> PieceCounter:
    """One counter per Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_rankloom_counters", types.ModuleType("_rankloom_counters")).__dict__
    if path not in kept:
        kept[path] = PieceCounter(path, pattern)
    return kept[path]


def segments(texts: pa.Array, counter: PieceCounter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments per text, characters, tokens of each segment) of a batch without nulls."""
    joined = "".join(texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    text_start = np.zeros(len(points) + 1, bool)
    text_start[np.cumsum(lengths) - lengths] = True
    text_start = text_start[:-1]
    begins = np.flatnonzero(piece_starts(points, text_start) | text_start)
    widths = np.ones(len(points), np.int64)
    for bound in (0x80, 0x800, 0x10000):
        widths += points >= bound
    byte_of = np.append(np.cumsum(widths) - widths, widths.sum())
    offsets = byte_of[np.append(begins, len(points))]
    pieces = pa.LargeStringArray.from_buffers(
        len(begins), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined.encode())).dictionary_encode()
    tokens = np.array(counter.count(pieces.dictionary.to_pylist()), np.int64)[
        pieces.indices.to_numpy(zero_copy_only=False)] if len(begins) else np.zeros(0, np.int64)
    chars = np.diff(np.append(begins, len(points)))
    owner = np.repeat(np.arange(len(texts)), lengths)[begins] if len(begins) else np.zeros(0, np.int64)
    first = np.searchsorted(owner, owner)
    opens = np.flatnonzero((np.arange(len(begins)) - first) % SEGMENT == 0)
    add = lambda values: np.add.reduceat(values, opens) if len(opens) else values
    return np.bincount(owner[opens], minlength=len(texts)), add(chars), add(tokens)


class SegmentTree:
    """Sums of characters and tokens over the segments of one text; node 1 is the root."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.build(chars, tokens)

    def build(self, chars: list[int], tokens: list[int]) -> None:
        self.n = len(chars)
        self.size = 1 << max(self.n - 1, 0).bit_length()
        pad = [0] * (self.size - self.n)
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for node in range(self.size - 1, 0, -1):
            self.add_up(node)

    def add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size:self.size + self.n], self.tokens[self.size:self.size + self.n]

    def locate(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the last leaf that begins at or before a place and has characters."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Put new leaves in place of leaves first to last - 1; sums change along the way to the root only."""
        missing = last - first - len(chars)
        if missing < 0:
            old_chars, old_tokens = self.leaves()
            self.build(old_chars[:first] + chars + old_chars[last:], old_tokens[:first] + tokens + old_tokens[last:])
            return
        self.chars[self.size + first:self.size + last] = chars + [0] * missing
        self.tokens[self.size + first:self.size + last] = tokens + [0] * missing
        low, high = (self.size + first) // 2, (self.size + last - 1) // 2
        while low:
            for node in range(low, high + 1):
                self.add_up(node)
            low, high = low // 2, high // 2


class EditableCount:
    """A text with its tree; ``encoded`` counts the pre-tokens that edits have encoded again."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], counter: PieceCounter):
        self.text, self.tree, self.counter, self.encoded = text, SegmentTree(chars, tokens), counter, 0

    @property
    def n_tokens(self) -> int:
        return self.tree.tokens[1] if self.tree.n else 0

    def edit(self, start: int, stop: int, replacement: str) -> None:
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        text = self.text[:start] + replacement + self.text[stop:]
        shift = len(text) - len(self.text)
        first, begin = self.tree.locate(max(start - CONTEXT, 0)) if self.tree.n else (0, 0)
        # Old leaf borders at or behind the edit's end, by their place in the new text.
        chars, _ = self.tree.leaves()
        last, border = first, begin
        pieces: list[str] = []
        at, window = begin, 2 * (stop - begin) + len(replacement) + 256
        while True:
            while border < stop and last < len(chars):
                border += chars[last]
                last += 1
            end = min(len(text), at + window)
            met = False
            for found in self.counter.pattern.finditer(text, at, end):
                if found.end() + CONTEXT > end and end < len(text):
                    break
                pieces.append(found[0])
                at = found.end()
                while border + shift < at and last < len(chars):
                    border += chars[last]
                    last += 1
                if border >= stop and border + shift == at:
                    met = True
                    break
            if met or at >= len(text):
                break
            window *= 2
        if at >= len(text):
            last = len(chars)
        counts = self.counter.count(pieces)
        self.encoded += len(pieces)
        parts = range(0, len(pieces), SEGMENT)
        self.tree.replace(first, last, [sum(map(len, pieces[i:i + SEGMENT])) for i in parts],
                          [sum(counts[i:i + SEGMENT]) for i in parts])
        self.text = text


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)),
                                    pa.array(values.astype(np.int32)))


def build_trees(docs: DataFrame, tokenizer_path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """All columns, ``segment_chars``, ``segment_tokens`` (the leaves of each tree) and ``n_tokens``, its root.

    The leaves take a few bytes per 32 pre-tokens: a table of them can be kept beside the documents.
    """
    kept = [c for c in docs.columns if c not in {"segment_chars", "segment_tokens", "n_tokens"}]
    rows = docs.select(*kept, docs[text_column].alias("_text"))
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in (
        "segment_chars", "segment_tokens")], T.StructField("n_tokens", T.LongType())])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer_path, pattern)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                texts = pc.fill_null(part.column("_text").cast("large_string"), "")
                counts, chars, tokens = segments(texts, counter)
                totals = np.bincount(np.repeat(np.arange(len(counts)), counts), tokens, len(counts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(chars, counts), _lists(tokens, counts),
                                                  pa.array(totals)], schema=arrow_schema)

    return rows.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, tokenizer_path: str, pattern: str, text_column: str = "text",
                edits_column: str = "edits") -> DataFrame:
    """The table of ``build_trees`` with its text and tree after the edits, and ``n_encoded``, the pre-tokens encoded for it.

    ``edits`` is an array of structs ``start, stop, replacement`` in characters.
    """
    kept = [c for c in trees.columns if c != "n_encoded"]
    rows = trees.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_encoded", T.LongType())])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer_path, pattern)
        for batch in batches:
            for part in text_slices(batch, text_column):
                columns = {name: column for name, column in zip(part.schema.names, part.columns)}
                changed: dict[str, list] = {c: [] for c in (text_column, "segment_chars", "segment_tokens", "n_tokens",
                                                            "n_encoded")}
                for text, chars, tokens, edits in zip(*(columns[c].to_pylist() for c in (
                        text_column, "segment_chars", "segment_tokens", edits_column))):
                    state = EditableCount(text or "", chars, tokens, counter)
                    for e in edits or ():
                        state.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                    leaf_chars, leaf_tokens = state.tree.leaves()
                    for name, value in zip(changed, (state.text if edits else text, leaf_chars, leaf_tokens,
                                                     state.n_tokens, state.encoded)):
                        changed[name].append(value)
                arrays = [pa.array(changed[f.name], f.type) if f.name in changed else columns[f.name] for f in arrow_schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    return rows.mapInArrow(run, schema)

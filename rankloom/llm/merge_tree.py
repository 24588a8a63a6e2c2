"""Byte-level BPE encoding and decoding, with a segment tree over the bytes of a pre-token.

The tree has a leaf for every byte. A leaf whose part is live and has a right neighbour holds the rank of the pair, and
inner nodes hold the smaller of their two children, so the root names the leftmost pair of least rank. A merge
takes it, joins the two parts, and sets three leaves anew: the one that is gone, the joined one, and its left neighbour. Each
costs one way to the root, so a pre-token of n bytes takes n log n steps, also when it is a whole text.

Texts are cut into pre-tokens as code points of a whole slice at once, each distinct pre-token of a slice is merged once, and a
worker remembers the ids of those it has seen.

Defined cases: null text counts as '', which has no ids and decodes to nothing. Long texts are encoded whole, one at a time.
Repeated rows are encoded each. A null list of ids decodes as an empty one; an id outside the vocabulary is an error. An
empty table gives an empty result. Only the key and the named column are read, whatever else a table holds.
"""

from __future__ import annotations

import base64
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from rankloom.llm.token_edits import piece_starts
from rankloom.llm.tokens import ragged, text_slices

# Text that is cut at once, and pre-tokens (and bytes of them) that a worker remembers.
SLICE_BYTES = 2 << 20
MAX_REMEMBERED, MAX_REMEMBERED_BYTES = 500_000, 32 << 20
# A leaf or node without a pair.
NO_PAIR = sys.maxsize


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token; one that is a token itself has its own rank.

    ``nodes`` is the tree, its leaves behind its inner nodes; a value is a pair's rank and place as one number. ``behind`` and
    ``before`` lead from a live part to its neighbours.
    """
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    size = len(piece)
    if not size:
        return []
    bits = (size - 1).bit_length()
    width = 1 << bits
    mask = width - 1
    behind, before = list(range(1, size + 2)), list(range(-1, size))
    nodes = [NO_PAIR] * (2 * width)
    for place in range(size - 1):
        rank = rank_of(piece[place:place + 2])
        if rank is not None:
            nodes[width + place] = rank << bits | place
    for node in range(mask, 0, -1):
        left, right = nodes[2 * node], nodes[2 * node + 1]
        nodes[node] = left if left < right else right
    while (least := nodes[1]) != NO_PAIR:
        place = least & mask
        gone = behind[place]
        end = behind[place] = behind[gone]
        before[end] = place
        # The joined part with its right neighbour, the left neighbour with the joined part, and the part that is gone.
        changes = [(width + gone, NO_PAIR)]
        rank = rank_of(piece[place:behind[end]]) if end < size else None
        changes.append((width + place, NO_PAIR if rank is None else rank << bits | place))
        if place:
            left = before[place]
            rank = rank_of(piece[left:end])
            changes.append((width + left, NO_PAIR if rank is None else rank << bits | left))
        for node, value in changes:
            if nodes[node] == value:
                continue
            nodes[node] = value
            while node > 1:
                other = nodes[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if nodes[node] == value:
                    break
                nodes[node] = value
    ids, place = [], 0
    while place < size:
        ids.append(ranks[piece[place:behind[place]]])
        place = behind[place]
    return ids


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens of all texts as bytes, number of them per text) of texts without nulls."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    first = np.zeros(len(points) + 1, bool)
    first[ends - lengths] = True
    begins = np.flatnonzero(piece_starts(points, first[:-1]) | first[:-1])
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    places = np.concatenate([[0], np.cumsum(sizes)])
    data = b"".join(text.encode() for text in texts.to_pylist())
    offsets = np.append(places[begins], len(data))
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return pieces, np.searchsorted(begins, ends) - np.searchsorted(begins, ends - lengths)


class MergeEncoder:
    """Ids of whole texts, and the bytes of ids."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.forget()

    def forget(self) -> None:
        self.entry: dict[bytes, int] = {}
        self.ids, self.starts, self.held = array("I"), array("q", [0]), 0

    def entries(self, pieces: list[bytes]) -> np.ndarray:
        entry = self.entry
        for piece in pieces:
            if piece not in entry:
                entry[piece] = len(entry)
                self.held += len(piece)
                self.ids.extend(merge_piece(piece, self.ranks))
                self.starts.append(len(self.ids))
        return np.fromiter(map(entry.get, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text)."""
        if len(self.entry) > MAX_REMEMBERED or self.held > MAX_REMEMBERED_BYTES:
            self.forget()
        pieces, counts = pre_tokens(texts)
        coded = pieces.dictionary_encode()
        entry = self.entries(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        starts, flat = np.array(self.starts), np.array(self.ids, np.uint32)
        sizes = np.diff(starts)[entry]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return flat[ragged(starts[entry], sizes)], sums[ends] - sums[ends - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all lists of ids, number of bytes per list)."""
        sizes = self.sizes[ids]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return self.bytes[ragged(self.places[ids], sizes)], sums[ends] - sums[ends - counts]


def merge_encoder(path: str) -> MergeEncoder:
    """One encoder per Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_rankloom_mergers", types.ModuleType("_rankloom_mergers")).__dict__
    if path not in kept:
        kept[path] = MergeEncoder(path)
    return kept[path]


def binary_lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values one behind the other as one binary value per size, given in items."""
    width = values.itemsize
    offsets = np.concatenate([[0], np.cumsum(sizes * width)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _binary_column(df: DataFrame, key: str, name: str) -> tuple[StructType, pa.Schema]:
    schema = StructType([StructField(key, df.schema[key].dataType), StructField(name, BinaryType())])
    return schema, to_arrow_schema(schema)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``key, ids`` of every row: its ids as little-endian unsigned 32-bit numbers."""
    schema, arrow_schema = _binary_column(docs, key, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(path)
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE_BYTES):
                texts = pc.fill_null(part.column("_text").cast("large_string"), "")
                ids = binary_lists(*encoder.encode(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), ids.cast(arrow_schema[1].type)], schema=arrow_schema)

    return docs.select(docs[key], docs[text_column].alias("_text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``key, ids, decoded`` of every row: the ids and the bytes that they stand for."""
    schema, _ = _binary_column(encoded, key, "ids")
    schema = schema.add("decoded", BinaryType())
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(path)
        for batch in batches:
            for part in text_slices(batch, "_ids", SLICE_BYTES):
                given = pc.fill_null(part.column("_ids").cast("large_binary"), b"")
                counts = pc.binary_length(given).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                ids = np.frombuffer(b"".join(given.to_pylist()), "<u4").astype(np.int64)
                decoded = binary_lists(*encoder.decode(ids, counts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).cast(arrow_schema[1].type), decoded.cast(arrow_schema[2].type)],
                    schema=arrow_schema)

    return encoded.select(encoded[key], encoded[ids_column].alias("_ids")).mapInArrow(run, schema)

"""Token ids of whole texts by a public tokenizer file, one lookup per distinct word of a batch."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rankloom.llm.words import arrow_words

# Texts of one batch that are split at once.
SLICE_BYTES = 4 << 20
# Pieces whose ids a worker remembers; the table is emptied when it is full.
MAX_REMEMBERED = 300_000
# Letters that normalization leaves alone but for their case.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
PROBES = ("a", "The", "ándÜber", "straße", "ÿéçñÏ", "qzxjkvw" * 5)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``max_bytes`` of text, or one row."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths.astype(np.int64)) // max_bytes
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, stop in zip(starts, np.append(starts[1:], len(part))):
        yield batch.slice(start, stop - start)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all items of the given ranges, range after range."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


class WordEncoder:
    """Ids of a tokenizer that drops white space and never joins what white space separates.

    Texts are cut at white space. The punctuation behind a word of letters is encoded apart, as the tokenizer cuts there
    too, so that far fewer distinct pieces remain; all other words are encoded as they are. Special tokens in a text
    keep the meaning that the tokenizer gives them.
    """

    def __init__(self, path: str):
        # Tasks have a core each: threads of the tokenizer would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file) | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(steps)).model
        # Where the model alone gives the same ids for words of letters, they skip the steps before it.
        self.letters_alone = all(self.letter_ids(p) == self.tokenizer.encode(p, add_special_tokens=False).ids for p in PROBES)
        self.forget()

    def letter_ids(self, word: str) -> list[int]:
        """Ids of a word of ``LETTERS``: in lower case, its bytes as the characters that stand for them, merged by the model."""
        return [token.id for token in self.model.tokenize(word.lower().translate(BYTE_CHARACTERS))]

    def forget(self) -> None:
        """Empty the table: an entry per piece, and the ids of all entries one behind the other."""
        self.entry: dict[str, int] = {}
        self.ids, self.starts = array("I"), array("q", [0])

    def entries(self, pieces: list[str]) -> np.ndarray:
        """The entry of every piece; new ones are encoded."""
        entry, simple = self.entry, LETTERS.fullmatch if self.letters_alone else lambda piece: None
        others = []
        for piece in pieces:
            if piece in entry:
                continue
            if simple(piece):
                self.add(piece, self.letter_ids(piece))
            else:
                others.append(piece)
        for piece, encoding in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.add(piece, encoding.ids)
        return np.fromiter(map(entry.get, pieces), np.int64, len(pieces))

    def add(self, piece: str, ids: list[int]) -> None:
        self.entry[piece] = len(self.entry)
        self.ids.extend(ids)
        self.starts.append(len(self.ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text); null text has none."""
        counts, codes, distinct = arrow_words(texts)
        if len(self.entry) > MAX_REMEMBERED:
            self.forget()
        pieces = word_pieces(distinct).dictionary_encode()
        entry = self.entries(pieces.dictionary.to_pylist())[pieces.indices.to_numpy(zero_copy_only=False)]
        starts, flat = np.array(self.starts), np.array(self.ids, np.uint32)
        # Two pieces per word, the second one mostly empty.
        of_word = entry.reshape(-1, 2)[codes].ravel()
        per_piece = (starts[1:] - starts[:-1])[of_word]
        sums = np.concatenate([[0], np.cumsum(per_piece)])
        ends = 2 * np.cumsum(counts)
        return flat[ragged(starts[of_word], per_piece)], sums[ends] - sums[ends - 2 * counts]


def byte_characters() -> dict[int, str]:
    """For each letter above ASCII in ``LETTERS`` the characters that byte-level vocabularies write for its bytes.

    Bytes that print stand for themselves, the others for the characters from 256 on in their order.
    """
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    character = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(character[b] for b in chr(c).encode()) for c in range(0xC0, 0x100) if LETTERS.fullmatch(chr(c))}


BYTE_CHARACTERS = byte_characters()


def word_pieces(words: pa.Array) -> pa.Array:
    """Two pieces for every word: one of letters and the punctuation behind it, else the word and nothing.

    ASCII words come in lower case, unless they might hold a special token.
    """
    plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
    words = pc.if_else(plain, pc.ascii_lower(words), words).cast("large_string")
    letters = pc.ascii_rtrim(words, PUNCTUATION)
    # Some letters end in a mark once they are normalized, and a dotted capital I once it is in lower case. The mark would
    # run on into the punctuation.
    apart = pc.and_(pc.utf8_is_alpha(pc.utf8_normalize(letters, "NFC")),
                    pc.invert(pc.match_substring(letters, "\u0130")))
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
    first = np.where(apart.to_numpy(zero_copy_only=False), pc.binary_length(letters).to_numpy(zero_copy_only=False), sizes)
    data = words.buffers()[2]
    begins = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    offsets = np.empty(2 * len(words) + 1, np.int64)
    offsets[0::2], offsets[1::2] = begins, begins[:-1] + first
    return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(offsets), data)


def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_rankloom_encoders", types.ModuleType("_rankloom_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]

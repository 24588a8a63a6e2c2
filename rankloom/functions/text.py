"""Text cleaning and tokenization as column expressions (no Python worker but for NFKC)."""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from rankloom.functions.words import ENGLISH_STOP_WORDS

# The NFKC function below travels to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Whitespace inside ASCII text, the file, group, record and unit separators included.
_ASCII_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_UNICODE_SPACES = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                   r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
# Letters that NFKC leaves alone whatever stands next to them, as long as all text is made of them.
_NFKC_STABLE = r"^[\x00-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*$"
# Maximal runs of two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
ASCII_TOKEN_PATTERN = "[a-z0-9_]{2,}"


@lru_cache(maxsize=1)
def ascii_fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Code points whose compatibility decomposition holds ASCII: to one character, to several."""
    single, several = {}, {}
    for code_point in range(0x80, sys.maxunicode + 1):
        char = chr(code_point)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if folded:
            (single if len(folded) == 1 else several)[char] = folded
    return single, several


def _is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


@lru_cache(maxsize=1)
def _never_folded() -> str:
    """Character class of the long stretches of code points that fold to nothing or to one character."""
    stretches, last = [], 0x7F
    for code_point in [*sorted(map(ord, ascii_fold_tables()[1])), sys.maxunicode + 1]:
        if code_point - last > 16:
            stretches.append(f"\\x{{{last + 1:x}}}-\\x{{{code_point - 1:x}}}")
        last = code_point
    return "[" + "".join(stretches) + "]+"


def fold_ascii(col: Column) -> Column:
    """NFKD, then drop what is not ASCII. Plain ASCII text passes untouched.

    Characters that fold to one are translated, stretches that fold to nothing deleted; what
    is left outside ASCII is looked up character by character.
    """
    single, several = ascii_fold_tables()
    translated = F.translate(col, "".join(single), "".join(single.values()))
    short = F.regexp_replace(translated, _never_folded(), "")
    lookup = F.map_from_arrays(F.split(F.lit("\x01".join(several)), "\x01"),
                               F.split(F.lit("\x01".join(several.values())), "\x01"))
    pieces = F.regexp_extract_all(short, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]"), F.lit(0))
    folded = F.transform(pieces, lambda piece: F.when(_is_ascii(piece), piece).otherwise(
        F.coalesce(F.try_element_at(lookup, piece), F.lit(""))))
    return F.when(_is_ascii(col), col).otherwise(F.array_join(folded, ""))


def clean_tokens(col: Column, remove_numbers: bool = True, remove_stopwords: bool = True,
                 stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lower case, fold to ASCII, '/' to space, delete punctuation and digits, split, drop stop words.

    Tags are not removed: deleting punctuation takes the angle brackets first, so ``<br>`` leaves ``br``.
    """
    folded = fold_ascii(F.lower(F.coalesce(col, F.lit(""))))
    to_space = "/" + _ASCII_SPACES
    deleted = string.punctuation.replace("/", "") + (string.digits if remove_numbers else "")
    words = F.split(F.translate(folded, to_space + deleted, " " * len(to_space)), " ")
    if remove_stopwords:
        return F.filter(words, lambda w: (w != "") & ~w.isin(list(stop_words)))
    return F.filter(words, lambda w: w != "")


def clean_text(col: Column, remove_numbers: bool = True, remove_stopwords: bool = True,
               stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Cleaned text: the surviving words joined with one space. Null becomes ''."""
    return F.array_join(clean_tokens(col, remove_numbers, remove_stopwords, stop_words), " ")


def clean_column(df, column: str, new_column: str | None = None, **flags):
    """Add a cleaned copy of a text column, named ``<column>_cleaned`` unless given."""
    return df.withColumn(new_column or f"{column}_cleaned", clean_text(F.col(column), **flags))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_nfkc(col: Column) -> Column:
    """NFKC. Text of letters that NFKC cannot change never goes to a Python worker."""
    return F.coalesce(_nfkc(F.when(col.rlike(_NFKC_STABLE), F.lit(None)).otherwise(col)), col)


def strip_tags_and_spaces(col: Column) -> Column:
    """Tags to a space (never across a line end), whitespace runs to one space, ends stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"<[^\n>]*>", " "), _UNICODE_SPACES, " "))


def clean_text_semantic(col: Column) -> Column:
    """Light cleaning for embeddings: null to '', NFKC, tags out, whitespace collapsed."""
    return strip_tags_and_spaces(normalize_nfkc(F.coalesce(col, F.lit(""))))


def tokenize(col: Column, stop_words: Sequence[str] | None = None, ascii_only: bool = False) -> Column:
    """Lower-cased word tokens of at least two characters, optionally without stop words."""
    pattern = ASCII_TOKEN_PATTERN if ascii_only else TOKEN_PATTERN
    tokens = F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(0))
    if stop_words:
        return remove_stop_words(tokens, stop_words)
    return tokens


def remove_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(stop_words)))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams with ``low <= n <= high``, words joined with one space, in reading order per n."""
    if not 1 <= low <= high:
        raise ValueError(f"invalid n-gram range ({low}, {high})")
    current, kept = tokens, []
    for n in range(1, high + 1):
        if n > 1:
            following = F.slice(tokens, F.lit(n), F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0)))
            current = F.filter(F.zip_with(current, following, lambda a, b: F.concat(a, F.lit(" "), b)),
                               lambda gram: gram.isNotNull())
        if n >= low:
            kept.append(current)
    return kept[0] if len(kept) == 1 else F.concat(*kept)


def whitespace_words(col: Column) -> Column:
    """Words between whitespace; null and blank text have none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), _UNICODE_SPACES), lambda w: w != "")


def sanitize_label(col: Column) -> Column:
    """Replace what cannot stand in a file name with an underscore."""
    return F.regexp_replace(col, r"[^\p{L}\p{N}_\-.]", "_")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' without one."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]*)$", 1))


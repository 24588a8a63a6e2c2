"""Words and small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and \\t to \\r; none for null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def arrow_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of words per text, code of every word, distinct words) of a batch; null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast("large_string"), ""))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(flat, "")
    if not pc.all(real, min_count=0).as_py():
        flat, owner = flat.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.bincount(owner, minlength=len(texts)), codes, coded.dictionary


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever other columns the table brings along."""
    return df.select(*names)

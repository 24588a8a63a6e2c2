from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions.words import ENGLISH_STOP_WORDS


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")


def apply(spark, values, expression):
    rows = column(spark, values).select("id", expression(F.col("text")).alias("out")).orderBy("id").collect()
    return [r["out"] for r in rows]


def test_fold_equals_nfkd_on_every_code_point(spark):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    frame = spark.createDataFrame(pd.DataFrame({"text": points}))
    got = frame.select("text", tx.fold_ascii(F.col("text")).alias("out")).toPandas()
    want = got["text"].map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())
    assert (got["out"] == want).all()


def expected_clean(text, numbers=True, stops=True):
    if text is None:
        return ""
    text = unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()
    text = re.sub(r"[!-.:-@\[-`{-~]", "", text.replace("/", " "))
    if numbers:
        text = re.sub("[0-9]", "", text)
    return " ".join(w for w in text.split() if not (stops and w in ENGLISH_STOP_WORDS))


EDGES = [None, "", "   ", "the and of", "12 34", "a/b C/D", "x<br>y", "™ ½ ß ﬁ Ĳ 🄀", "p q\rr\x1cs\x0bt", "don't stop",
         "Être À l'école — naïve", "日本語 текст Ⅻ ㎏", "a\x00b", "I've U.S.A. e-mail_x", "İstanbul ﬀ"]


def test_clean_text_on_edge_rows(spark):
    for numbers in (True, False):
        for stops in (True, False):
            got = apply(spark, EDGES, lambda c: tx.clean_text(c, numbers, stops))
            assert got == [expected_clean(t, numbers, stops) for t in EDGES]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=30))
def test_clean_text_on_any_text(spark, values):
    # Lower-casing itself may differ between the two Unicode tables, so it is done beforehand.
    values = [v.lower().replace("Σ", "") for v in values]
    assert apply(spark, values, tx.clean_text) == [expected_clean(v) for v in values]


def test_clean_column_default_name(spark):
    assert tx.clean_column(column(spark, ["A b"]), "text").columns == ["id", "text", "text_cleaned"]
    assert tx.clean_column(column(spark, ["A b"]), "text", "other").columns == ["id", "text", "other"]


def test_semantic_cleaning(spark):
    values = [None, "a <b>bold</b>  c", "x <not\nclosed> y", "ﬁne ½ <i>", "A  B\x1c", "é <p\r>", "É à", "<>z<"]

    def expected(text):
        text = unicodedata.normalize("NFKC", text or "")
        return re.sub(r"\s+", " ", re.sub("<.*?>", " ", text)).strip()

    assert apply(spark, values, tx.clean_text_semantic) == [expected(v) for v in values]


def test_tokens_are_runs_of_two_or_more_word_characters(spark):
    got = apply(spark, ["Être 12 a_b c, d-ef", "", "x"], tx.tokenize)
    assert got == [["être", "12", "a_b", "ef"], [], []]


def test_bigrams_span_removed_stop_words(spark):
    got = apply(spark, ["master of science", "one", ""],
                lambda c: tx.ngrams(tx.tokenize(c, ["of"]), 1, 2))
    assert got == [["master", "science", "master science"], ["one"], []]


def test_ngram_ranges(spark):
    tokens = lambda c: tx.tokenize(c)
    assert apply(spark, ["aa bb cc"], lambda c: tx.ngrams(tokens(c), 2, 3)) == [["aa bb", "bb cc", "aa bb cc"]]
    assert apply(spark, ["aa bb"], lambda c: tx.ngrams(tokens(c), 3, 3)) == [[]]
    with pytest.raises(ValueError):
        tx.ngrams(F.col("x"), 2, 1)


def test_file_names(spark):
    paths = ["file:/a/b.TXT", "/x/y.tar.gz", "plain", "/d/.hidden", "/d.e/name"]
    assert apply(spark, paths, tx.file_name) == ["b.TXT", "y.tar.gz", "plain", ".hidden", "name"]
    assert apply(spark, paths, tx.file_extension) == [".txt", ".gz", "", "", ""]
    assert apply(spark, ["a b/c:d.e-f_g"], tx.sanitize_label) == ["a_b_c_d.e-f_g"]

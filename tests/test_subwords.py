"""Longest-match pieces against a plain version."""

from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st

from rankloom.operators import subwords

WORDS = subwords.Pieces({p: i for i, p in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "run", "##n", "##ing",
                                                     "##a", "a", "##b"])}, unknown=1, pad=0, first=2, last=3)
ENDS = subwords.Pieces({p: i for i, p in enumerate(["<pad>", "<unk>", "low", "low</w>", "er</w>", "e", "r", "l", "o", "w", "lo"])},
                       unknown=1, pad=0, inside="", end="</w>")


@pytest.mark.parametrize("pieces, word, want", [
    (WORDS, "unaffable", [4, 5, 6]), (WORDS, "running", [7, 8, 9]), (WORDS, "unaffablex", [1]), (WORDS, "aaab", [11, 10, 10, 12]),
    (WORDS, "a" * 100, [11] + [10] * 99), (WORDS, "a" * 101, [1]), (WORDS, "", []), (ENDS, "low", [3]), (ENDS, "lower", [2, 4]),
    (ENDS, "lowlow", [2, 3]), (ENDS, "lo", [1])])
def test_longest_pieces(pieces, word, want):
    assert subwords.word_pieces(word, pieces, pieces.longest) == want


@settings(max_examples=300, deadline=None)
@given(st.text("aunrfble", max_size=14))
def test_pieces_spell_the_word(word):
    names = {i: p for p, i in WORDS.ids.items()}
    found = subwords.word_pieces(word, WORDS, WORDS.longest)
    if found != [1]:
        assert "".join(names[i].removeprefix("##") for i in found) == word
        for n, i in enumerate(found):           # no longer piece would have fitted
            rest = "".join(names[j].removeprefix("##") for j in found[n:])
            fitting = [p for p in WORDS.ids if p.startswith("##") == (n > 0) and rest.startswith(p.removeprefix("##"))]
            assert names[i] == max(fitting, key=len)


def plain(words, pieces, length):
    ids = [i for w in words or [] if w is not None for i in subwords.word_pieces(w, pieces, pieces.longest)]
    frame = [[i] if i is not None else [] for i in (pieces.first, pieces.last)]
    kept = [*frame[0], *ids[:length - sum(map(len, frame))], *frame[1]]
    return kept + [pieces.pad] * (length - len(kept)), [1] * len(kept) + [0] * (length - len(kept)), len(ids)


@pytest.mark.parametrize("pieces", [WORDS, ENDS])
@pytest.mark.parametrize("length", [2, 6, 40])
def test_texts_are_padded_and_truncated(spark, pieces, length, monkeypatch):
    monkeypatch.setattr(subwords, "MAX_REMEMBERED", 3)
    texts = [["unaffable", "running", "lower"], [], None, ["a", None, "low"], ["lowlow"] * 30, ["zzz"], ["aab", "", "un"],
             ["running"] * 5_000]
    rows = [(i, t, f"x{i}") for i, t in enumerate(texts)] * 2
    table = spark.createDataFrame(rows, "doc_id long, tokens array<string>, piece string")
    got = subwords.encode_words(table, pieces, length).collect()
    want = [(i, x, *plain(t, pieces, length)) for i, t, x in rows]
    assert sorted((r.doc_id, r.piece, r.input_ids, r.attention_mask, r.n_pieces) for r in got) == sorted(want)
    assert subwords.encode_words(table.where("false"), pieces, length).count() == 0


def test_vocabulary_tables(spark, tmp_path, monkeypatch):
    (tmp_path / "v.json").write_text('{"model": {"vocab": {"a": 0, "##b": 1, "\\u00e9\\"": 2}}, "added_tokens": [{"id": 3, "content": "<s>", "x": {}}]}',
                                     encoding="utf-8")
    table = subwords.read_pieces(spark, str(tmp_path / "v.json"))
    assert subwords.collect_pieces(table) == {"a": 0, "##b": 1, 'é"': 2}
    assert subwords.collect_pieces(subwords.read_marks(spark, str(tmp_path / "v.json"))) == {"<s>": 3}
    monkeypatch.setattr(subwords, "MAX_PIECES", 2)
    with pytest.raises(ValueError):
        subwords.collect_pieces(table)
    texts = spark.createDataFrame([(1, ["a"], 2)], "doc_id long, tokens array<string>, n_pieces int")
    with pytest.raises(ValueError):
        subwords.encode_words(texts, WORDS)
    with pytest.raises(ValueError):
        subwords.encode_words(texts.drop("n_pieces"), WORDS, 1)

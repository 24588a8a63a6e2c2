"""Mergeable samples against the ranking of all keys, and the one-scan statistics against those of the texts."""

from __future__ import annotations

import pyarrow as pa
import pytest

from rankloom.operators import sampling, statistics


def jobs(spark, n=600):
    # A third of the rows have one title, some have none.
    title = lambda i: None if i % 11 == 5 else "hot" if i % 3 == 0 else f"t{i % 7}"
    return spark.createDataFrame([(i, title(i), f"text {i}") for i in range(n)], "job_id long, title string, text string").repartition(9)


@pytest.mark.parametrize("total", [3, 20, 100, 5000])
@pytest.mark.parametrize("held", [1, 1 << 16])
def test_summary_is_the_stratified_sample(spark, monkeypatch, total, held):
    monkeypatch.setattr(sampling, "HELD_ROWS", held)
    table = jobs(spark)
    want = sampling.stratified_sample(table, "job_id", total, 7).select("title", "job_id", "text")
    got = sampling.stratified_summary(table, "job_id", total, 7, keep=("text",))
    assert got.columns == ["title", "job_id", "text"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty_and_untitled_tables(spark):
    assert sampling.stratified_summary(jobs(spark).limit(0), "job_id", 10).collect() == []
    assert sampling.stratified_summary(jobs(spark).where("title IS NULL"), "job_id", 10).collect() == []


def test_cut_summaries_merge_to_the_same_sample():
    rows = pa.table({"title": [f"t{i % 4}" for i in range(200)], "h": [f"{i * 7919 % 997:04d}" for i in range(200)]})
    whole = sampling.smallest_per_title(rows, 12)
    merged = sampling.smallest_per_title(pa.concat_tables(
        [sampling.smallest_per_title(rows.slice(at, 33), 12) for at in range(0, 200, 33)]), 12)
    assert whole.num_rows == 12 and merged.to_pylist() == whole.to_pylist()


def test_counts_of_one_scan_give_all_statistics(spark):
    texts = ["a-b ab ab cd", "", None, "ab  ef", "cd ef gh ab", " x "]
    df = spark.createDataFrame([(texts[i % 6], None if i % 5 == 0 else f"t{i % 3}") for i in range(40)], "text string, title string")
    counts = statistics.text_counts(df, "text", "title")
    rows = lambda table: sorted(map(tuple, table.collect()), key=repr)
    words = statistics.words_of(counts)
    assert rows(words) == rows(statistics.word_counts(df, "text"))
    assert rows(statistics.weights_of_words(words)) == rows(statistics.word_weights(df, "text"))
    assert rows(statistics.histogram_of_lengths(statistics.lengths_of(counts), 4)) == rows(statistics.length_histogram(df, "text", 4))
    assert rows(statistics.top_words_of_titles(counts, 2, 3)) == rows(statistics.top_words_by_category(df, "text", "title", 2, 3))

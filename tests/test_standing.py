"""Standing rankings over a stream of documents against one search of the whole table."""

from __future__ import annotations

import shutil
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import search, tfidf
from rankloom.plans import matching
from rankloom.streaming import standing

COLUMNS = ["query_id", "rank", "doc_id", "score"]
TEXTS = ["spark data pipelines", "nurse and patients", "soup kitchen cook", "data nurse", "", None, "bread soup", "data data"]


@pytest.fixture(scope="module")
def fitted(spark):
    documents = spark.createDataFrame([(i, TEXTS[i % 8]) for i in range(40)] + [(7, "bread soup")], "doc_id long, text string")
    jobs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "query_id string, text string")
    settings = tfidf.combined_settings(min_df=1, max_df=1.0)
    vocabulary, document_vectors, job_vectors = matching.fit_combined(documents, "doc_id", jobs, "query_id", settings)
    want = sorted(map(tuple, search.top_k(job_vectors, document_vectors, 3).select(*COLUMNS).collect()))
    return documents, job_vectors, vocabulary, settings, want


def arrive(documents, path, parts, of):
    for part in parts:
        (documents.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(of)) == part).coalesce(1)
         .write.mode("append").parquet(path))


def follow(spark, fitted, path, output, state, files=1):
    documents, jobs, vocabulary, settings, _ = fitted
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", files).parquet(path)
    query = standing.follow_standings(standing.standing_top_k(stream, jobs, vocabulary, settings, 3), output, state)
    query.awaitTermination()


def standings(spark, output):
    return sorted(map(tuple, standing.current_standings(spark, output).select(*COLUMNS).collect()))


@pytest.mark.parametrize("cuts", [1, 3])
def test_standings_equal_batch_however_they_are_cut(spark, fitted, tmp_path, cuts):
    path, output = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(fitted[0], path, range(cuts), cuts)
    follow(spark, fitted, path, output, str(tmp_path / "state"))
    assert standings(spark, output) == fitted[-1]


def test_standings_go_on_after_a_restart_and_a_replay(spark, fitted, tmp_path):
    path, output, state = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "state"
    arrive(fitted[0], path, range(2), 4)
    follow(spark, fitted, path, output, str(state))
    assert standings(spark, output) != fitted[-1]
    # The last micro-batch was done but not yet marked so: it runs again.
    last = max((p.name for p in Path(state, "commits").iterdir() if p.name.isdigit()), key=int)
    unmarked = lambda folder, names: [n for n in names if Path(folder).name == "commits" and n in (last, f".{last}.crc")]
    state = Path(shutil.copytree(state, tmp_path / "state-before-the-mark", ignore=unmarked))
    before = standings(spark, output)
    follow(spark, fitted, path, output, str(state))
    assert standings(spark, output) == before
    arrive(fitted[0], path, range(2, 4), 4)
    follow(spark, fitted, path, output, str(state))
    assert standings(spark, output) == fitted[-1]


def test_unchanged_rankings_are_not_written_again(spark, fitted, tmp_path):
    path, output, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    arrive(fitted[0], path, range(2), 2)
    follow(spark, fitted, path, output, state)
    written = spark.read.parquet(output).count()
    # A text of no known word with the highest id comes last everywhere.
    spark.createDataFrame([(999, "zzz")], fitted[0].schema).coalesce(1).write.mode("append").parquet(path)
    follow(spark, fitted, path, output, state)
    assert spark.read.parquet(output).count() == written and standings(spark, output) == fitted[-1]


def test_winners_of_a_task_are_bounded(monkeypatch):
    rows = [("a", i % 5, float(i % 7)) for i in range(50)] + [(None, 3, 1.0), (None, 2, 1.0), ("b", 1, 0.0)]
    table = pa.table({"query_id": pa.array([r[0] for r in rows]), "doc_id": pa.array([r[1] for r in rows]),
                      "score": pa.array([r[2] for r in rows])})
    got = standing.best_per_query(table, 2).to_pylist()
    want = sorted((r for r in rows if r[0] == "a"), key=lambda r: (-r[2], r[1]))[:2]
    assert [tuple(r.values()) for r in got] == want + [("b", 1, 0.0), (None, 2, 1.0), (None, 3, 1.0)]


def test_refused_settings(spark, fitted, monkeypatch):
    documents, jobs, vocabulary, settings, _ = fitted
    with pytest.raises(ValueError):
        standing.standing_top_k(documents, jobs, vocabulary, settings, 0)
    monkeypatch.setattr(standing, "fits_broadcast", lambda df: False)
    with pytest.raises(ValueError):
        standing.standing_top_k(documents, jobs, vocabulary, settings, 3)

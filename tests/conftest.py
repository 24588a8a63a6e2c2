from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").appName("rankloom-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staging")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def skewed(tmp_path_factory) -> str:
    """The small tables with a third of all rows alike, missing values and odd characters."""
    import duckdb

    source, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    hot = f"(SELECT text FROM '{source}/documents.parquet' WHERE doc_id = 1)"
    odd = "'a/b <br> 12 ß é x' || chr(160) || 'y' || chr(28) || 'z' || chr(13) || chr(10) || 'Ünï_code co-op don''t'"
    changed = {
        "documents": f"doc_id, CASE WHEN doc_id % 3 = 0 THEN {hot} WHEN doc_id % 41 = 1 THEN NULL "
                     f"WHEN doc_id % 41 = 2 THEN '' WHEN doc_id % 41 = 3 THEN 'the and of' "
                     f"WHEN doc_id % 41 = 4 THEN {odd} ELSE text END AS text, "
                     "CASE WHEN doc_id % 17 <> 5 THEN lang END AS lang, "
                     "CASE WHEN doc_id % 3 = 0 THEN 'src0' WHEN doc_id % 19 <> 7 THEN source END AS source, n_chars",
        "benchmark": f"item_id, CASE WHEN item_id = 3 THEN '' WHEN item_id = 4 THEN NULL "
                     f"WHEN item_id % 3 = 2 THEN {hot} ELSE text END AS text",
        "embeddings": f"vec_id, CASE WHEN vec_id % 3 = 0 THEN (SELECT embedding FROM '{source}/embeddings.parquet' "
                      "WHERE vec_id = 7) ELSE embedding END AS embedding, "
                      "CASE WHEN vec_id % 3 = 0 THEN 1 WHEN vec_id % 23 <> 1 THEN label END AS label",
        "conversations": "conv_id, turn, role, CASE WHEN turn = 1 THEN NULL "
                         "WHEN turn = 2 THEN '  ' || chr(10) || ' x ' || chr(160) ELSE text END AS text",
        "pages": "page_id, url, CASE WHEN page_id % 9 = 1 THEN NULL WHEN page_id % 9 = 2 "
                 "THEN 'a' || chr(13) || '<b' || chr(10) || 'c> <x>' || chr(8195) || 'fine' ELSE html END AS html",
    }
    for path in Path(source).glob("*.parquet"):
        columns = changed.get(path.stem, "*")
        con.execute(f"COPY (SELECT {columns} FROM '{path}') TO '{out}/{path.name}' (FORMAT parquet)")
    return str(out)

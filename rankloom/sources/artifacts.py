"""Fitted vocabularies, sparse vectors and dense vectors as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions.vectors import l2_normalize
from rankloom.staging import path_exists

VOCABULARY_COLUMNS = ["term", "term_id", "df", "tf", "idf"]
SPARSE_COLUMNS = ["doc_id", "term_ids", "weights"]
DENSE_COLUMNS = ["doc_id", "embedding"]


def _save(df: DataFrame, path: str, required: list[str]) -> str:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    df.write.mode("overwrite").parquet(path)
    return path


def _load(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def save_vocabulary(vocabulary: DataFrame, path: str) -> str:
    return _save(vocabulary, path, VOCABULARY_COLUMNS)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path)


def save_vectors(vectors: DataFrame, path: str) -> str:
    return _save(vectors, path, SPARSE_COLUMNS)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path)


def save_embeddings(vectors: DataFrame, path: str, normalize: bool = False) -> str:
    """Dense vectors, as they are or divided by their norm."""
    return _save(l2_normalize(vectors, "embedding") if normalize else vectors, path, DENSE_COLUMNS)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Read lazily: a scan touches only the columns and row groups a query needs."""
    return _load(spark, path).withColumn("dim", F.size("embedding").cast("long"))

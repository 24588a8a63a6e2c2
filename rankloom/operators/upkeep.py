"""A vocabulary that follows its corpus: signed changes of term statistics instead of a second look at old texts.

Every change is a table of ``term, df, tf``, counted over documents that come (positive) or go (negative), and one row without
a term that carries the number of documents. Changes are appended below one path and compacted into one when they are many;
a refit sums them and chooses terms as ``fit_vocabulary`` does over the documents that are left.

Defined cases: documents that come and go leave no trace; a term whose counts are 0 is dropped when changes are summed. Sums
below 0 mean that a document went which never came: a refit then fails. Repeated rows count each. Null tokens have no terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankloom.operators.tfidf import TfidfSettings, term_stats
from rankloom.staging import delete_path, list_folder, stage

SCHEMA = "term string, df bigint, tf bigint"


def term_change(tokens: DataFrame, settings: TfidfSettings, sign: int = 1) -> DataFrame:
    """``term, df, tf`` of documents that come, or go with ``sign`` -1."""
    if sign not in (1, -1):
        raise ValueError("sign must be 1 or -1")
    known = tokens.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    counted = term_stats(known, settings.ngram_range).select("term", (sign * F.col("df")).alias("df"), (sign * F.col("tf")).alias("tf"))
    number = known.agg(F.lit(None).cast("string").alias("term"), (sign * F.count("*")).alias("df"), F.lit(0).cast("long").alias("tf"))
    return counted.unionByName(number)


def append_change(change: DataFrame, path: str, name: str) -> str:
    """Write a change once under its name; names rise from change to change, as text.

    A name that is already there, or in a sum, is left alone, so a repeated run changes nothing.
    """
    spark, target = change.sparkSession, f"{path}/change={name}"
    if "_SUCCESS" not in list_folder(spark, target) and name > max(_complete(spark, path, "base"), default=""):
        change.write.mode("overwrite").parquet(target)
    return target


def _complete(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Names of the complete tables of a kind below a path, in order."""
    found = [n.removeprefix(f"{kind}=") for n in list_folder(spark, path) if n.startswith(f"{kind}=")]
    return [n for n in found if "_SUCCESS" in list_folder(spark, f"{path}/{kind}={n}")]


def current_tables(spark: SparkSession, path: str) -> list[str]:
    """The latest sum and the changes that came after it."""
    base = max(_complete(spark, path, "base"), default="")
    return [f"{path}/base={base}"] * bool(base) + [f"{path}/change={n}" for n in _complete(spark, path, "change") if n > base]


def summed(spark: SparkSession, path: str) -> DataFrame:
    """``term, df, tf`` over all changes; the row without a term has the number of documents."""
    folders = current_tables(spark, path)
    every = spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
    return every.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df <> 0 OR tf <> 0")


def compact(spark: SparkSession, path: str) -> None:
    """All changes so far as one sum, named after the last of them.

    A sum stands for itself and every change up to its name from the moment it is complete, so a job that is lost on the way
    neither loses nor doubles a change; what it replaces is deleted last.
    """
    names = _complete(spark, path, "change")
    old = current_tables(spark, path)
    if len(old) < 2:
        return
    summed(spark, path).write.mode("overwrite").parquet(f"{path}/base={names[-1]}")
    for folder in old:
        delete_path(spark, folder)


def refit_vocabulary(spark: SparkSession, path: str, settings: TfidfSettings) -> DataFrame:
    """The vocabulary of the documents that are left, ``term, term_id, df, tf, idf``, without reading any text."""
    stats = stage(summed(spark, path), "term-sums")
    n_docs, wrong = stats.agg(F.coalesce(F.max(F.when(F.col("term").isNull(), F.col("df"))), F.lit(0)),
                              F.count(F.when((F.col("df") < 0) | (F.col("tf") < 0), 1))).first()
    if wrong:
        raise ValueError(f"{wrong} terms were taken away more often than they were added")
    kept = (stats.where(F.col("term").isNotNull() & (F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * n_docs))
            .orderBy(F.desc("tf"), "term").limit(settings.max_features))
    # max_features bounds this table, so numbering it in one task is safe.
    numbered = kept.withColumn("term_id", F.row_number().over(Window.orderBy("term")) - 1)
    vocabulary = stage(numbered.select(
        "term", "term_id", "df", "tf",
        (F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")), "vocabulary")
    if vocabulary.isEmpty():
        raise ValueError("no terms remain: lower min_df or raise max_df")
    return vocabulary

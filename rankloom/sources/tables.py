"""Document tables from CSV, line corpora, and read-through materialization."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions.text import clean_column
from rankloom.operators.sampling import sample_exact
from rankloom.staging import path_exists, stage


# Fields that count as missing in a CSV file, next to the empty field.
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text; quoted fields may hold line ends and doubled quotes.

    Empty fields and the usual markers of a missing value are null. A file with line ends inside fields
    is read by one task, so large exports should be many files.
    """
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)


def _columns(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    df = read_csv(spark, path)
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]).dropna(how="any")


def load_resumes(spark: SparkSession, path: str) -> DataFrame:
    """``role, text`` from ``Category, Resume_str``; rows with a null are dropped."""
    return _columns(spark, path, {"Category": "role", "Resume_str": "text"})


def load_jobs(spark: SparkSession, path: str, sample_size: int | None = None,
              resume_count: int | None = None, seed: int = 42, id_column: str | None = None) -> DataFrame:
    """``title, text`` from ``Job Title, Job Description``, optionally an exact-size sample.

    ``sample_size`` wins over ``resume_count``. The sample is drawn by ``id_column`` (kept, as a number)
    when the file has one; other rows are keyed once and staged, so that repeated tasks agree.
    """
    names = {"Job Title": "title", "Job Description": "text"}
    if id_column:
        jobs = _columns(spark, path, {id_column: id_column, **names})
        jobs = jobs.withColumn(id_column, F.col(id_column).cast("long"))
    else:
        jobs = _columns(spark, path, names)
    wanted = sample_size if sample_size is not None else resume_count
    if wanted is None:
        return jobs
    if id_column:
        return sample_exact(jobs, id_column, wanted, seed)
    # Equal rows get different keys; which of them is drawn makes no difference to the result.
    content = F.sha2(F.concat_ws("\x00", "title", "text"), 256)
    keyed = stage(jobs.withColumn("_id", F.concat_ws("#", content, F.monotonically_increasing_id())), "jobs")
    return sample_exact(keyed, "_id", wanted, seed).drop("_id")


def load_job_titles(spark: SparkSession, path: str) -> DataFrame:
    """A CSV that must have a ``title`` column."""
    df = read_csv(spark, path)
    if "title" not in df.columns:
        raise ValueError("the job file must have a 'title' column")
    return df


def load_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: the stripped, non-blank lines of UTF-8 text files."""
    return strip_lines(spark.read.text(path), "value")


def spread(df: DataFrame) -> DataFrame:
    """Give a table that Spark reads in fewer splits than there are cores to all cores.

    A table of many splits stays as it is, so only small ones are dealt out, by the number of the row: texts need not be
    sorted for that, and no key can be hot.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # A table as it is read has no exchange, so this plans its splits and runs nothing.
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    if splits >= cores:
        return df
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(cores, "_row").drop("_row")


def strip_lines(df: DataFrame, column: str) -> DataFrame:
    line = F.regexp_replace(F.col(column), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return df.withColumn("line", line).where(F.col("line") != "").drop(column)


def read_through(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path`` if it was completely written before; else compute, write, read."""
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_or_clean(spark: SparkSession, cleaned_path: str, load: Callable[[], DataFrame],
                  column: str = "text") -> DataFrame:
    """The cleaned table, cleaned and written on the first call; later calls only read it."""
    return read_through(spark, cleaned_path, lambda: clean_column(load(), column))


def load_or_clean_resumes(spark: SparkSession, cleaned_path: str, raw_path: str) -> DataFrame:
    return load_or_clean(spark, cleaned_path, lambda: load_resumes(spark, raw_path))


def load_or_clean_jobs(spark: SparkSession, cleaned_path: str, raw_path: str,
                       sample_size: int | None = None, id_column: str | None = None) -> DataFrame:
    return load_or_clean(spark, cleaned_path, lambda: load_jobs(spark, raw_path, sample_size, id_column=id_column))


"""Versioned tables: ``<base>/version=<yyyyMMddHHmmss>``, of which the newest are kept."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.staging import delete_path, list_folder


def version_label(ts: Column) -> Column:
    """Day-first time stamp for file names."""
    return F.date_format(ts, "dd-MM-yyyy_HH-mm-ss")


def versions_to_keep(versions: DataFrame, max_versions: int = 2) -> DataFrame:
    """``version, keep``: the newest ``max_versions`` by time, which is the order of the text."""
    newest = versions.select("version").distinct().orderBy(F.desc("version")).limit(max_versions)
    oldest_kept = newest.agg(F.min("version")).scalar()
    return versions.select("version", (F.col("version") >= oldest_kept).alias("keep"))


def list_versions(spark: SparkSession, base: str) -> list[str]:
    """Completely written versions, oldest first."""
    names = [n.split("=", 1)[1] for n in list_folder(spark, base) if n.startswith("version=")]
    return [v for v in names if "_SUCCESS" in list_folder(spark, f"{base}/version={v}")]


def save_version(df: DataFrame, base: str, max_versions: int = 2, version: str | None = None) -> str:
    """Write a new version, then delete all but the newest ``max_versions``. Returns its path.

    A version older than those that would be kept is refused, since it would be deleted at once.
    """
    if max_versions < 1:
        raise ValueError("max_versions must be at least 1")
    spark = df.sparkSession
    version = version or datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S")
    kept = list_versions(spark, base)[-max_versions:]
    if len(kept) == max_versions and version < kept[0]:
        raise ValueError(f"version {version} is older than the {max_versions} that are kept")
    path = f"{base.rstrip('/')}/version={version}"
    df.write.parquet(path)
    for old in list_versions(spark, base)[:-max_versions]:
        delete_path(spark, f"{base}/version={old}")
    return path


def load_version(spark: SparkSession, base: str, version: str | None = None) -> DataFrame:
    """One version, by default the newest."""
    versions = list_versions(spark, base)
    if not versions:
        raise ValueError(f"no saved version under {base}")
    return spark.read.parquet(f"{base}/version={version or versions[-1]}")

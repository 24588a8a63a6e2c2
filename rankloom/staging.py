"""Written intermediate tables.

A multi-step job writes the tables that later steps read more than once. They go to the
shared folder the session names in ``spark.checkpoint.dir``, so they outlive any executor,
stay columnar, and cut the lineage of everything built on them.
"""

from __future__ import annotations

import atexit
import os
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, list[str]] = {}
_scope = threading.local()


def staging_root(spark: SparkSession) -> str:
    """The shared folder of this session, in ``spark.checkpoint.dir`` or set as its context's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    return root.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the staging folder, remembered until ``release``."""
    path = f"{staging_root(spark)}/rankloom/{label}-{uuid.uuid4().hex}"
    application = spark.sparkContext.applicationId
    if application not in _staged:
        atexit.register(_release_at_exit, spark)
    _staged.setdefault(application, []).append(path)
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    return path


def _release_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        release(spark)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the table that reads it back."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def drop_staged(spark: SparkSession, keep: Sequence[str] = ()) -> Iterator[None]:
    """Delete at the end what this thread staged since the beginning, but for tables with a label in ``keep``."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        staged = _staged.get(spark.sparkContext.applicationId, [])
        for path in _scope.paths:
            if path.rsplit("/", 1)[1].rsplit("-", 1)[0] in keep:
                if outer is not None:
                    outer.append(path)
                continue
            delete_path(spark, path)
            if path in staged:
                staged.remove(path)
        _scope.paths = outer


def release(spark: SparkSession) -> None:
    """Delete what this session staged, once no result that reads it is needed any more."""
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        delete_path(spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct children of a folder, empty when it does not exist."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path))


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it, if it is one of the file system that driver and executors mount."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()
    return "/" + whole.removeprefix("file:").lstrip("/") if whole.startswith("file:") else None


def empty_files(spark: SparkSession, path: str) -> tuple[list[str], dict[str, tuple[int, int]]]:
    """Files of length 0 directly in a folder, or the given file if it is one; and of the others the number and the bytes by
    their endings in lower case."""
    sizes = _file_sizes(spark, path)
    others: dict[str, tuple[int, int]] = {}
    for name, size in sizes:
        if size:
            ending = os.path.splitext(name)[1].lower()
            n, total = others.get(ending, (0, 0))
            others[ending] = n + 1, total + size
    return [name for name, size in sizes if not size], others


def _file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    local = local_path(spark, path)
    if local is not None:
        if os.path.isfile(local):
            return [(f"file:{local}", os.path.getsize(local))]
        with os.scandir(local) as entries:
            return [(f"file:{local.rstrip('/')}/{e.name}", e.stat().st_size) for e in entries if e.is_file()]
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(status.getPath().toString(), status.getLen()) for status in fs.listStatus(hadoop_path) if status.isFile()]


def delete_path(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)

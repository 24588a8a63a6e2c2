"""Ranks inside groups, top-k policy and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.staging import stage

# Spark cuts every map task to the first rows of a group by itself up to this many.
GROUP_LIMIT = 1000
MERGED_AT_ONCE = 200_000
TASK_BYTES = 128 << 20
SALTS = 64

# The wording that comes with a result.
MESSAGE_ALL = "✅ Showing all %s job matches, ranked by relevance."
MESSAGE_FEWER = "ℹ️ You requested %s matches, but only %s are available. Showing all %s matches."
MESSAGE_TOP = "✅ Showing the top %s job matches."


def check_top_k(top_k: int | None) -> None:
    """``None`` asks for all rows; anything below 1 is an error."""
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be at least 1, or None for all")


def effective_top_k(top_k: int | None, available: int) -> tuple[int, str]:
    """How many rows to show of those available, and the message that says so."""
    check_top_k(top_k)
    if top_k is None:
        return available, MESSAGE_ALL % available
    if top_k > available:
        return available, MESSAGE_FEWER % (top_k, available, available)
    return top_k, MESSAGE_TOP % top_k


def top_k_message(requested: Column, available: Column) -> Column:
    """The same message as a column; a null request asks for all rows."""
    return (F.when(requested.isNull(), F.format_string(MESSAGE_ALL, available))
            .when(requested > available, F.format_string(MESSAGE_FEWER, requested, available, available))
            .otherwise(F.format_string(MESSAGE_TOP, requested)))


def expected_tasks(df: DataFrame) -> int:
    """About how many tasks a table comes from, by Spark's own estimate of its size; nothing is run."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 1 + size // TASK_BYTES


def rank_top(scored: DataFrame, group: str, order: list[Column], k: int, spread_by: str) -> DataFrame:
    """The first ``k`` rows of every group with their ``rank``.

    No task sorts a whole group: rows are cut to ``k`` before the shuffle. Where many tasks would send one group
    more than ``MERGED_AT_ONCE`` rows in all, they are cut within salted parts of the group first.
    """
    if k > GROUP_LIMIT or k * expected_tasks(scored) > MERGED_AT_ONCE:
        part = Window.partitionBy(group, "_salt").orderBy(*order)
        scored = (scored.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
                  .withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k).drop("_n", "_salt"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def rank_all(scored: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Every row with its ``rank`` in its group, a hot group being ranked by many tasks.

    Rows are range-partitioned by group and order, ranked inside each partition, and shifted by the
    number of rows their group has in earlier partitions.
    """
    parts = stage(scored.repartitionByRange(F.col(group), *order)
                  .withColumn("_part", F.spark_partition_id()), "ranked")
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (parts.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
              .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
              .drop("_rows"))
    local = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return (parts.withColumn("_local", local).join(shifts, [group, "_part"])
            .withColumn("rank", (F.col("_local") + F.col("_before")).cast("long"))
            .drop("_local", "_before", "_part"))


def clip_score(score: Column) -> Column:
    """Scores never show above 1."""
    return F.least(F.lit(1.0), score)


def display_score(score: Column, places: int = 4) -> Column:
    return F.format_number(score, places)


def attach_title(found: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """Add the title of each found row by key."""
    return found.join(titles, key)

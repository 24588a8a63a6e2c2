"""Groups of rows that meet in tasks, in parts of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pair_up_parts(members: DataFrame, part: str, parts: str) -> DataFrame:
    """Every member once for each part of its group: ``one, other`` number the parts that meet, and ``side`` is 1 for
    members of the second one (0 where a part meets itself)."""
    return (members.withColumn("_met", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
            .withColumn("one", F.least(part, "_met")).withColumn("other", F.greatest(part, "_met"))
            .withColumn("side", (F.col(part) > F.col("_met")).cast("int")).drop("_met", part, parts))

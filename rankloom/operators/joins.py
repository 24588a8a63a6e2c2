"""Equi-joins whose small side is broadcast only when it is measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_BYTES = 64 << 20


def table_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take: texts and binaries by their length, any other value 8."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else
             F.lit(8) * F.greatest(F.size(c), F.lit(1)) if kind.startswith("array") else F.lit(8)
             for c, kind in df.dtypes]
    return df.agg(F.sum(sum(sizes, F.lit(16)).cast("long"))).first()[0] or 0


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    return table_bytes(df) <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes)


def join_lookup(big: DataFrame, lookup: DataFrame, on: str | list[str], how: str,
                max_bytes: int | None = None) -> DataFrame:
    """Join rows to a lookup table with one row per ``on``.

    The lookup is measured first and broadcast up to ``max_bytes``. A larger one is shuffled; Spark's adaptive
    execution splits the partition of a hot key, since neither side is bound to stay whole.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return big.join(F.broadcast(lookup) if fits_broadcast(lookup, max_bytes) else lookup.hint("merge"), keys, how)

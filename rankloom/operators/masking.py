"""Preparation of token sequences for masked language modelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.operators.joins import fits_broadcast
from rankloom.operators.ranking import rank_all

PAD, MASK = "[PAD]", "[MASK]"


def pad_or_truncate(tokens: Column, length: int = 256) -> Column:
    """Exactly ``length`` structs ``token, mask``: the first tokens, then padding with mask 0."""
    real = F.transform(F.slice(tokens, 1, length),
                       lambda t: F.struct(t.alias("token"), F.lit(1).cast("long").alias("mask")))
    padding = F.array_repeat(F.struct(F.lit(PAD).alias("token"), F.lit(0).cast("long").alias("mask")),
                             F.greatest(F.lit(length) - F.size(tokens), F.lit(0)))
    return F.concat(real, padding)


def _draw(purpose: str, seed: int) -> Column:
    """A repeatable number in [0, 2^28) per (document, position)."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.lit(f"{purpose}{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long")


def mask_tokens(tokens: DataFrame, vocabulary: DataFrame, probability: float = 0.15, length: int = 256,
                seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, pos, token, label`` (and the ``keep`` columns).

    Of the selected positions 80 % become [MASK], 10 % a random vocabulary word and 10 % stay; ``label`` is
    the original token there and null elsewhere. ``vocabulary`` has ``term`` and may have any size.
    """
    threshold = 1 << 28
    size = vocabulary.count()
    terms = vocabulary.select(F.col("term").alias("random_token"))
    if fits_broadcast(terms):
        # Measured to be small: numbered in one task.
        numbered = F.broadcast(terms.withColumn(
            "random_id", (F.row_number().over(Window.orderBy("random_token")) - 1).cast("long")))
    else:
        ranked = rank_all(terms.withColumn("_all", F.lit(0)), "_all", [F.asc("random_token")])
        numbered = ranked.select("random_token", (F.col("rank") - 1).alias("random_id"))
    drawn = (tokens.select("doc_id", *keep, F.posexplode(F.slice("tokens", 1, length)).alias("pos", "word"))
             .withColumn("pos", F.col("pos").cast("long"))
             .withColumn("chosen", _draw("select", seed) < int(probability * threshold))
             .withColumn("action", _draw("action", seed))
             .withColumn("random_id", F.when(F.col("chosen") & (F.col("action") >= int(0.8 * threshold))
                                             & (F.col("action") < int(0.9 * threshold)),
                                             F.pmod(_draw("word", seed), F.lit(size)))))
    joined = drawn.join(numbered, "random_id", "left")
    token = (F.when(F.col("chosen") & (F.col("action") < int(0.8 * threshold)), MASK)
             .otherwise(F.coalesce("random_token", "word")))
    return joined.select("doc_id", *keep, "pos", token.alias("token"),
                         F.when(F.col("chosen"), F.col("word")).alias("label"))

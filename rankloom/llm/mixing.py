"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Each source gets a target: its weight's part of a total; a target above ``max_repeat`` times the size of
   its source is cut to that, and the excess is shared again by weight until none is above.
2. The total is dealt in equal blocks of one word, so that a source of any size comes within a word of its target. A source
   with target t has the quotients t / 1, t / 3, t / 5, ...; the highest quotients over all sources get a block each.
   The count per source is its quota.
3. A source is cut into shards of about ``shard_words`` by the hash of its documents, so that no task holds a large
   source. Its quota goes to its shards by the same method, by their sizes.
4. In a shard the documents lie one behind the other in seeded order, cut into runs of ``block`` words. Every word is taken
   quota // size times; of what is left of the quota whole runs are taken once more in a seeded choice, and the beginning of
   the next one, so that the shard gives its quota to the word.

Defined cases: null text has size 0 and takes 0. Sources are ordered by code point, null last, and null is a source of
its own. Rows with a null id are placed by their text. Repeated rows are documents of their own. A source of size 0 has target and quota 0.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.llm.words import let, words
from rankloom.staging import stage

# A prime above any number of blocks in a shard: multiples of it visit every block once.
STRIDE = 2147483647


def text_size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _source_key(source: Column) -> Column:
    """Groups and joins need one value for the null source."""
    return F.struct(source.isNull().alias("missing"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))


def _number(digest: Column) -> Column:
    """The first 32 bits of a digest in hex."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: int) -> DataFrame:
    """``source_key, source_size, source_no, weight, target`` from ``source_key, size``."""
    # One row per source from here on: numbered in one task, a few bytes each.
    sources = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    numbered = sources.withColumn("source_no", F.row_number().over(Window.orderBy("source_key")) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stage(numbered.withColumn("weight", F.get(cycle, F.pmod(F.col("source_no"), F.lit(len(weights))))),
                    "sources")
    goal = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    limit = max_repeat * F.col("source_size")
    # Raising the level only adds sources to the capped ones, so this ends after at most one round per source.
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > limit
        full, rest, n = weighed.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.sum(F.when(~above, F.col("weight"))),
            F.count(F.when(above, 1))).first()
        if n == capped or not rest:
            break
        level, capped = (goal - full) / rest, n
    target = F.least(F.lit(float(level)) * F.col("weight"), limit.cast("double"))
    return weighed.withColumn("target", target)


def sainte_lague(parties: DataFrame, group: Sequence[str], seats: str, votes: str, order: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group go to the highest of votes / 1, votes / 3, votes / 5, ...

    Ties go to the lower ``order``. With n parties, a divisor for seats - n gives no party a seat too many and one for
    seats + n none too few; only the at most 3 n + 1 quotients between them are ranked.
    """
    whole = Window.partitionBy(*group)
    n, total = F.col("_n"), F.col("_total")
    by_divisor = lambda count: F.floor(F.col(votes) * count / total + 0.5)
    bounded = (parties.withColumn("_n", F.count("*").over(whole)).withColumn("_total", F.sum(votes).over(whole))
               .withColumn("_low", F.when((total > 0) & (F.col(seats) > n), by_divisor(F.col(seats) - n)).otherwise(0))
               .withColumn("_high", F.when((total > 0) & (F.col(seats) > 0), by_divisor(F.col(seats) + n)).otherwise(0))
               .withColumn("_low", F.least("_low", "_high")))
    open_seats = F.col(seats) - F.sum("_low").over(whole)
    candidates = (bounded.withColumn("_open", open_seats)
                  .withColumn("_k", F.explode_outer(F.when(
                      F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)))))
    quotient = F.col(votes) / (2 * F.col("_k") + 1)
    ranked = candidates.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), order, "_k")))
    won = F.count(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_open")), 1))
    kept = [F.first(c).alias(c) for c in parties.columns if c not in (*group, order)]
    return (ranked.groupBy(*group, order).agg(*kept, (F.first("_low") + won).alias("quota")))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2,
        block: int = 64, shard_words: int = 1 << 18, seed: int = 17, key: str = "doc_id", text_column: str = "text",
        source_column: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """``key, size, source_size, target, taken, runs`` and ``kept``, a struct of the ``keep`` columns, for every row of ``docs``.

    ``taken`` is the number of words the mix takes from the document, repeats counted, at most ``max_repeat`` times
    its size. ``runs`` lists them in order: structs ``at, words, copies`` of places in its list of words.
    """
    picked = docs.select(docs[key].alias("id"), _source_key(docs[source_column]).alias("source_key"),
                         text_size(docs[text_column]).alias("size"),
                         F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(
                             docs[key].cast("string"), F.md5(F.coalesce(docs[text_column], F.lit("")).cast("binary")))))
                         .alias("place"), *([F.struct(*[docs[c] for c in keep]).alias("kept")] if keep else []))
    # Kept columns travel once, to their shard, and are not written on the way.
    sized = stage(picked.drop("kept"), "sizes")
    targets = source_targets(sized, weights, share, max_repeat)
    # Sources are one row each: few enough for a broadcast as long as they are counted to be so.
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    seats = F.floor(F.sum("target").over(Window.partitionBy("all")) + 0.5).cast("long")
    sources = stage(sainte_lague(
        targets.withColumn("all", F.lit(1)).withColumn("seats", seats), ["all"], "seats", "target", "source_no")
        .select("source_key", "source_size", "source_no", "target", F.col("quota").alias("source_quota"),
                shards.alias("n_shards")), "quotas")
    placed = ((picked if keep else sized).join(sources.select("source_key", "source_no", "source_size", "target", "n_shards"), "source_key")
              .withColumn("shard", F.pmod(_number(F.col("place")), F.col("n_shards"))))
    sizes = (placed.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"))
             .join(sources.select("source_no", "source_quota"), "source_no"))
    quotas = (sainte_lague(sizes, ["source_no"], "source_quota", "shard_size", "shard")
              .select("source_no", "shard", "shard_size",
                      F.least("quota", max_repeat * F.col("shard_size")).alias("quota")))
    line = (Window.partitionBy("source_no", "shard").orderBy("place", "id", "size")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = (placed.withColumn("start", F.sum("size").over(line) - F.col("size"))
            .join(stage(quotas, "shard-quotas"), ["source_no", "shard"]))
    shift = _number(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("source_no").cast("string"), F.col("shard").cast("string"))))
    # Whole blocks take turns; the shorter one at the end comes last.
    n_whole, rest = F.floor(F.col("shard_size") / block), F.pmod(F.col("quota"), F.col("shard_size"))
    turn = lambda j: F.when(j < n_whole, F.pmod(j * F.lit(STRIDE) + shift, F.greatest(n_whole, F.lit(1)))).otherwise(n_whole)
    passes = F.floor(F.col("quota") / F.col("shard_size")).cast("long")
    end = F.col("start") + F.col("size")
    first_block, last_block = F.floor(F.col("start") / block), F.floor((end - 1) / block)

    def run(low: Column, high: Column, copies: Column) -> Column:
        low, high = F.greatest(low, F.col("start")), F.least(high, end)
        return F.struct((low - F.col("start")).cast("long").alias("at"), (high - low).cast("long").alias("words"),
                        copies.alias("copies"))

    def both_runs(j: Column) -> Column:
        """The words of a block that are taken once more, and the others."""
        more = j * block + F.least(F.greatest(rest - turn(j) * block, F.lit(0)), F.lit(block))
        return F.array(run(j * block, more, passes + 1), run(more, (j + 1) * block, passes))

    runs = F.when(F.col("size") > 0, F.filter(F.flatten(F.transform(F.sequence(first_block, last_block), both_runs)),
                                              lambda r: r["words"] > 0)).otherwise(
        F.array().cast("array<struct<at:bigint,words:bigint,copies:bigint>>"))
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["words"] * r["copies"])
    return (laid.withColumn("runs", runs)
            .select(F.col("id").alias(key), "size", "source_size", "target", taken.alias("taken"), "runs",
                    *(["kept"] if keep else [])))


def mixed_texts(text: Column, size: Column, runs: Column, max_repeat: int = 2) -> Column:
    """The texts a document adds to the mix: the whole text for a pass that takes all of it, else its taken words."""
    def one(times: Column) -> Column:
        kept = F.filter(runs, lambda r: r["copies"] > times)
        count = F.aggregate(kept, F.lit(0).cast("long"), lambda total, r: total + r["words"])
        pieces = let(words(text), lambda w: F.array_join(F.flatten(F.transform(
            kept, lambda r: F.slice(w, r["at"].cast("int") + 1, r["words"].cast("int")))), " "))
        return F.when(count == size, text).when(count > 0, pieces)
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_repeat - 1)), one)
    return F.filter(passes, lambda t: t.isNotNull())

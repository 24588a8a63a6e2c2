"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

A rule is a name and a boolean expression that is true for texts to reject. On a bounded sample each rule's
share of rejected rows and its running time are measured; rules are then tried by rejection per second, the best
first, inside one CASE, so that a row costs no more than the rules up to its first rejection. The order changes
what a row costs and never whether it is kept, so reruns agree whatever the clock says.

Defined cases: null text counts as '' (no words, rejected by the minimum of words). Rules are total: a rule that
yields null does not reject. Repeated rows are judged alike, one result each; an empty table gives an empty result,
and an empty sample leaves the rules in the given order. Words are maximal runs without space and \\t to \\r.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.llm.words import SPACES, let, words
from rankloom.staging import stage

SYMBOLS = "#*$%&|<>"
# A position in a text takes 20 bits beside the hash of its window; longer texts sort pairs instead.
POSITION_BITS = 20
POSITION_MASK = (1 << POSITION_BITS) - 1


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an expression over the columns that ``base_metrics`` adds, or over any other column."""

    name: str
    rejects: Column


def word_chars(text: Column) -> Column:
    """Code points that belong to words."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def count_symbols(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long")


def count_capitals(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}")).cast("long")


def count_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def count_repeated_words(listed: Column, window: int = 3) -> Column:
    """Words that lie in a window of words found twice or more in the text, its first place included.

    Windows are compared by 64-bit hash. They are sorted as numbers that hold hash and position, where the cut
    hashes still tell all windows of the text apart, and as pairs otherwise.
    """
    zero = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(
            F.lit(window).cast("long"), F.coalesce(F.get(places, i + 1) - p, F.lit(window).cast("long"))))
        return F.aggregate(steps, zero, lambda total, step: total + step)

    def repeated(ordered: Column, key) -> Column:
        return F.filter(ordered, lambda x, i: F.coalesce(key(x) == key(F.get(ordered, i + 1)), F.lit(False))
                        | F.coalesce((i > 0) & (key(x) == key(F.get(ordered, i - 1))), F.lit(False)))

    def by_number(hashes: Column) -> Column:
        packed = F.transform(hashes, lambda h, i: _cut(h).bitwiseOR(i.cast("long")))
        found = let(F.sort_array(packed), lambda s: repeated(s, lambda x: F.shiftright(x, POSITION_BITS)))
        return let(F.sort_array(F.transform(found, lambda x: x.bitwiseAND(F.lit(POSITION_MASK).cast("long")))), covered)

    def by_pair(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("at")))
        found = let(F.sort_array(pairs), lambda s: repeated(s, lambda x: x["h"]))
        return let(F.sort_array(F.transform(found, lambda x: x["at"])), covered)

    def count(hashes: Column) -> Column:
        kinds = F.size(F.array_distinct(hashes))
        told_apart = (F.size(F.array_distinct(F.transform(hashes, _cut))) == kinds) & (F.size(hashes) <= POSITION_MASK)
        return (F.when(kinds == F.size(hashes), zero).when(told_apart, by_number(hashes)).otherwise(by_pair(hashes)))

    def windows(codes: Column) -> Column:
        starts = F.slice(codes, 1, F.size(codes) - (window - 1))
        return F.transform(starts, lambda first, i: F.xxhash64(first, *[F.get(codes, i + k) for k in range(1, window)]))

    return F.when(F.size(listed) <= window, zero).otherwise(
        let(F.transform(listed, lambda w: F.xxhash64(w)), lambda codes: let(windows(codes), count)))


def _cut(h: Column) -> Column:
    return h.bitwiseAND(F.lit(~POSITION_MASK).cast("long"))


METRICS = {
    "n_words": lambda text: F.size(words(text)).cast("long"),
    "word_chars": word_chars,
    "n_symbols": count_symbols,
    "n_dup_lines": count_duplicate_lines,
    "n_repeat_words": lambda text: count_repeated_words(words(text)),
    "n_capitals": count_capitals,
}


def base_metrics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns and the metrics; a column that has the name of a metric is replaced."""
    kept = [c for c in docs.columns if c not in METRICS]
    listed = docs.select(*kept, *[METRICS[m](docs[text_column]).alias(m)
                                  for m in METRICS if m not in ("n_words", "n_repeat_words")],
                         let(words(docs[text_column]), lambda w: F.struct(
                             F.size(w).cast("long").alias("n_words"),
                             count_repeated_words(w).alias("n_repeat_words"))).alias("_words"))
    return listed.select(*kept, *[F.col(f"_words.{m}").alias(m) if m in ("n_words", "n_repeat_words") else m
                                  for m in METRICS])


def base_failed(n_words: Column, n_repeat_words: Column, min_words: int = 50, max_repeat: int = 50) -> Column:
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat * n_words)


def default_rules(metric) -> list[Rule]:
    """``metric`` gives the column of a metric by name: computed already, or an expression over the text."""
    n = metric("n_words")
    return [
        Rule("too few words", n < 50),
        Rule("repeated windows", 100 * metric("n_repeat_words") > 50 * n),
        Rule("word length", (metric("word_chars") < 2 * n) | (metric("word_chars") > 25 * n)),
        Rule("symbols", 100 * metric("n_symbols") > 40 * n),
        Rule("capitals", 2 * metric("n_capitals") > metric("word_chars")),
        Rule("repeated lines", 100 * metric("n_dup_lines") > 30 * (metric("n_dup_lines") + n / 10.0)),
    ]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float


def measure(sample: DataFrame, rules: Sequence[Rule], repeats: int = 2) -> list[Measured]:
    """Each rule alone over the sample: its share of rejected rows and its fastest time beyond an empty pass."""
    def timed(column: Column) -> tuple[float, float]:
        query, best = sample.agg(F.avg(F.coalesce(column, F.lit(False)).cast("double"))), float("inf")
        for _ in range(repeats):
            start = time.perf_counter()
            share = query.first()[0]
            best = min(best, time.perf_counter() - start)
        return best, share or 0.0

    idle, _ = timed(F.lit(False))
    found = [(rule, *timed(rule.rejects)) for rule in rules]
    return [Measured(rule, max(seconds - idle, 1e-4), share) for rule, seconds, share in found]


def order_rules(measured: Sequence[Measured]) -> list[Rule]:
    """Most rejections per second first; equal ones keep their order."""
    return [m.rule for m in sorted(measured, key=lambda m: -m.rejected / m.seconds)]


def rejected(rules: Sequence[Rule]) -> Column:
    """The cascade: later rules are not evaluated once one has rejected."""
    chain = F
    for rule in rules:
        chain = chain.when(F.coalesce(rule.rejects, F.lit(False)), True)
    return chain.otherwise(False) if rules else F.lit(False)


def text_rejected(text: Column, order: Sequence[str]) -> Column:
    """The cascade of the default rules, by name, over a text that is cut into words once."""
    def chain(listed: Column) -> Column:
        of_words = {"n_words": F.size(listed).cast("long"), "n_repeat_words": count_repeated_words(listed)}
        by_name = {r.name: r for r in default_rules(lambda m: of_words[m] if m in of_words else METRICS[m](text))}
        return rejected([by_name[name] for name in order])

    return let(words(text), chain)


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", sample_rows: int = 2000) -> list[Rule]:
    """The rules in cascade order, measured on at most ``sample_rows`` rows picked by the hash of their key."""
    share = min(1.0, 2.0 * sample_rows / max(docs.count(), 1))
    picked = docs.where(F.pmod(F.xxhash64(docs[key]), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample_rows)
    return order_rules(measure(stage(picked, "rule-sample"), rules))

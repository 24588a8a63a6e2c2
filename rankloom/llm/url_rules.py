"""URL filter: host suffixes and path prefixes looked up by short hash, confirmed by full digest.

A rule is a host, a path and a verdict. It fits its host and every subdomain, if the url's path starts with
its path; among fitting rules the longest wins (host and path together, then the host), and ``block`` before
``allow`` if two rules have the same host and path. Urls without a fitting rule get ``default``.

Defined cases: a null url, or one without ``://``, has an empty host and path, and only ``default`` applies. Path
comparison is literal, so an empty path does not start with ``/``. Rules with a null host, path or verdict are
ignored; repeated rules count once. Repeated pages keep one row each, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.operators.joins import join_lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Hex digits of a digest that take part in the join: 32 bits.
SHORT = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; '' without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, counts: Sequence[int]) -> Column:
    """The last labels of a host, as many as each of ``counts`` says, for counts up to its number of labels.

    Only suffixes with as many labels as some rule's host can match one, so a host of any length has few.
    """
    n_labels = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    suffixes = [F.when((host != "") & (n_labels >= n), F.substring_index(host, ".", -n)) for n in counts]
    return F.filter(F.array(*suffixes).cast("array<string>"), lambda s: s.isNotNull())


def path_prefixes(path: Column, lengths: Column) -> Column:
    """The prefixes of a path that have one of the given lengths."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(path)),
                       lambda n: F.substring(path, F.lit(1), n))


def _digests(expressions: DataFrame) -> DataFrame:
    """Adds the full digest of an expression and the short prefix it is joined on."""
    full = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    return (expressions.withColumn("digest", full)
            .withColumn("short", F.conv(F.substring("digest", 1, SHORT), 16, 10).cast("long")))


def judge_urls(pages: DataFrame, url_column: str, rules: DataFrame, default: str = "allow",
               max_bytes: int | None = None) -> DataFrame:
    """All columns of ``pages`` and ``host, path, rule, verdict``; these four replace columns of that name.

    ``rules`` has ``host, path, verdict``. Every distinct (host, path) is expanded once, however many rows have it.
    The lengths of rule paths bound the prefixes, so that a rule path need not end at a slash; the numbers of labels of
    rule hosts bound the suffixes, so that hosts of any length are judged.
    """
    known = (rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
                          F.col("verdict").alias("rule_verdict"))
             .dropna().groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict")))
    # One short array: rule paths have few distinct lengths, at most as many as the longest path has characters.
    n_labels = F.length("rule_host") - F.length(F.replace(F.col("rule_host"), F.lit("."))) + 1
    lengths, counts = known.agg(F.array_sort(F.collect_set(F.length("rule_path"))), F.array_sort(F.collect_set(n_labels))).first()
    kept = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict"}]
    parsed = pages.select(*[pages[c] for c in kept], url_host(pages[url_column]).alias("host"),
                          url_path(pages[url_column]).alias("path"))
    urls = parsed.select("host", "path").where("host <> ''").distinct()
    at = F.array(*[F.lit(int(n)) for n in lengths]).cast("array<int>")
    expanded = _digests(
        urls.withColumn("rule_host", F.explode(host_suffixes(F.col("host"), [int(n) for n in counts])))
        .withColumn("rule_path", F.explode(path_prefixes(F.col("path"), at))))
    hits = (join_lookup(expanded.drop("rule_host", "rule_path"),
                        _digests(known).withColumnRenamed("digest", "rule_digest"), "short", "inner", max_bytes)
            .where(F.col("digest") == F.col("rule_digest")))
    size = F.length("rule_host") + F.length("rule_path")
    best = (hits.groupBy("host", "path")
            .agg(F.max(F.struct(size.alias("size"), F.length("rule_host").alias("host_size"),
                                F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict")))
    return (parsed.join(best, ["host", "path"], "left")
            .select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))

"""URL rules: host suffixes and path prefixes met by an equi-join on short hash prefixes.

Native: DataFrame functions only.

A rule (host, path, action) fits its host and all subdomains of it when the url's path starts with the rule's path.
Every url is expanded into host-suffix x path-prefix expressions, but only with label counts and path lengths that
some rule has: other expressions cannot meet a rule. Expressions join the rules on the first 32 bits of a SHA-256
digest, then the full digest decides, and the longest rule wins.

Defined results: a null url, or one without `://`, has an empty host and path and meets no rule. Ports and user
names are part of the host as written. A rule without fit leaves `rule` null and the default verdict. Equally long
rules: the longer host wins, then the greater path, then `block` over `allow`. Repeated or null rows keep their number. Columns of the input
named like a result column are replaced; others pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8  # hex digits of the digest that the join sees


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, action string")


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of (host suffix, path prefix); only the given label counts and prefix lengths."""
    names = F.split(host, r"\.")
    suffixes = [F.when(F.size(names) >= n, F.array_join(F.slice(names, -n, n), ".")) for n in labels]
    prefixes = [F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    pairs = [F.when(s.isNotNull() & p.isNotNull(), F.struct(s.alias("h"), p.alias("p")))
             for s in suffixes for p in prefixes]
    return F.array_compact(F.array(*pairs))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (host and path of the winner, else null) and verdict.

    Work is done once per distinct (host, path); a url that fills a third of the rows is reduced before the
    shuffle, and the way back is a join that can be split. One row of rule sizes is read at plan time (label counts are
    bounded by DNS, lengths by the longest rule path).
    """
    rules = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
             .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action"))
    sizes = rules.agg(F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))),
                      F.sort_array(F.collect_set(F.char_length("rule_path")))).first()
    pages = pages.drop("host", "path", "rule", "verdict")
    pages = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if not sizes[0]:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rules = rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
    rules = rules.withColumn("short", F.substring("digest", 1, PREFIX))
    found = (pages.select("host", "path").distinct()
             .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), sizes[0], sizes[1])).alias("e"))
             .withColumn("expr_digest", _digest(F.col("e.h"), F.col("e.p")))
             .withColumn("short", F.substring("expr_digest", 1, PREFIX)))
    hits = found.join(rules, "short").where(
        (F.col("expr_digest") == F.col("digest")) & F.col("e.h").eqNullSafe(F.col("rule_host"))
        & F.col("e.p").eqNullSafe(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    rank = F.struct(F.char_length(name).alias("n"), F.char_length("rule_host").alias("h"), F.col("rule_path").alias("p"),
                    F.col("action").alias("a"), name.alias("rule"))
    best = (hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.a").alias("verdict")))
    return (pages.join(best, ["host", "path"], "left")
            .withColumn("verdict", F.coalesce("verdict", F.lit(default))))

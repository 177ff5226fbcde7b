"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, hilbert, kernel_quality, masked_lm, packing, prefix_trie, quality, secret_scan, simhash, suffix_dedup, url_filter, weighted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op1_url_filters"] = r"""
WITH rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, row_number() OVER () AS r,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM p JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (r)"""


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "lang", "source", (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))
    done = hilbert.shard_by_curve(slim, ["lang", "source", "size"], "doc_id", 16, "text_crc32")
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "curve")


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    counted = quality.materialize(quality.with_counts(docs).drop("text"))
    return quality.judge(counted, quality.fences(counted)).select("doc_id", *quality.COUNTS, "base_failed", "kept")


ORACLES["op5_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8) q),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) q, range(8) AS o(k) WHERE n > 1 GROUP BY r),
c AS (SELECT r, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
   - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
v AS (SELECT r, lang, source, base_failed, unnest([{', '.join(f"{{'m': '{m}', 'v': (1000 * {c}) // greatest(n_words, 1), 'slack': {s}}}" for m, (c, s) in quality.METRICS.items())}], recursive := true) FROM j),
b AS (SELECT *, (v >> greatest(length(bin(v)) - {quality.LEAD}, 0)) << greatest(length(bin(v)) - {quality.LEAD}, 0) AS b FROM v WHERE NOT base_failed),
o AS (SELECT lang, source, m, b, count(*) OVER s AS s_all, count(*) OVER l AS l_all, row_number() OVER (s ORDER BY b) AS s_at,
  row_number() OVER (l ORDER BY b) AS l_at, row_number() OVER (g ORDER BY b) AS g_at, count(*) OVER g AS g_all FROM b
  WINDOW s AS (PARTITION BY lang, source, m), l AS (PARTITION BY lang, m), g AS (PARTITION BY m)),
qs AS (SELECT lang, source, m, max(s_all) AS n, {', '.join(f"min(b) FILTER (s_at * 100 >= {q} * s_all) AS q{q}" for q in quality.QUARTILES)} FROM o GROUP BY ALL),
ql AS (SELECT lang, m, max(l_all) AS n, {', '.join(f"min(b) FILTER (l_at * 100 >= {q} * l_all) AS q{q}" for q in quality.QUARTILES)} FROM o GROUP BY ALL),
qg AS (SELECT m, {', '.join(f"min(b) FILTER (g_at * 100 >= {q} * g_all) AS q{q}" for q in quality.QUARTILES)} FROM o GROUP BY ALL),
f AS (SELECT qs.lang, qs.source, m, CASE WHEN qs.n >= {quality.MIN_GROUP} THEN qs.q75 WHEN ql.n >= {quality.MIN_GROUP} THEN ql.q75 ELSE qg.q75 END AS hi,
  CASE WHEN qs.n >= {quality.MIN_GROUP} THEN qs.q25 WHEN ql.n >= {quality.MIN_GROUP} THEN ql.q25 ELSE qg.q25 END AS lo
  FROM qs JOIN ql USING (m) JOIN qg USING (m) WHERE qs.lang IS NOT DISTINCT FROM ql.lang),
bad AS (SELECT DISTINCT v.r FROM v JOIN f ON v.m = f.m AND v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
  WHERE v.v > f.hi + {quality.SPREAD} * (f.hi - f.lo) + v.slack)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM j"""


@_query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path), path)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secret_scan.scan(docs).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(kind) for kind in secret_scan.KINDS],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


@_query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash.fingerprint_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@_query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return masked_lm.score(docs, masked_lm.train(docs)).select("doc_id", "n_tokens", "log_prob", "mean_log_prob")


@_query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = kernel_quality.quality_scores(docs, labels)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    nodes = prefix_trie.trie(prefix_trie.with_borrowed_heads(turns))
    return nodes.withColumn("ends_sha256", F.coalesce("ends", F.lit(prefix_trie.NO_IDS))).drop("ends")


@_query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.alignment(docs, *paths).withColumnRenamed("groups", "groups_sha256")

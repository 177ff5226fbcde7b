"""Topic search, hit filter and detail views. Details come as flat rows, one per linked
item, so a topic or word with very many links never becomes one huge row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .market import like_text, paginate

CONTENT_LIMIT = 500


def search_keys(topics: DataFrame, words: list[str], page: int = 1, size: int = 20, escape: bool = False) -> DataFrame:
    """(id, published_at, total) of one page of topics whose title or content has every word (any case), newest first.
    Texts are scanned once; only keys of hits are kept."""
    found = topics
    for word in words:
        pattern = f"%{like_text(word, escape)}%"
        found = found.filter(F.col("title").ilike(pattern) | F.col("content").ilike(pattern))
    return paginate(found.select("id", "published_at"), newest_first(), page, size)


def newest_first() -> list[Column]:
    return [F.desc("published_at"), F.desc("id")]


def search_topics(topics: DataFrame, words: list[str], page: int = 1, size: int = 20, escape: bool = False) -> DataFrame:
    """The page of `search_keys` with all columns of its topics: at most `size` ids, so the scan gets them as a list to skip
    what cannot have them."""
    keys = search_keys(topics, words, page, size, escape).collect()
    total = keys[0].total if keys else 0
    shown = topics.filter(F.col("id").isin([r.id for r in keys])) if keys else topics.limit(0)
    return shown.withColumn("total", F.lit(total).cast("bigint")).orderBy(*newest_first())


def filter_hits(topics: DataFrame, words: list[str], mode: str = "and", limit: int = 20) -> DataFrame:
    """The first hits in input order (`id`), case-sensitive, with the content cut for display."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    tests = [F.contains(text, F.lit(w)) for w in words]
    hit = reduce((lambda a, b: a | b) if mode == "or" else (lambda a, b: a & b), tests, F.lit(mode != "or"))
    return (topics.filter(hit).orderBy("id").limit(limit)
            .withColumn("content", F.substring("content", 1, CONTENT_LIMIT)))


def latest_topics(topics: DataFrame, n: int = 50) -> DataFrame:
    return topics.drop("content").orderBy(F.desc("published_at"), F.desc("id")).limit(n)


OUTCOMES = ("return_1d", "return_3d", "return_5d", "return_10d", "return_20d", "max_return_5d", "max_return_20d")
FLAGS = ("rise_10pct_flag", "rise_10pct_20d_flag")


def topic_detail(topics: DataFrame, links: DataFrame, topic_keywords: DataFrame, returns: DataFrame,
                 stocks: DataFrame, words: DataFrame, own_returns: bool = False) -> DataFrame:
    """Everything attached to the given topics: (topic_id, kind, item, name, context, confidence, event_date, returns, flags).
    `context` and `confidence` are those of the links (`mention_context`, `confidence`; `context` of words), null where
    a table does not have them. `own_returns` says that the returns are of these topics only, as those measured of them
    are, so that their topics need not be looked up."""
    ids = topics.select(F.col("id").alias("topic_id"))
    named = stocks.select(F.col("id").alias("stock_id"), "stock_code", "stock_name")
    kinds = {"context": "string", "confidence": "double", "event_date": "date", **dict.fromkeys(OUTCOMES, "double"),
             **dict.fromkeys(FLAGS, "boolean")}

    def rows(df: DataFrame, kind: str, item: str, name: str, **given: str) -> DataFrame:
        taken = {c: F.col(s) if s in df.columns else F.lit(None) for c, s in given.items()}
        if kind != "return" or not own_returns:
            df = df.join(ids, "topic_id", "left_semi")
        return df.select(
            "topic_id", F.lit(kind).alias("kind"), F.col(item).alias("item"), F.col(name).alias("name"),
            *[taken.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    own = words.select(F.col("id").alias("keyword_id"), "keyword", "normalized_keyword")
    outcome = {c: c for c in ("event_date", *OUTCOMES, *FLAGS)}
    return (rows(links.join(named, "stock_id"), "stock", "stock_code", "stock_name", context="mention_context", confidence="confidence")
            .unionByName(rows(topic_keywords.join(own, "keyword_id"), "keyword", "keyword", "normalized_keyword", context="context"))
            .unionByName(rows(returns.join(named, "stock_id"), "return", "stock_code", "stock_name", **outcome)))


def term_topics(topics: DataFrame, term_links: DataFrame, n: int = 100) -> DataFrame:
    """The newest n topics per word; the rank bound is applied before the shuffle too."""
    dated = topics.select(F.col("id").alias("topic_id"), F.col("topic_id").alias("topic_key"), "title", "author",
                          "published_at")
    w = Window.partitionBy("term").orderBy(F.desc("published_at"), F.desc("topic_id"))
    return (term_links.join(dated, "topic_id").withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))


def term_detail(topics: DataFrame, term_links: DataFrame, links: DataFrame, returns: DataFrame, stocks: DataFrame,
                n: int = 100) -> DataFrame:
    """The newest topics per word with each linked stock and what came of it."""
    shown = term_topics(topics, term_links, n)
    named = stocks.select(F.col("id").alias("stock_id"), "stock_code", "stock_name")
    outcome = returns.select("topic_id", "stock_id", "return_20d", "max_return_20d", "rise_10pct_20d_flag")
    return (shown.join(links.select("topic_id", "stock_id"), "topic_id", "left").join(named, "stock_id", "left")
            .join(outcome, ["topic_id", "stock_id"], "left"))

"""Intake as one job: new topics, their links to stocks and words, and what came of them, published together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import PART, TableStore, bucket_part, month_part, touched_parts
from .events import METRICS, event_returns
from .ingest import import_topics
from .mining import Spelling, identified_words, keyword_matches, link_stocks, new_words

BUCKETS = 16


def run_intake(store: TableStore, incoming: DataFrame, stocks: DataFrame, aliases: DataFrame, dictionary: DataFrame,
               keywords: DataFrame, bars: DataFrame, order: str = "id", reject_attachments: bool = False,
               buckets: int = BUCKETS, spelling: Spelling | None = None) -> DataFrame:
    """Store what is new of `incoming` topics; the counts of the run, one row. `dictionary` has the raw forms of words with
    their normal forms, `keywords` is the table of words with ids. See `best_mentions` for `spelling`.

    Tables: `topics` by month, `keys` (the ids of all topics, by bucket of their hash, so that a run reads only buckets of
    ids that come in), `links` (topic_id, stock_code, confidence, mention_context), `stock_changes`, `words` (topic_id,
    keyword_id, keyword, context), `new_words`, `returns`, all of the new topics only. They become visible by one manifest: a run
    that is lost on its way leaves the state before it, and can be run again.
    """
    now = store.manifest()
    fixed = {"buckets": buckets} | now.settings  # set when the tables begin
    bucket = bucket_part(F.col("topic_id"), fixed["buckets"])
    ids = incoming.select("topic_id")
    known = store.read("keys", ids.schema, touched_parts(ids, bucket), now)
    fresh, counts = import_topics(known, incoming, order, reject_attachments)
    fresh, month = materialize(fresh), month_part(F.col("published_at"))
    spark = store.spark
    none = spark.createDataFrame([], "topic_id bigint, stock_id bigint")
    links, changes = link_stocks(fresh, stocks, aliases, none, spelling)
    links = materialize(links)
    when = fresh.select(F.col("id").alias("topic_id"), month.alias(PART))
    matches = materialize(keyword_matches(fresh, dictionary))
    added = materialize(new_words(keywords, matches.select("normalized_keyword", F.lit("manual").alias("category"))))
    words = identified_words(matches, keywords.unionByName(added), none.select("topic_id", F.col("stock_id").cast(keywords.schema["id"].dataType).alias("keyword_id")))
    dated = links.join(stocks.select(F.col("id").alias("stock_id"), "stock_code"), "stock_code")
    linked = dated.select("stock_id").distinct()  # bars of other stocks need no outcome
    returns = event_returns(fresh, dated.select("topic_id", "stock_id"), bars.join(linked, "stock_id", "left_semi"))
    at = F.lit(f"run-{now.number + 1}").alias(PART)
    counts = counts.withColumns({"links": links.agg(F.count(F.lit(1))).scalar()})
    store.publish(now, append={
        "topics": fresh.withColumn(PART, month), "keys": fresh.select("topic_id").withColumn(PART, bucket),
        "links": links.join(when, "topic_id"), "stock_changes": changes.withColumn(PART, at),
        "words": words.select("topic_id", "keyword_id", "keyword", "context").join(when, "topic_id"),
        "new_words": added.withColumn(PART, at),
        "returns": returns.select("topic_id", "stock_id", "event_date", *METRICS, "rise_10pct_flag", "rise_10pct_20d_flag").join(when, "topic_id"),
        "runs": counts.withColumn(PART, at)}, settings=fixed)
    return counts

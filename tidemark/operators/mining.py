"""Mentions of stocks, dictionary words and emphatic phrases in topics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import exchange_of
from ..functions.text import compact, snippet
from ..session import materialize
from .matching import candidates, contained_terms, found_terms

# Code pattern, link confidences, mining limits, marker of hand-made links.
CODE_PATTERN = r"(?iU)(?<!\d)(?:(?:SH|SZ)[.：:]?)?([036]\d{5})(?!\d)"
CODE_CONFIDENCE, ALIAS_CONFIDENCE, NAME_CONFIDENCE = "1.0", "0.9", "0.85"
MIN_TOPICS, MAX_TERMS, MAX_PER_TOPIC = 5, 200, 30
HAND_MADE = "人工标注"
# Short names and the code and full name they stand for.
STOCK_ALIASES = (
    ("贵州茅台", "600519", "贵州茅台"), ("卓胜微", "300782", "卓胜微"), ("唯捷创芯", "688153", "唯捷创芯"),
    ("仕佳光子", "688313", "仕佳光子"), ("仕佳", "688313", "仕佳光子"), ("长光华芯", "688048", "长光华芯"),
    ("长光", "688048", "长光华芯"), ("源杰科技", "688498", "源杰科技"), ("源杰", "688498", "源杰科技"),
    ("永鼎股份", "600105", "永鼎股份"), ("永鼎", "600105", "永鼎股份"), ("光迅科技", "002281", "光迅科技"),
    ("光迅", "002281", "光迅科技"), ("天孚通信", "300394", "天孚通信"), ("天孚", "300394", "天孚通信"),
    ("光库科技", "300620", "光库科技"), ("光库", "300620", "光库科技"), ("东田微", "301183", "东田微"),
    ("强瑞技术", "301128", "强瑞技术"), ("潍柴动力", "000338", "潍柴动力"), ("恒立液压", "601100", "恒立液压"),
    ("华丰科技", "688629", "华丰科技"), ("昌红科技", "300151", "昌红科技"), ("会稽山", "601579", "会稽山"),
    ("沃尔德", "688028", "沃尔德"), ("高澜股份", "300499", "高澜股份"), ("高澜", "300499", "高澜股份"),
)
# Seed words and the dictionary word each belongs to.
SEED_WORDS = (
    ("业绩", "业绩"), ("业绩预增", "业绩预增"), ("订单", "订单"), ("订单增长", "订单"), ("涨价", "涨价"),
    ("产品涨价", "涨价"), ("扩产", "扩产"), ("产能投放", "产能投放"), ("回购", "回购"), ("增持", "增持"),
    ("并购", "并购"), ("中标", "中标"), ("政策", "政策"), ("出口", "出口"), ("需求", "需求"), ("库存", "库存"),
    ("盈利", "盈利"), ("景气度", "景气度"), ("供给收缩", "供给收缩"),
)
# Phrases of recommendation strength and upside.
EMPHASIS_PATTERNS = (
    r"(?:继续|持续|坚定|强烈|重点|反复|核心|明确|再次|长期|积极|高度|务必)(?:看好|看多|推荐|关注|重视|配置)",
    r"(?:强推|首推|力推|必看|必配|重磅推荐)",
    r"(?:强|重点|继续|反复|明确)call",
    r"(?:大超预期|远超预期|明显超预期|超预期)",
    r"翻(?:\d+(?:\.\d+)?|[一二两三四五六七八九十几数])?倍(?:以上)?(?:空间|潜力)?",
    r"(?<![翻\d一二两三四五六七八九十几数])(?:\d+(?:\.\d+)?|[一二两三四五六七八九十几数])倍(?:以上)?(?:空间|潜力)",
    r"(?:核心|重点|首选|必选)标的",
    r"(?:买入|增持)评级",
    r"(?:上调|大幅上调)(?:评级|目标价|盈利预测)",
    r"(?:高赔率|高胜率|赔率高|胜率高)",
    r"(?:严重|明显|显著|极度)?低估",
    r"(?:高|强|巨大|极大)(?:弹性|确定性)",
    r"(?:弹性|空间)(?:巨大|极大|十足)",
    r"(?:重大突破|拐点确立|加速兑现|业绩爆发|爆发式增长|戴维斯双击)",
)


def topic_texts(topics: DataFrame) -> DataFrame:
    """(topic_id, text): title and content, joined by a blank; `topic_id` is the numeric key."""
    return topics.select(F.col("id").alias("topic_id"), F.concat(
        F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))).alias("text"))


# -- stock mentions -------------------------------------------------------------

Spelling = Callable[[Column], Column]  # from a code to how a topic spells it


def _codes(text: Column, pattern: str = CODE_PATTERN, spelling: Spelling | None = None) -> Column:
    """Array of (code, context) in the order of the text. Contexts are cut here, so the text is not repeated per hit. They lie
    around the code as it was found or, with `spelling`, around that."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("code"),
                         F.regexp_extract_all(text, F.lit(pattern), 0).alias("term"))
    return F.transform(found, lambda m: F.struct(m["code"].alias("code"), snippet(
        text, spelling(m["code"]) if spelling else m["term"]).alias("context")))


def code_mentions(topics: DataFrame, pattern: str = CODE_PATTERN) -> DataFrame:
    """Six-digit codes with an optional exchange prefix; the last spelling of a code counts."""
    texts = topic_texts(topics)
    found = texts.filter(F.col("text").rlike(pattern)).select(
        "topic_id", F.posexplode(_codes(F.col("text"), pattern)).alias("pos", "m"))
    latest = found.groupBy("topic_id", F.col("m.code").alias("stock_code")).agg(
        F.max_by("m.context", "pos").alias("context"))
    return latest.select("topic_id", "stock_code", F.lit("").alias("stock_name"),
                         F.lit(CODE_CONFIDENCE).cast("decimal(5,4)").alias("confidence"),
                         F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("position"), F.col("context").alias("mention_context"))


def _named_mentions(topics: DataFrame, names: DataFrame, confidence: str, rank: int) -> DataFrame:
    """`names`: (term, stock_code, stock_name, position)."""
    hits = contained_terms(topic_texts(topics), names)
    return hits.join(names, "term").select(
        "topic_id", "stock_code", "stock_name", F.lit(confidence).cast("decimal(5,4)").alias("confidence"),
        F.lit(rank).alias("rank"), "position", F.col("context").alias("mention_context"))


def alias_frame(spark, aliases=STOCK_ALIASES) -> DataFrame:
    return spark.createDataFrame([(a, c, n, i) for i, (a, c, n) in enumerate(aliases)],
                                 "term string, stock_code string, stock_name string, position bigint")


def alias_mentions(topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """Short names; the first alias in list order gives the context."""
    return _named_mentions(topics, aliases, ALIAS_CONFIDENCE, 2)


def catalogue_names(stocks: DataFrame) -> DataFrame:
    return stocks.filter("stock_name <> ''").select(
        F.col("stock_name").alias("term"), "stock_code", "stock_name", F.col("id").alias("position"))


def name_mentions(topics: DataFrame, stocks: DataFrame) -> DataFrame:
    """Full names of the catalogue."""
    return _named_mentions(topics, catalogue_names(stocks), NAME_CONFIDENCE, 3)


def best_mentions(topics: DataFrame, stocks: DataFrame, aliases: DataFrame, spelling: Spelling | None = None) -> DataFrame:
    """One row per (topic, code): code before alias before name. A bare code that the named
    catalogue does not know is dropped. Contexts of codes lie around the code as it was found or, with `spelling` (which may
    use `topic_id`), around that; a topic without it has its first characters. Aliases and names are one dictionary and codes are read from the same row, so
    a text is searched once; rows are reduced map-side, so a popular stock is no hot spot."""
    texts = topic_texts(topics)
    money = "decimal(5,4)"
    names = reduce(DataFrame.unionByName, [
        frame.select("term", "stock_code", "stock_name", "position").withColumns(
            {"rank": F.lit(rank), "confidence": F.lit(confidence).cast(money)})
        for frame, confidence, rank in ((aliases, ALIAS_CONFIDENCE, 2), (catalogue_names(stocks), NAME_CONFIDENCE, 3))])
    text, nothing = F.col("text"), F.lit(None).cast("string")
    named = F.transform(found_terms(text, F.coalesce("terms", F.array().cast("array<string>"))), lambda m: F.struct(
        m["term"].alias("term"), nothing.alias("code"), m["context"].alias("mention_context"), F.lit(0).alias("pos")))
    coded = F.transform(_codes(text, spelling=spelling), lambda m, i: F.struct(
        nothing.alias("term"), m["code"].alias("code"), m["context"].alias("mention_context"), i.alias("pos")))
    hits = texts.join(candidates(texts, names), "topic_id", "left").select("topic_id", F.inline(F.concat(named, coded)))
    # Of several spellings of a code the last counts.
    found = hits.join(names, "term", "left").select(
        "topic_id", F.coalesce("code", "stock_code").alias("stock_code"), F.coalesce("rank", F.lit(1)).alias("rank"),
        F.coalesce("position", -F.col("pos").cast("bigint")).alias("position"), F.coalesce("stock_name", F.lit("")).alias("stock_name"),
        F.coalesce("confidence", F.lit(CODE_CONFIDENCE).cast(money)).alias("confidence"), "mention_context")
    fields = ("rank", "position", "stock_name", "confidence", "mention_context")
    best = found.groupBy("topic_id", "stock_code").agg(F.min(F.struct(*fields)).alias("m")).select(
        "topic_id", "stock_code", "m.*")
    known = stocks.select("stock_code", F.lit(True).alias("_known")).distinct()
    return (best.join(known, "stock_code", "left")
            .filter(F.col("_known").isNotNull() | (F.col("stock_name") != "")).drop("_known", "rank", "position"))


def link_stocks(topics: DataFrame, stocks: DataFrame, aliases: DataFrame, links: DataFrame,
                spelling: Spelling | None = None) -> tuple[DataFrame, DataFrame]:
    """(new links, stocks to add or name). Links carry the stock code; links that exist are not repeated. See `best_mentions`
    for `spelling`."""
    best = best_mentions(topics, stocks, aliases, spelling)
    have = links.join(stocks.select(F.col("id").alias("stock_id"), "stock_code"), "stock_id").select(
        "topic_id", "stock_code")
    fresh = best.join(have, ["topic_id", "stock_code"], "left_anti")
    named = best.filter("stock_name <> ''").groupBy("stock_code").agg(F.min("stock_name").alias("stock_name"))
    old = stocks.select("stock_code", F.col("stock_name").alias("_old"))
    changes = (named.join(old, "stock_code", "left").filter("_old IS NULL OR _old = ''")
               .select("stock_code", "stock_name", exchange_of(F.col("stock_code")).alias("exchange"),
                       F.when(F.col("_old").isNull(), "created").otherwise("named").alias("change")))
    return fresh.select("topic_id", "stock_code", "confidence", "mention_context"), changes


def reanalyze(topics: DataFrame, stocks: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of a full re-analysis that only adds links; one row."""
    fresh, _ = link_stocks(topics, stocks, aliases, links)
    totals = fresh.agg(F.count(F.lit(1)).alias("links_added"))
    return (totals.withColumn("topics", topics.agg(F.count(F.lit(1)).alias("n")).scalar())
            .withColumn("stock_master", stocks.filter("stock_name <> ''").agg(F.count(F.lit(1)).alias("n")).scalar()))


# -- dictionary words -----------------------------------------------------------

def keyword_matches(topics: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row per (topic, normalised word) of the active hand-kept dictionary, with the
    context of the first raw form in dictionary order (`position`)."""
    active = keywords.filter("category <> 'auto' AND active AND NOT deleted")
    raw = active.select(F.col("keyword").alias("term"), "normalized_keyword", "position")
    hits = contained_terms(topic_texts(topics), raw).join(raw, "term")
    first = F.min(F.struct("position", "term", "context"))
    return hits.groupBy("topic_id", "normalized_keyword").agg(first.alias("m")).select(
        "topic_id", "normalized_keyword", F.col("m.term").alias("keyword"), "m.context")


def new_words(keywords: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows for normal forms that the table lacks. `wanted`: (normalized_keyword, category). Numeric ids go on behind the
    greatest in the order of the words, other ids are the word itself. There are no more of them than dictionary words or
    mined phrases, so they are numbered in one place."""
    lacking = (wanted.groupBy("normalized_keyword").agg(F.min("category").alias("category"))
               .join(keywords.select("normalized_keyword"), "normalized_keyword", "left_anti"))
    kind, word = keywords.schema["id"].dataType.simpleString(), F.col("normalized_keyword")
    number = word if kind == "string" else (keywords.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).scalar()
                                            + F.row_number().over(Window.orderBy("normalized_keyword")))
    values = {"id": number, "keyword": word, "normalized_keyword": word, "category": F.col("category"),
              "active": F.lit(True), "deleted": F.lit(False)}
    return lacking.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in keywords.schema])


def link_keywords(topics: DataFrame, keywords: DataFrame, links: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """New (topic, word) links; `links` has (topic_id, keyword_id). Ids are those of `table`, the dictionary itself unless
    given; see `new_words` for forms that it lacks."""
    return identified_words(keyword_matches(topics, keywords), keywords if table is None else table, links)


def identified_words(matches: DataFrame, table: DataFrame, links: DataFrame) -> DataFrame:
    ids = table.groupBy("normalized_keyword").agg(F.min("id").alias("keyword_id"))
    found = matches.join(ids, "normalized_keyword", "left")
    return found.join(links.select("topic_id", "keyword_id"), ["topic_id", "keyword_id"], "left_anti")


# -- emphasis phrases -----------------------------------------------------------

def emphasis_terms(topics: DataFrame, patterns=EMPHASIS_PATTERNS, contexts: bool = False) -> DataFrame:
    """(topic_id, term), distinct per topic; with `contexts` also what stands around the term, cut while the text is at
    hand."""
    texts = topic_texts(topics).withColumn("small", compact(F.col("text")))
    found = F.flatten(F.array(*[F.regexp_extract_all("small", F.lit(f"(?U){p}"), 0) for p in patterns]))
    if not contexts:
        return texts.select("topic_id", F.explode(F.array_distinct(found)).alias("term"))
    return texts.select("topic_id", F.inline(F.transform(F.array_distinct(found), lambda t: F.struct(
        t.alias("term"), snippet(F.col("text"), t).alias("context")))))


def eligible_terms(terms: DataFrame, min_topics: int = MIN_TOPICS, max_terms: int = MAX_TERMS) -> DataFrame:
    """The most frequent phrases (a stated top list), ties by phrase."""
    return (terms.groupBy("term").agg(F.count(F.lit(1)).alias("topics")).filter(F.col("topics") >= min_topics)
            .orderBy(F.desc("topics"), "term").limit(max_terms))


def drop_mined(keywords: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove links of mined words unless hand-made, then mined words left without a link."""
    mined = keywords.filter("category = 'auto'").select(F.col("id").alias("keyword_id"))
    generated = links.filter(F.col("context") != HAND_MADE).join(mined, "keyword_id", "left_semi")
    kept = links.join(generated.select("topic_id", "keyword_id"), ["topic_id", "keyword_id"], "left_anti")
    return drop_orphans(keywords, kept), kept


def drop_orphans(keywords: DataFrame, links: DataFrame) -> DataFrame:
    used = links.select(F.col("keyword_id").alias("id"))
    return keywords.filter("category <> 'auto'").unionByName(
        keywords.filter("category = 'auto'").join(used, "id", "left_semi"))


def discover_terms(topics: DataFrame, keywords: DataFrame, links: DataFrame, patterns=EMPHASIS_PATTERNS,
                   min_topics: int = MIN_TOPICS, max_terms: int = MAX_TERMS,
                   max_per_topic: int = MAX_PER_TOPIC) -> DataFrame:
    """Links of recurring phrases: (topic_id, term, topics, context)."""
    return discovery(topics, keywords, links, patterns, min_topics, max_terms, max_per_topic)[0]


def discovery(topics: DataFrame, keywords: DataFrame, links: DataFrame, patterns=EMPHASIS_PATTERNS,
              min_topics: int = MIN_TOPICS, max_terms: int = MAX_TERMS, max_per_topic: int = MAX_PER_TOPIC
              ) -> tuple[DataFrame, DataFrame]:
    """(links of recurring phrases, the phrases that were frequent enough).

    The regex pass over the texts is the expensive part and its output small, so its result, contexts included, is
    checkpointed and read for both the frequencies and the links: texts are scanned once and never shuffled.
    """
    kept_words, kept_links = drop_mined(keywords, links)
    terms = materialize(emphasis_terms(topics, patterns, contexts=True))
    eligible = materialize(eligible_terms(terms, min_topics, max_terms))
    w = Window.partitionBy("topic_id").orderBy(F.desc("topics"), "term")
    ranked = terms.join(eligible, "term").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_per_topic)
    taken = kept_words.filter("category <> 'auto'").select(F.col("normalized_keyword").alias("term"))
    words = kept_words.select(F.col("normalized_keyword").alias("term"), F.col("id").alias("keyword_id"))
    existing = kept_links.join(words, "keyword_id").select("topic_id", "term")
    fresh = ranked.join(taken, "term", "left_anti").join(existing, ["topic_id", "term"], "left_anti")
    return fresh.select("topic_id", "term", "topics", "context"), eligible


def discovered_words(keywords: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """The mined words of a discovery run that the dictionary does not have yet, with ids of their own."""
    kept_words, _ = drop_mined(keywords, links)
    return new_words(kept_words, found.select(F.col("term").alias("normalized_keyword"), F.lit("auto").alias("category")))


def discovery_summary(topics: DataFrame, keywords: DataFrame, links: DataFrame, found: DataFrame,
                      eligible: DataFrame | None = None) -> DataFrame:
    """Counts of a discovery run; one row, with `candidate_keywords` if the `eligible` phrases are given."""
    kept_words, kept_links = drop_mined(keywords, links)
    known = kept_words.select(F.col("normalized_keyword").alias("term"))
    count = F.count(F.lit(1)).alias("n")
    out = (found.agg(count.alias("links_added"))
           .withColumn("topics_scanned", topics.agg(count).scalar())
           .withColumn("new_keywords", found.select("term").distinct().join(known, "term", "left_anti").agg(count).scalar())
           .withColumn("stale_links_removed", links.agg(count).scalar() - kept_links.agg(count).scalar()))
    return out if eligible is None else out.withColumn("candidate_keywords", eligible.agg(count).scalar())


# -- manual work ----------------------------------------------------------------

def apply_annotations(links: DataFrame, words: DataFrame, returns: DataFrame, annotations: DataFrame
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace all links of annotated topics and drop their returns.

    `annotations`: (topic_id, stocks array<struct<stock_code, context, confidence>>, keywords array<string>).
    Links carry `stock_code`, words `keyword`.
    """
    done = annotations.select("topic_id")
    stocks = annotations.select("topic_id", F.inline("stocks")).select(
        "topic_id", "stock_code", F.col("context").alias("mention_context"),
        F.col("confidence").cast("decimal(5,4)").alias("confidence"))
    terms = F.array_distinct(F.filter(F.transform("keywords", lambda k: F.trim(k)), lambda k: k != ""))
    marked = annotations.select("topic_id", F.explode(terms).alias("keyword")).withColumn("context", F.lit(HAND_MADE))
    return (links.join(done, "topic_id", "left_anti").select("topic_id", "stock_code", "mention_context", "confidence")
            .unionByName(stocks),
            words.join(done, "topic_id", "left_anti").select("topic_id", "keyword", "context").unionByName(marked),
            returns.join(done, "topic_id", "left_anti"))

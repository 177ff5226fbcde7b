"""Event study, its joins and the word statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.times import first_event_date
from ..operators import bars as B
from ..operators import events as E
from ..operators import stats as S
from ..session import shared_dir
from .fixtures import Tables, duck
from .registry import query

RETURNS = [f"return_{n}d" for n in B.HORIZONS]
MAXES = [f"max_return_{n}d" for n in B.MAX_HORIZONS]


def doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def r6(a: str, b: str) -> str:
    """a/b - 1 to 6 places, half away from zero, in exact integer arithmetic."""
    return (f"(CASE WHEN {b} <> 0 THEN CAST(SIGN({a}-{b}) AS DOUBLE) * CAST((2*ABS({a}-{b})*1000000 + {b}) // (2*{b}) "
            f"AS DOUBLE) / 1000000 + 0.0 END)")


MICRO = """m AS (SELECT *, CAST(close * 1000000 AS HUGEINT) AS px FROM f_bars WHERE adjust_type = 'qfq'),
k AS (SELECT *, """ + ", ".join(
    [f"LEAD(px, {n}) OVER w AS p{n}" for n in B.HORIZONS]
    + [f"CASE WHEN COUNT(*) OVER (PARTITION BY stock_id ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) = {n} "
       f"THEN MAX(px) OVER (PARTITION BY stock_id ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) END AS x{n}"
       for n in B.MAX_HORIZONS]) + """ FROM m WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date)),
r AS (SELECT stock_id, trade_date, close, p1 IS NOT NULL AS has_next, """ + ", ".join(
    [f"{r6(f'p{n}', 'px')} AS return_{n}d" for n in B.HORIZONS]
    + [f"{r6(f'x{n}', 'px')} AS max_return_{n}d" for n in B.MAX_HORIZONS]
    + [f"COALESCE(x{n} * 10 >= px * 11 AND px <> 0, FALSE) AS rise_{n}d" for n in B.MAX_HORIZONS]) + " FROM k)"

START = """s AS (SELECT id AS topic_id, CAST(published_at + INTERVAL 8 HOUR + INTERVAL 9 HOUR AS DATE) AS start_date FROM f_topics)"""
EVENTS = MICRO + ",\n" + START + """,
er AS (SELECT l.topic_id, l.stock_id, r.trade_date AS event_date, """ + ", ".join(
    f"r.{c}" for c in [*RETURNS, *MAXES]) + """, r.rise_5d AS rise_10pct_flag, r.rise_20d AS rise_10pct_20d_flag
  FROM (SELECT l.topic_id, l.stock_id, s.start_date FROM f_mentions l JOIN s USING (topic_id)) l
  ASOF JOIN r ON l.stock_id = r.stock_id AND l.start_date <= r.trade_date
  WHERE r.has_next)"""
EV = ("bars", "topics", "mentions")


def _returns(t: Tables):
    return E.event_returns(t.topics, t.mentions, t.bars)


@query("f13_first_event_date", """
SELECT event_id, CAST(ts + INTERVAL 8 HOUR + INTERVAL 9 HOUR AS DATE) AS start_date FROM events""")
def _(t):
    return t.raw("events").select("event_id", first_event_date(F.col("ts")).alias("start_date"))


@query("e1_forward_returns", duck(f"WITH {MICRO} SELECT stock_id, trade_date, {', '.join(RETURNS)} FROM r", "bars"))
def _(t):
    return doubles(B.forward_returns(t.bars).select("stock_id", "trade_date", *RETURNS), *RETURNS)


@query("e2_max_forward_return", duck(f"WITH {MICRO} SELECT stock_id, trade_date, {', '.join(MAXES)} FROM r", "bars"))
def _(t):
    return doubles(B.max_forward_return(t.bars).select("stock_id", "trade_date", *MAXES), *MAXES)


@query("e3_rise_flags", duck(f"WITH {MICRO} SELECT stock_id, trade_date, rise_5d, rise_20d FROM r", "bars"))
def _(t):
    return B.max_forward_return(t.bars).select("stock_id", "trade_date", "rise_5d", "rise_20d")


@query("j1_forward_asof", duck(f"""WITH {START}
SELECT l.topic_id, l.stock_id, l.start_date, b.trade_date, CAST(b.close AS DOUBLE) AS close
FROM (SELECT l.topic_id, l.stock_id, s.start_date FROM f_mentions l JOIN s USING (topic_id)) l
ASOF JOIN f_bars b ON l.stock_id = b.stock_id AND l.start_date <= b.trade_date""", *EV))
def _(t):
    return doubles(E.forward_asof(t.topics, t.mentions, t.bars, ["close"]).select(
        "topic_id", "stock_id", "start_date", "trade_date", "close"), "close")


@query("e4_event_returns", duck(f"WITH {EVENTS} SELECT * FROM er", *EV))
def _(t):
    return doubles(_returns(t), *RETURNS, *MAXES)


@query("e4_rebuild_summary", duck(f"""WITH {EVENTS}
SELECT COUNT(*) AS event_returns, COUNT(max_return_20d) AS complete_20d,
       CAST(SUM(CASE WHEN rise_10pct_20d_flag THEN 1 ELSE 0 END) AS BIGINT) AS risen_20d FROM er""", *EV))
def _(t):
    return _returns(t).agg(F.count(F.lit(1)).alias("event_returns"), F.count("max_return_20d").alias("complete_20d"),
                           F.count_if("rise_10pct_20d_flag").alias("risen_20d"))


@query("j2_inner_four_way", duck(f"""WITH {EVENTS}
SELECT k.keyword, s.stock_code, e.event_date, COUNT(*) AS n
FROM er e JOIN f_topic_words w ON w.topic_id = e.topic_id JOIN f_words k ON k.id = w.keyword
JOIN f_stocks s ON s.id = e.stock_id JOIN f_topics t ON t.id = e.topic_id
GROUP BY ALL""", *EV, "topic_words", "words", "stocks"))
def _(t):
    named = t.words.select(F.col("id").alias("keyword_id"), "keyword")
    codes = t.stocks.select(F.col("id").alias("stock_id"), "stock_code")
    return (_returns(t).select("topic_id", "stock_id", "event_date").join(t.topic_words, "topic_id")
            .groupBy("keyword_id", "stock_id", "event_date").agg(F.count(F.lit(1)).alias("n"))
            .join(named, "keyword_id").join(codes, "stock_id")
            .groupBy("keyword", "stock_code", "event_date").agg(F.sum("n").alias("n")))


def _stats_sql(keep: str = "TRUE", words: str = "TRUE") -> str:
    return f"""WITH {EVENTS},
x AS (SELECT w.keyword AS kid, e.* FROM er e JOIN f_topic_words w ON w.topic_id = e.topic_id
      JOIN f_stocks s ON s.id = e.stock_id WHERE {keep}),
g AS (SELECT kid, COUNT(DISTINCT topic_id) AS topic_count, COUNT(DISTINCT stock_id) AS stock_count,
  SUM(CASE WHEN max_return_5d IS NOT NULL THEN CAST(return_5d AS DECIMAL(18,6)) END) / COUNT(CASE WHEN max_return_5d IS NOT NULL THEN return_5d END) AS avg_return_5d,
  AVG(CASE WHEN max_return_5d IS NOT NULL THEN CAST(rise_10pct_flag AS INT) END) AS rise_rate_10pct,
  SUM(CASE WHEN max_return_20d IS NOT NULL THEN CAST(return_20d AS DECIMAL(18,6)) END) / COUNT(CASE WHEN max_return_20d IS NOT NULL THEN return_20d END) AS avg_return_20d,
  AVG(CASE WHEN max_return_20d IS NOT NULL THEN CAST(rise_10pct_20d_flag AS INT) END) AS rise_rate_10pct_20d,
  COUNT(max_return_20d) AS eligible_count_20d FROM x GROUP BY kid)
SELECT k.keyword, COALESCE(topic_count, 0) AS topic_count, COALESCE(stock_count, 0) AS stock_count,
  ROUND(CAST(avg_return_5d AS DOUBLE), 6) AS avg_return_5d, ROUND(rise_rate_10pct, 9) AS rise_rate_10pct,
  ROUND(CAST(avg_return_20d AS DOUBLE), 6) AS avg_return_20d, ROUND(rise_rate_10pct_20d, 9) AS rise_rate_10pct_20d,
  COALESCE(eligible_count_20d, 0) AS eligible_count_20d, COALESCE(eligible_count_20d, 0) >= 10 AS sample_sufficient,
  ROW_NUMBER() OVER (ORDER BY COALESCE(eligible_count_20d, 0) >= 10 DESC, COALESCE(NULLIF(rise_rate_10pct_20d, 0), -1) DESC, k.normalized_keyword) AS place
FROM f_words k LEFT JOIN g ON g.kid = k.id
WHERE k.category <> 'auto' AND NOT k.deleted AND k.active AND {words}"""


STATS = (*EV, "topic_words", "words", "stocks")


def _placed(stats, order):
    """The ranked list with its place; one row per dictionary word, so few rows."""
    from pyspark.sql import Window
    return stats.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def _stats_view(stats):
    rate = F.coalesce(F.nullif(F.col("rise_rate_10pct_20d"), F.lit(0.0)), F.lit(-1.0))
    placed = _placed(stats, (F.desc("sample_sufficient"), rate.desc(), "normalized_keyword"))
    return placed.withColumns({"avg_return_5d": F.round("avg_return_5d", 6), "avg_return_20d": F.round("avg_return_20d", 6),
                               "rise_rate_10pct": F.round("rise_rate_10pct", 9),
                               "rise_rate_10pct_20d": F.round("rise_rate_10pct_20d", 9)}).select(*S.CSV_COLUMNS, "place")


@query("a1_keyword_stats", duck(_stats_sql(), *STATS))
def _(t):
    return _stats_view(S.keyword_stats(t.words, t.topic_words, _returns(t), t.stocks))


@query("a1_keyword_stats_filtered", duck(_stats_sql(
    "s.stock_code LIKE '600006' AND e.event_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'",
    "(LOWER(k.keyword) LIKE '%l%')"), *STATS))
def _(t):
    return _stats_view(S.keyword_stats(t.words, t.topic_words, _returns(t), t.stocks, needle="L",
                                       stock_code="600006", start="1994-01-01", end="1996-12-31"))


@query("a3_baseline_rate", duck(f"""WITH {EVENTS}
SELECT ROUND(AVG(CAST(rise_10pct_20d_flag AS INT)), 9) AS baseline_rise_rate_10pct_20d FROM er WHERE max_return_20d IS NOT NULL""", *EV))
def _(t):
    rate = "baseline_rise_rate_10pct_20d"
    return S.baseline_rate(_returns(t)).withColumn(rate, F.round(rate, 9))


def _auto(t: Tables):
    """Every word taken as mined, so that the term statistics run over all links."""
    return t.words.withColumn("category", F.lit("auto"))


OUT = """o AS (SELECT w.keyword AS kid, e.* FROM er e JOIN f_topic_words w ON w.topic_id = e.topic_id JOIN f_words k ON k.id = w.keyword
      WHERE e.max_return_20d IS NOT NULL),
ps AS (SELECT kid, stock_id, AVG(CAST(rise_10pct_20d_flag AS INT)) AS rate FROM o GROUP BY 1, 2)"""


@query("a4_dedup_rate", duck(f"""WITH {EVENTS}, {OUT}
SELECT kid AS keyword_id, ROUND(AVG(rate), 9) AS dedup_stock_rise_rate_20d, COUNT(*) AS dedup_stock_count FROM ps GROUP BY 1""",
                             *STATS))
def _(t):
    terms = _auto(t).select(F.col("id").alias("keyword_id"))
    rate = "dedup_stock_rise_rate_20d"
    return S.dedup_rate(S._term_outcomes(terms, t.topic_words, _returns(t))).withColumn(rate, F.round(rate, 9))


SEEN = """occ AS (SELECT w.keyword AS kid, m.topic_id, m.stock_id, s.stock_code, s.stock_name
  FROM f_mentions m JOIN f_topic_words w ON w.topic_id = m.topic_id JOIN f_words k ON k.id = w.keyword JOIN f_stocks s ON s.id = m.stock_id),
rep AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kid ORDER BY topics DESC, stock_code, stock_id) AS rank
  FROM (SELECT kid, stock_id, stock_code, stock_name, COUNT(*) AS topics FROM occ GROUP BY ALL) q)"""


@query("a5_representatives", duck(f"""WITH {SEEN}
SELECT kid AS keyword_id, rank, stock_code, stock_name, topics FROM rep WHERE rank <= 3""",
                                  "mentions", "topic_words", "words", "stocks"))
def _(t):
    terms = _auto(t).select(F.col("id").alias("keyword_id"))
    seen = S.term_occurrences(terms, t.topic_words, t.mentions, t.stocks)
    return S.representatives(seen).select("keyword_id", F.col("rank").cast("bigint").alias("rank"), "stock_code",
                                          "stock_name", "topics")


@query("a2_term_stats", duck(f"""WITH {EVENTS}, {OUT}, {SEEN},
c AS (SELECT kid, COUNT(DISTINCT topic_id) AS topic_count, COUNT(DISTINCT stock_id) AS stock_count FROM occ GROUP BY 1),
f AS (SELECT kid, COUNT(*) AS n, CAST(SUM(CAST(rise_10pct_20d_flag AS INT)) AS BIGINT) AS hits,
   AVG(CAST(rise_10pct_20d_flag AS INT)) AS rate, CAST(SUM(CAST(return_20d AS DECIMAL(18,6))) AS DOUBLE) / COUNT(return_20d) AS avg_ret,
   MAX(max_return_20d) AS best, MIN(max_return_20d) AS worst FROM o GROUP BY 1),
d AS (SELECT kid, AVG(rate) AS dedup, COUNT(*) AS n FROM ps GROUP BY 1),
b AS (SELECT AVG(CAST(rise_10pct_20d_flag AS INT)) AS base FROM er WHERE max_return_20d IS NOT NULL),
t AS (SELECT kid, STRING_AGG(stock_code || ':' || stock_name || ':' || CAST(topics AS VARCHAR), ',' ORDER BY rank) AS reps FROM rep WHERE rank <= 3 GROUP BY 1)
SELECT k.keyword, COALESCE(c.topic_count, 0) AS topic_count, COALESCE(c.stock_count, 0) AS stock_count,
  COALESCE(f.n, 0) AS eligible_count_20d, COALESCE(f.hits, 0) AS success_count_20d, ROUND(f.rate, 9) AS rise_rate_10pct_20d,
  ROUND(f.avg_ret, 9) AS avg_return_20d, f.best AS max_return_20d, f.worst AS min_return_20d,
  ROUND(b.base, 9) AS baseline_rise_rate_10pct_20d, ROUND(f.rate - b.base, 9) AS uplift_vs_baseline,
  ROUND(d.dedup, 9) AS dedup_stock_rise_rate_20d, COALESCE(d.n, 0) AS dedup_stock_count, t.reps AS representative_stocks,
  COALESCE(f.n, 0) >= 5000 AS sample_sufficient,
  ROW_NUMBER() OVER (ORDER BY COALESCE(f.n, 0) >= 5000 DESC, COALESCE(f.rate - b.base, -1) DESC, COALESCE(f.rate, -1) DESC, COALESCE(f.n, 0) DESC, k.normalized_keyword) AS place
FROM f_words k LEFT JOIN c ON c.kid = k.id LEFT JOIN f ON f.kid = k.id LEFT JOIN d ON d.kid = k.id LEFT JOIN t ON t.kid = k.id CROSS JOIN b""",
                             *STATS))
def _(t):
    stats = S.term_stats(_auto(t), t.topic_words, t.mentions, _returns(t), t.stocks, min_samples=5000)
    last = F.lit(-1.0)
    placed = _placed(stats, (F.desc("sample_sufficient"), F.coalesce("uplift_vs_baseline", last).desc(),
                             F.coalesce("rise_rate_10pct_20d", last).desc(), F.desc("eligible_count_20d"),
                             "normalized_keyword"))
    rounded = ("rise_rate_10pct_20d", "avg_return_20d", "baseline_rise_rate_10pct_20d", "uplift_vs_baseline",
               "dedup_stock_rise_rate_20d")
    text = F.transform("representative_stocks", lambda s: F.concat_ws(
        ":", s["stock_code"], s["stock_name"], s["topics"].cast("string")))
    return (placed.withColumns({c: F.round(c, 9) for c in rounded})
            .withColumn("representative_stocks", F.array_join(text, ","))
            .drop("keyword_id", "normalized_keyword"))


@query("a8_keyword_topic_counts", duck("""
SELECT k.keyword, k.active, COUNT(DISTINCT w.topic_id) AS topic_count
FROM f_words k LEFT JOIN f_topic_words w ON w.keyword = k.id WHERE k.category <> 'auto' AND NOT k.deleted GROUP BY 1, 2""",
                                       "topic_words", "words"))
def _(t):
    return S.keyword_topic_counts(t.words, t.topic_words).select("keyword", "active", "topic_count")


@query("a8_keyword_list", duck("""
SELECT k.keyword, ROW_NUMBER() OVER (ORDER BY k.active DESC, k.keyword) AS place FROM f_words k WHERE k.category <> 'auto' AND NOT k.deleted""", "words"))
def _(t):
    return _placed(S.keyword_topic_counts(t.words, t.topic_words), tuple(S.by_activity())).select("keyword", "place")


@query("s13_keyword_csv", duck(f"SELECT * EXCLUDE (place) FROM ({_stats_sql()}) q", *STATS))
def _(t):
    """Exported to the shared folder and read back."""
    stats = S.keyword_stats(t.words, t.topic_words, _returns(t), t.stocks)
    digits = {"avg_return_5d": 6, "avg_return_20d": 6, "rise_rate_10pct": 9, "rise_rate_10pct_20d": 9}
    back = S.write_keyword_csv(stats, f"{shared_dir(t.spark)}/tidemark-{uuid.uuid4().hex}")
    return back.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("j3_left_outer_empty_groups", duck(f"""WITH {EVENTS}
SELECT k.keyword, COUNT(e.topic_id) AS events FROM f_words k LEFT JOIN f_topic_words w ON w.keyword = k.id AND k.keyword NOT LIKE 'c%'
LEFT JOIN er e ON e.topic_id = w.topic_id GROUP BY 1""", *EV, "topic_words", "words"))
def _(t):
    linked = t.topic_words.filter(~F.col("keyword_id").startswith("c"))
    per_topic = _returns(t).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    events = linked.join(per_topic, "topic_id").groupBy("keyword_id").agg(F.sum("n").alias("events"))
    return (t.words.select(F.col("id").alias("keyword_id"), "keyword").join(events, "keyword_id", "left")
            .select("keyword", F.coalesce("events", F.lit(0)).alias("events")))


@query("a9_mentioned_codes", duck("""
SELECT DISTINCT s.stock_code FROM f_stocks s WHERE s.id IN (SELECT stock_id FROM f_mentions)""",
                                  "stocks", "mentions"))
def _(t):
    return S.mentioned_codes(t.stocks, t.mentions)


@query("f15_filter_keywords", duck("""
SELECT keyword, active FROM f_words WHERE category <> 'auto' AND NOT deleted
AND (LOWER(keyword) LIKE '%r%' OR LOWER(normalized_keyword) LIKE '%r%')""", "words"))
def _(t):
    return S.filter_keywords(t.words, "R", include_inactive=True).select("keyword", "active")

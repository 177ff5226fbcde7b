"""Tables of the data model derived from the generic star schema.

`Tables` builds them with Spark; `duck(...)` gives the same tables as common table
expressions for the independent SQL of each query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import exchange_of
from ..session import prepare

BARS = """
WITH d AS (
  SELECT l_suppkey AS stock_id, CAST(l_shipdate AS DATE) AS trade_date,
         SUM(CAST(l_discount AS DECIMAL(6,2)) - CAST(0.05 AS DECIMAL(6,2))) * 150 AS mv,
         MAX(CAST(l_tax AS DECIMAL(6,2))) AS tx,
         SUM(CAST(l_quantity AS DECIMAL(12,2))) AS volume,
         SUM(CAST(l_extendedprice AS DECIMAL(14,2))) AS amount
  FROM {lineitem} GROUP BY 1, 2),
c AS (
  SELECT *, CAST(500 + (tx - CAST(0.04 AS DECIMAL(6,2))) * 800
         + SUM(mv) OVER (PARTITION BY stock_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,6)) AS close FROM d),
o AS (
  SELECT *, COALESCE(LAG(close) OVER (PARTITION BY stock_id ORDER BY trade_date), CAST(500 AS DECIMAL(18,6))) AS open FROM c)
SELECT stock_id, trade_date, open,
       CAST(GREATEST(open, close) + tx * 10 AS DECIMAL(18,6)) AS high,
       CAST(LEAST(open, close) - tx * 10 AS DECIMAL(18,6)) AS low, close,
       CAST(volume AS DECIMAL(24,4)) AS volume, CAST(amount AS DECIMAL(24,4)) AS amount,
       CAST(volume * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(12,6)) AS turnover_rate, 'qfq' AS adjust_type
FROM o"""

STOCKS = """
SELECT s_suppkey AS id,
  CASE WHEN s_suppkey < 500 AND s_suppkey % 50 = 49 THEN '68900' || CAST(CAST(FLOOR(s_suppkey / 50.0) AS INT) AS STRING)
       ELSE (CASE s_suppkey % 6 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300'
                                WHEN 3 THEN '688' WHEN 4 THEN '430' ELSE '920' END)
            || LPAD(CAST(s_suppkey % 1000 AS STRING), 3, '0') END AS stock_code,
  CASE WHEN s_suppkey % 25 = 5 THEN '' WHEN s_suppkey % 20 = 3 THEN '*ST' || s_name
       WHEN s_suppkey % 20 = 7 THEN 'sT' || s_name WHEN s_suppkey % 20 = 11 THEN s_name || '退市'
       ELSE s_name END AS stock_name
FROM {supplier}"""

TOPICS = """
SELECT o_orderkey AS id, 'o' || CAST(o_orderkey AS STRING) AS topic_id, o_orderpriority AS title,
       o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS published_at
FROM {orders}"""

MENTIONS = "SELECT DISTINCT l_orderkey AS topic_id, l_suppkey AS stock_id FROM {lineitem}"

TOPIC_WORDS = """
SELECT DISTINCT l_orderkey AS topic_id, w.word AS keyword
FROM {lineitem} JOIN (SELECT p_partkey, SPLIT_PART(p_name, ' ', 1) AS word FROM {part}
      UNION ALL SELECT p_partkey, SPLIT_PART(p_name, ' ', 2) AS word FROM {part}) w ON l_partkey = w.p_partkey"""

# A dictionary of the words: those on `b` are mined, those on `h` switched off,
# those on `t` deleted by the user.
WORDS = """
SELECT word AS id, word AS keyword, word AS normalized_keyword,
       CASE WHEN word LIKE 'b%' THEN 'auto' ELSE 'manual' END AS category,
       word NOT LIKE 'h%' AS active, word LIKE 't%' AS deleted
FROM (SELECT DISTINCT SPLIT_PART(p_name, ' ', 1) AS word FROM {part}
      UNION SELECT DISTINCT SPLIT_PART(p_name, ' ', 2) AS word FROM {part}) u WHERE word <> ''"""

DOCS = """
SELECT doc_id AS id, 'd' || CAST(doc_id AS STRING) AS topic_id, '' AS title, text AS content, source AS author,
       TIMESTAMP '1995-03-01 00:00:00' + (doc_id % 2000) * INTERVAL '1' DAY + (doc_id % 24) * INTERVAL '1' HOUR AS published_at
FROM {documents}"""

GRID = "SELECT DISTINCT user_id AS stock_id, CAST(ts AS DATE) AS trade_date FROM {events}"

# Named stocks of the grid users; every eleventh name is excluded, and one stock
# above the largest user has no bars at all.
GRID_STOCKS = """
SELECT stock_id AS id, '600' || LPAD(CAST(stock_id AS STRING), 6, '0') AS stock_code,
       CASE WHEN stock_id % 11 = 4 THEN '*ST u' || CAST(stock_id AS STRING) ELSE 'u' || CAST(stock_id AS STRING) END AS stock_name
FROM (SELECT DISTINCT user_id AS stock_id FROM {events} UNION ALL SELECT MAX(user_id) + 1 AS stock_id FROM {events}) g"""

# Documents with stock codes in several spellings (and a run that is too long).
POSTS = """
SELECT id, topic_id, title, author, published_at, content || CASE id % 3
   WHEN 0 THEN ' SH600' || LPAD(CAST(id % 1000 AS STRING), 3, '0')
   WHEN 1 THEN ' ref 3007' || LPAD(CAST(id % 100 AS STRING), 2, '0') || ',600' || LPAD(CAST(id % 100 AS STRING), 3, '0')
   ELSE ' 1600123' || CAST(id % 10 AS STRING) END AS content
FROM {docs}"""

# A catalogue whose names occur in the documents; some names are blank.
CATALOG = """
SELECT item_id AS id, '600' || LPAD(CAST(item_id AS STRING), 3, '0') AS stock_code,
  CASE WHEN item_id % 9 = 4 THEN '' ELSE SPLIT_PART(text, ' ', 1) || ' ' || SPLIT_PART(text, ' ', 2) END AS stock_name
FROM {benchmark}"""

# Single words of the benchmark as names: a dictionary that grows with the data.
LONG_NAMES = """
SELECT MIN(item_id) AS id, '000' || LPAD(CAST(MIN(item_id) AS STRING), 3, '0') AS stock_code, word AS stock_name
FROM {benchmark_words} WHERE LENGTH(word) >= 7 GROUP BY word"""

ALIASES = """
SELECT word AS term, '688' || LPAD(CAST(position * 7 AS STRING), 3, '0') AS stock_code, UPPER(word) AS stock_name, position
FROM (SELECT word, ROW_NUMBER() OVER (ORDER BY word) AS position FROM (
  SELECT DISTINCT SPLIT_PART(p_name, ' ', 2) AS word FROM {part}) d) r WHERE word <> ''"""

# Raw forms that share a dictionary word: the first letter.
DICTIONARY = """
SELECT id, keyword, SUBSTR(keyword, 1, 1) AS normalized_keyword, category, active, deleted, keyword AS position FROM {words}"""

DUCK = {
    "bars": BARS, "stocks": STOCKS, "topics": TOPICS, "mentions": MENTIONS, "topic_words": TOPIC_WORDS,
    "words": WORDS, "docs": DOCS, "grid": GRID, "grid_stocks": GRID_STOCKS,
    "doc_links": """
SELECT DISTINCT d.doc_id AS topic_id, (d.doc_id * m.k + m.c) % n.n AS stock_id
FROM {documents} d CROSS JOIN (SELECT 1 AS k, 0 AS c UNION ALL SELECT 7 AS k, 3 AS c) m
CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) n""",
    "grid_source": """
SELECT u.stock_id, c.trade_date FROM (SELECT DISTINCT user_id AS stock_id FROM {events}) u
CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM {events}) c
WHERE (u.stock_id + DAY(c.trade_date)) % 3 <> 0""",
    "posts": POSTS, "catalog": CATALOG, "long_names": LONG_NAMES, "aliases": ALIASES, "dictionary": DICTIONARY,
    "benchmark_words": "SELECT item_id, UNNEST(STRING_SPLIT(text, ' ')) AS word FROM benchmark",
    "calendar": "SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM {events}",
}
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(body: str, *names: str, recursive: bool = False) -> str:
    """`body` behind the named derived tables (`f_bars`, ...)."""
    raw = {name: name for name in RAW}
    raw.update({name: f"f_{name}" for name in DUCK})
    ctes = [f"f_{name} AS ({DUCK[name].format(**raw)})" for name in names]
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        ctes.append(body[15:])
        body, recursive = "", True
    elif body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        body = ""
    if not ctes:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


class Tables:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark, sf_dir), sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{name: self.raw(name) for name in names})

    @cached_property
    def bars(self) -> DataFrame:
        """The same values as `BARS`, summed as whole cents and priced in millionths:
        integer sums are exact and far cheaper than decimal ones."""
        def cents(name: str) -> Column:
            return F.round(F.col(name) * 100).cast("bigint")

        daily = self.raw("lineitem").groupBy(
            F.col("l_suppkey").alias("stock_id"), F.to_date("l_shipdate").alias("trade_date")).agg(
            F.sum(cents("l_discount") - 5).alias("move"), F.max(cents("l_tax")).alias("tax"),
            F.sum(cents("l_quantity")).alias("volume"), F.sum(cents("l_extendedprice")).alias("amount"))
        w = Window.partitionBy("stock_id").orderBy("trade_date")
        walk = F.sum("move").over(w.rowsBetween(Window.unboundedPreceding, 0))
        rows = daily.withColumn("close", (500 + (F.col("tax") - 4) * 8) * 1000000 + walk * 1500000)
        rows = rows.withColumn("open", F.lag("close", 1, 500000000).over(w))
        spread = F.col("tax") * 100000

        def units(value: Column, kind: str, digits: int) -> Column:
            return (value.cast("decimal(18,0)") * F.lit(10 ** -digits).cast(f"decimal({digits},{digits})")).cast(kind)

        price = "decimal(18,6)"
        return rows.select(
            "stock_id", "trade_date", units(F.col("open"), price, 6).alias("open"),
            units(F.greatest("open", "close") + spread, price, 6).alias("high"),
            units(F.least("open", "close") - spread, price, 6).alias("low"),
            units(F.col("close"), price, 6).alias("close"),
            units(F.col("volume"), "decimal(24,4)", 2).alias("volume"),
            units(F.col("amount"), "decimal(24,4)", 2).alias("amount"),
            units(F.col("volume"), "decimal(12,6)", 4).alias("turnover_rate"), F.lit("qfq").alias("adjust_type"))

    @cached_property
    def stocks(self) -> DataFrame:
        return self._sql(STOCKS, "supplier").withColumn("exchange", exchange_of(F.col("stock_code")))

    @cached_property
    def topics(self) -> DataFrame:
        return self._sql(TOPICS, "orders")

    @cached_property
    def mentions(self) -> DataFrame:
        """Rows of a topic meet in the shuffle that makes them distinct, so that topics join without another."""
        links = self.raw("lineitem").select(F.col("l_orderkey").alias("topic_id"), F.col("l_suppkey").alias("stock_id"))
        return links.repartition("topic_id").distinct()

    @cached_property
    def topic_words(self) -> DataFrame:
        """(topic_id, keyword_id): words serve as their own ids. A line moves once with both words of its part."""
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("topic_id"), F.col("l_partkey").alias("p_partkey"))
        both = F.array(*[F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2)])
        return (lines.join(self.raw("part").select("p_partkey", "p_name"), "p_partkey").select("topic_id", "p_name")
                .repartition("topic_id").select("topic_id", F.explode(both).alias("keyword_id")).distinct())

    @cached_property
    def words(self) -> DataFrame:
        return self._sql(WORDS, "part")

    @cached_property
    def docs(self) -> DataFrame:
        return self._sql(DOCS, "documents")

    @cached_property
    def posts(self) -> DataFrame:
        return self.spark.sql(POSTS, docs=self.docs)

    @cached_property
    def catalog(self) -> DataFrame:
        return self._sql(CATALOG, "benchmark")

    @cached_property
    def long_names(self) -> DataFrame:
        words = self.raw("benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word"))
        return self.spark.sql(LONG_NAMES, benchmark_words=words)

    @cached_property
    def aliases(self) -> DataFrame:
        return self._sql(ALIASES, "part")

    @cached_property
    def dictionary(self) -> DataFrame:
        return self.spark.sql(DICTIONARY, words=self.words)

    @cached_property
    def doc_links(self) -> DataFrame:
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        doc = F.col("doc_id")
        pair = F.array_distinct(F.array(doc % F.col("n"), (doc * 7 + 3) % F.col("n")))
        return (self.raw("documents").select("doc_id").withColumn("n", n.scalar())
                .select(doc.alias("topic_id"), F.explode(pair).alias("stock_id")))

    @cached_property
    def grid(self) -> DataFrame:
        return self._sql(GRID, "events")

    @cached_property
    def grid_stocks(self) -> DataFrame:
        return self._sql(GRID_STOCKS, "events")

    @cached_property
    def calendar(self) -> DataFrame:
        return self.raw("events").select(F.to_date("ts").alias("trade_date")).distinct()

    @cached_property
    def grid_source(self) -> DataFrame:
        days = self.calendar.agg(F.sort_array(F.collect_list("trade_date")).alias("days"))
        users = self.raw("events").select(F.col("user_id").alias("stock_id")).distinct()
        return (users.withColumn("days", days.scalar()).select("stock_id", F.explode("days").alias("trade_date"))
                .filter((F.col("stock_id") + F.day("trade_date")) % 3 != 0))

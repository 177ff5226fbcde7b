"""Properties: strategies agree, order of partitions does not matter, skew is harmless."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as K
from tidemark.operators import events as E
from tidemark.operators import indicators as I
from tidemark.operators import quality as Q
from tidemark.operators import stats as S
from tidemark.operators.matching import candidates, contained_terms
from tidemark.plans.fixtures import Tables
from tidemark.streaming import intake as Z

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_matching_against_brute_force(spark):
    rng = random.Random(7)
    texts = [(i, "".join(rng.choice("abé一二") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    terms = sorted({"".join(rng.choice("abé一二") for _ in range(rng.randint(1, 5))) for _ in range(120)})
    want = sorted((i, t) for i, x in texts for t in terms if t in x)
    frame = spark.createDataFrame(texts, "topic_id int, text string")
    words = spark.createDataFrame([(t,) for t in terms], "term string")
    assert rows(contained_terms(frame, words).select("topic_id", "term")) == want
    assert contained_terms(frame, words.limit(0)).count() == 0


def test_matching_with_a_short_name_and_a_hot_gram(spark):
    texts = [(i, f"the the {i} " + ("一" if i == 7 else "") + ("thermos" if i % 50 == 0 else "")) for i in range(300)] + [(300, None), (301, "")]
    frame = spark.createDataFrame(texts, "topic_id int, text string")
    terms = ["一", "thermos", "the", "e ", "absent", "therm one"]
    words = spark.createDataFrame([(t,) for t in [*terms, "the", "", None]], "term string")
    want = sorted((i, t) for i, x in texts for t in terms if x and t in x)
    assert rows(contained_terms(frame, words).select("topic_id", "term")) == want
    # A term is filed under its rarest gram of the texts: "thermos" does not make a candidate of every "the".
    filed = candidates(frame, spark.createDataFrame([("thermos",)], "term string"))
    assert filed.count() == 6


def test_exact_median_against_statistics(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 400):
        values = [rng.choice([-0.07, rng.gauss(0, 1)]) for _ in range(n)]
        frame = spark.createDataFrame([(v,) for v in values], "r double")
        assert abs(K.exact_median(frame, "r", ranked=16).first()[0] - statistics.median(values)) < 1e-15
    same = spark.createDataFrame([(2.5,)] * 9, "r double")
    assert K.exact_median(same, "r").first()[0] == 2.5


def test_partition_count_does_not_matter(spark):
    def figures():
        t = Tables(spark, SF)
        returns = E.event_returns(t.topics, t.mentions, t.bars)
        stats = S.keyword_stats(t.words, t.topic_words, returns, t.stocks)
        return [[round(v, 9) if isinstance(v, float) else v for v in r] for r in rows(stats.drop("normalized_keyword"))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = figures()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert figures() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_event_returns_of_the_past_stay(spark):
    t = Tables(spark, SF)
    cut = F.lit("1996-01-01").cast("date")
    early = E.event_returns(t.topics, t.mentions, t.bars.filter(F.col("trade_date") < cut)).filter("return_20d IS NOT NULL")
    full = E.event_returns(t.topics, t.mentions, t.bars)
    assert early.count() > 0 and early.exceptAll(full).count() == 0


def test_hot_stock_and_hot_day(spark):
    """A third of all mentions on one stock and day: same answer as asking once."""
    t = Tables(spark, SF)
    stock = t.bars.agg(F.min("stock_id")).first()[0]
    topics = spark.range(3000).select("id", F.lit("1995-03-01 10:00:00").cast("timestamp").alias("published_at"))
    links = topics.select(F.col("id").alias("topic_id"), F.when(F.col("id") % 3 == 0, F.lit(stock)).otherwise(F.col("id") % 10).cast("bigint").alias("stock_id"))
    got = E.event_returns(topics, links, t.bars).filter(F.col("stock_id") == stock)
    assert got.select("event_date", "return_20d").distinct().count() == 1
    assert got.count() == links.filter(F.col("stock_id") == stock).count()


def test_gaps_and_bars_fill_the_grid(spark):
    t = Tables(spark, SF)
    every = t.grid_stocks.withColumn("stock_name", F.lit("any"))
    gaps = Q.detect_gaps(t.grid, t.calendar, every).join(t.grid.select("stock_id").distinct(), "stock_id")
    span = t.grid.groupBy("stock_id").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = t.calendar.crossJoin(span).filter("trade_date BETWEEN a AND b").select("stock_id", "trade_date")
    both = t.grid.select("stock_id", "trade_date").unionAll(gaps.select("stock_id", F.col("day").alias("trade_date")))
    assert rows(both) == rows(days)


def test_stream_resumes_without_doubles(spark, tmp_path):
    schema = "topic_id string, title string, content string, seq bigint"
    source = tmp_path / "in"
    def put(n, ids):
        spark.createDataFrame([(f"t{i}", "", f"text {n}", n * 100 + i) for i in ids], schema).coalesce(1).write.mode("append").parquet(str(source))
    from pyspark.sql.types import StructType
    def run(state="state"):
        stream = Z.read_stream(spark, str(source), StructType.fromDDL(schema))
        Z.stream_topics(stream, str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()
        return {r.topic_id: r.content for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()}
    put(0, [1, 1, 2])
    assert run() == {"t1": "text 0", "t2": "text 0"}
    put(1, [2, 3])
    assert run() == {"t1": "text 0", "t2": "text 0", "t3": "text 1"}
    # A lost state folder: the source is read anew, and what is stored neither goes nor comes twice.
    assert run("other") == {"t1": "text 0", "t2": "text 0", "t3": "text 1"}
    put(2, [4])
    assert run() == run("other") == {"t1": "text 0", "t2": "text 0", "t3": "text 1", "t4": "text 2"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_bar_stream_replaces_the_running_day_only(spark, tmp_path):
    from pyspark.sql.types import StructType
    feed = StructType.fromDDL("stock_id bigint, date string, adjust_type string, close double, seq bigint")
    table = StructType.fromDDL("stock_id bigint, trade_date date, adjust_type string, close double")
    def put(rows_):
        spark.createDataFrame(rows_, feed).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    def run(now):
        stream = Z.read_stream(spark, str(tmp_path / "in"), feed)
        Z.stream_bars(stream, str(tmp_path / "out"), str(tmp_path / "state"), lambda batch: now, table).awaitTermination()
        return {r.trade_date: r.close for r in Z.current_bars(spark, str(tmp_path / "out"), table).collect()}
    a, b = dt.date(2026, 1, 5), dt.date(2026, 1, 6)
    put([(1, "2026-01-05", "qfq", 1.0, 1), (1, "2026-01-06", "qfq", 1.0, 2)])
    assert run("2026-01-06 08:00:00") == {a: 1.0, b: 1.0}
    put([(1, "2026-01-05", "qfq", 2.0, 3), (1, "2026-01-06", "qfq", 2.0, 4)])
    assert run("2026-01-06 09:00:00") == {a: 1.0, b: 2.0}


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 500, 5000])
@pytest.mark.parametrize("period", [1, 2, 35, 250])
def test_blocked_average_is_the_recurrence(n, period):
    series = np.random.default_rng(n).normal(100, 30, n)
    alpha, level, want = 2 / (period + 1), series[0], []
    for k, value in enumerate(series):
        level = alpha * value + (1 - alpha) * level if k else value
        want.append(level)
    assert np.allclose(I.average(series, period), want, rtol=0, atol=1e-9)


def test_average_past_what_is_not_finite():
    got = I.average(np.array([1.0] * 70 + [np.nan, 1.0, np.inf]), 3)
    assert np.all(got[:70] == pytest.approx(1.0)) and np.isnan(got[70:]).all()
    assert len(I.average(np.array([]), 3)) == 0


def test_median_ranks_few_values_whatever_the_spread(spark, monkeypatch):
    rng = random.Random(6)
    for values in ([rng.gauss(0, 1e-3) for _ in range(20_000)] + [1e9, -1e15], [10.0 ** rng.uniform(-300, 300) for _ in range(20_001)],
                   [0.5] * 9000 + [rng.random() for _ in range(9001)]):
        frame = spark.createDataFrame([(v,) for v in values], "r double").repartition(4)
        seen = []
        collect = type(frame).collect
        monkeypatch.setattr(type(frame), "collect", lambda df: seen.append(got := collect(df)) or got)
        assert K.exact_median(frame, "r", ranked=150).first()[0] == statistics.median(values)
        monkeypatch.undo()
        assert max(map(len, seen)) <= 200  # at most 1 % of the values
    assert K.exact_median(spark.createDataFrame([(None,)], "r double"), "r").first()[0] is None

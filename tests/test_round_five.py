"""Cases of the findings in FINDINGS_r04."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_round_four import SMALL, against_sql

import __spark_entry__ as entry
from tidemark.operators import events as E
from tidemark.operators import mining
from tidemark.operators.bars import by_stock, forward_returns, max_forward_return


def test_texts_without_a_word(spark, tmp_path):
    """empty texts and blank ones have an empty dictionary form, a null one has none."""
    odd = "SELECT * REPLACE (CASE doc_id % 20 WHEN 3 THEN '' WHEN 4 THEN E' \\n ' WHEN 5 THEN NULL ELSE text END AS text) FROM documents"
    assert against_sql(spark, tmp_path, ["f6_normalize_term"], documents=odd) == {"f6_normalize_term": None}


@pytest.mark.parametrize("name", ["s5_intake_tables", "t4_link_stocks"])
def test_codes_within_tokens(spark, tmp_path, name):
    """a token of a text holds six digits that are a stock's code, with and without letters of an exchange before them."""
    own = """SELECT * REPLACE (CASE WHEN doc_id % 7 = 3 THEN SUBSTRING(text, 1, 200) || ' token="ab600007cd" ' || SUBSTRING(text, 201)
        WHEN doc_id % 7 = 4 THEN 'a sh600008 ' || text WHEN doc_id % 7 = 5 THEN 'a SZ.600009 ' || text ELSE text END AS text) FROM documents"""
    assert against_sql(spark, tmp_path, [name], documents=own) == {name: None}


def test_contexts_of_codes(spark):
    """unless a spelling is given, a context lies around the code as it was found."""
    topics = spark.createDataFrame([(3, "", "x" * 200 + " 600007")], "id bigint, title string, content string")
    stocks = spark.createDataFrame([(1, "600007", "n/a")], "id bigint, stock_code string, stock_name string")
    aliases = mining.alias_frame(spark)
    found, given = (mining.best_mentions(topics, stocks, aliases, s).first().mention_context for s in (None, lambda c: F.concat(F.lit("SH"), c)))
    assert found == "x" * 39 + " 600007" and given == " " + "x" * 79


def test_outcomes_from_the_closes_ahead(spark):
    """what the look-up's closes say equals the windows over bars: short ends, pauses, a zero and a missing close."""
    days = [dt.date(2026, 1, 1) + dt.timedelta(k + 200 * (k > 25)) for k in range(60)]
    prices = [None if k == 40 else 0 if k == 30 else 10 + (k * 7) % 9 for k in range(60)]
    rows = [(s, d, p, "qfq") for s in (1, 2) for d, p in zip(days[s:], prices[s:])]
    bars = spark.createDataFrame([(s, d, None if p is None else Decimal(p), a) for s, d, p, a in rows],
                                 "stock_id bigint, trade_date date, close decimal(18,6), adjust_type string")
    topics = spark.createDataFrame([(k, dt.datetime(2025, 12, 25) + dt.timedelta(k)) for k in range(280)], "id bigint, published_at timestamp")
    links = topics.selectExpr("id AS topic_id", "EXPLODE(ARRAY(1L, 2L)) AS stock_id")
    windows = max_forward_return(forward_returns(bars)).withColumn("_has_next", F.lead("trade_date").over(by_stock()).isNotNull())
    want = E.forward_asof(topics, links, windows, [*E.METRICS, "rise_5d", "rise_20d", "_has_next"]).filter("_has_next")
    want = want.select("topic_id", "stock_id", "trade_date", *E.METRICS, "rise_5d", "rise_20d").collect()
    got = E.event_returns(topics, links, bars)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want))) and len(want) > 400


@pytest.mark.parametrize("name,most", [("l8_topic_detail", 21)])
def test_rows_move_once(spark, name, most):
    """shuffles of a plan whose tables are too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(") <= most

"""Cases of the fourth round's findings."""

import datetime as dt

import numpy as np
import pytest
from oracle import TABLES, compare, duck_connection
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import text
from tidemark.operators import events as E
from tidemark.operators import indicators as I
from tidemark.sources import quotes


@pytest.mark.parametrize("period", [1, 2, 3, 35, 60])
def test_average_rounds_as_the_recurrence(period):
    """equal to the last bit, since flags compare lines that meet."""
    series = np.random.default_rng(period).normal(500, 30, 1000)
    alpha, level, want = 2 / (period + 1), series[0], []
    for k, value in enumerate(series):
        level = alpha * value + (1 - alpha) * level if k else value
        want.append(level)
    assert I.average(series, period).tolist() == want


SMALL = "/root/testdata/sf0.001"


def against_sql(spark, home, names, **tables):
    """What differs on a folder whose tables are the small ones but for those given as SQL over them."""
    con = duck_connection(SMALL)
    for name in TABLES:
        body = tables.get(name, f"SELECT * FROM {name}")
        con.execute(f"COPY ({body}) TO '{home}/{name}.parquet' (FORMAT PARQUET)")
    return {n: compare(spark, duck_connection(str(home)), n, str(home)) for n in names}


def test_codes_shared_by_stocks(spark, tmp_path):
    """From 3,000 suppliers on, stocks share codes."""
    names = ("s12_apply_outcomes", "s12_run_status", "s12_run_totals", "s4_merge_counts", "s4_merge_master")
    twice = "SELECT * REPLACE (CAST(s_suppkey + k * 3000 AS BIGINT) AS s_suppkey) FROM supplier, (SELECT UNNEST([0, 1, 3]) AS k)"
    assert against_sql(spark, tmp_path, names, supplier=twice) == dict.fromkeys(names)


def test_texts_without_a_readable_letter(spark, tmp_path):
    """one document is a word of accented letters only."""
    names = ("p1_stream_topics", "s6_sync_topics", "s6_sync_counts", "s5_import_topics", "s5_import_counts")
    short = "SELECT * REPLACE (CASE WHEN doc_id % 20 = 3 THEN 'É.' ELSE text END AS text) FROM documents"
    assert against_sql(spark, tmp_path, names, documents=short) == dict.fromkeys(names)


def test_closes_below_zero(spark, tmp_path):
    """a walk that passes zero, and stands on it."""
    low = "SELECT * REPLACE (0.0 AS l_discount, 0.04 AS l_tax, CAST(l_suppkey % 2 AS BIGINT) AS l_suppkey) FROM lineitem"
    assert against_sql(spark, tmp_path, ["s2_normalize_bars"], lineitem=low) == {"s2_normalize_bars": None}


def test_entities_cut_in_two(spark, tmp_path):
    """a title ends inside an entity."""
    cut = "SELECT * REPLACE ('<title>a &amp;amp; b &amp</title><p>c &lt d &copy;</p>' AS html) FROM pages"
    assert against_sql(spark, tmp_path, ["f7_clean_text"], pages=cut) == {"f7_clean_text": None}
    bodies = spark.createDataFrame([("&amp</b>&ampx; &#65; &#x42; &nope; &notin; &lt",)], "t string")
    strict, lenient = bodies.select(text.clean_text(F.col("t"), bare=False), text.clean_text(F.col("t"))).first()
    assert strict == "&amp&ampx; A B &nope; ∉ &lt" and lenient == "&&x; A B &nope; ∉ <"


@pytest.mark.parametrize("name", ["s1_csv_rows", "s1_import_new_only"])
def test_bars_are_imported_in_one_pass(spark, name):
    """two copies of every bar come from one scan, and rows are reduced in a hash table."""
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 1 and "SortAggregate" not in plan


def test_first_whole_row_by_file_and_line(spark, tmp_path):
    """rows count in the order of file names and lines; those that are not whole do not."""
    (tmp_path / "a.csv").write_text("code,date,close,low\n1,2026-01-05,x,1\n1,2026-01-05,7,n/a\n1,2026-01-05,8,2\n1,2026-01-05,9,3\n")
    (tmp_path / "b.csv").write_text("low,close,date,code\n4,10,2026-01-05,1\n5,11,2026-01-06,1\n,12,2026-01-06,1\n")
    bars, _ = quotes.read_quotes_csv(spark, f"{tmp_path}/*.csv")
    assert sorted((str(r.trade_date), int(r.close), int(r.low)) for r in bars.collect()) == [("2026-01-05", 8, 2), ("2026-01-06", 11, 5)]


def test_bars_are_laid_out_by_stretches(spark):
    """a bar after a long pause is one row a stretch, not one a day, and is met from every day of the pause."""
    days = [dt.date(2026, 1, 1), dt.date(2026, 1, 2), dt.date(2026, 7, 1)]
    bars = spark.createDataFrame([(1, d, i) for i, d in enumerate(days)], "stock_id bigint, trade_date date, close int")
    topics = spark.createDataFrame([(i, dt.datetime(2025, 12, 20) + dt.timedelta(i)) for i in range(200)], "id bigint, published_at timestamp")
    links = topics.selectExpr("id AS topic_id", "1L AS stock_id")
    assert E.day_lookup(bars, ["close"], E.earliest_start(topics)).count() < 12
    rows = E.forward_asof(topics, links, bars, ["close"]).collect()
    assert {r.topic_id: r.trade_date for r in rows} == {
        i: min(d for d in days if d >= start) for i in range(200) if (start := dt.date(2025, 12, 20) + dt.timedelta(i)) <= days[-1]}

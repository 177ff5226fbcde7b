"""Small cases with known answers."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codes, text, times
from tidemark.operators import bars as B
from tidemark.operators import dictionary as D
from tidemark.operators import events as E
from tidemark.operators import indicators as I
from tidemark.operators import ingest as G
from tidemark.operators import mining as T
from tidemark.operators import quality as Q
from tidemark.operators import search as L
from tidemark.operators import stats as S
from tidemark.sources import payloads as P
from tidemark.sources import quotes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def topic_frame(spark, rows):
    return spark.createDataFrame(
        [(i, f"t{i}", title, content, "A", dt.datetime(2026, 1, 1 + i)) for i, (title, content) in enumerate(rows)],
        "id bigint, topic_id string, title string, content string, author string, published_at timestamp")


def test_code_extraction_skips_longer_runs(spark):
    topics = topic_frame(spark, [("", "盘前：600519、000001；单号 9876543 不算"), ("SH600519", "sz.000002 x600519")])
    got = {(r.topic_id, r.stock_code) for r in T.code_mentions(topics).collect()}
    assert got == {(0, "600519"), (0, "000001"), (1, "600519"), (1, "000002")}


def test_alias_and_name_and_code_precedence(spark):
    topics = topic_frame(spark, [("下午与高澜管理层通话", "纪要明天发"), ("300499", "又见高澜"), ("000660", "listed elsewhere")])
    stocks = spark.createDataFrame([(1, "300499", "高澜股份")], "id bigint, stock_code string, stock_name string")
    none = spark.createDataFrame([], "topic_id bigint, stock_id bigint")
    links, _ = T.link_stocks(topics, stocks, T.alias_frame(spark), none)
    got = {(r.topic_id, r.stock_code): r.confidence for r in links.collect()}
    assert got == {(0, "300499"): Decimal("0.9000"), (1, "300499"): Decimal("1.0000")}
    again, _ = T.link_stocks(topics, stocks, T.alias_frame(spark), spark.createDataFrame([(0, 1)], none.schema))
    assert [r.topic_id for r in again.collect()] == [1]


def test_new_named_stock_is_created(spark):
    topics = topic_frame(spark, [("会稽山", "")])
    stocks = spark.createDataFrame([], "id bigint, stock_code string, stock_name string")
    _, changes = T.link_stocks(topics, stocks, T.alias_frame(spark), spark.createDataFrame([], "topic_id bigint, stock_id bigint"))
    assert [tuple(r) for r in changes.collect()] == [("601579", "会稽山", "SH", "created")]


def test_keyword_normalisation_gives_one_link(spark):
    words = spark.createDataFrame([(i, k, n, "manual", True, False, i) for i, (k, n) in enumerate(T.SEED_WORDS)],
                                  "id bigint, keyword string, normalized_keyword string, category string, active boolean, deleted boolean, position bigint")
    topics = topic_frame(spark, [("本周再度涨价", "")])
    got = T.keyword_matches(topics, words).collect()
    assert [(r.normalized_keyword, r.keyword) for r in got] == [("涨价", "涨价")]


def test_emphasis_phrases_not_nouns(spark):
    topics = topic_frame(spark, [("", "午后随笔：云桥数码依旧继续看好；利润超预期。翻10倍空间！强 CALL！务必重视，重点推荐；电缆排产")])
    terms = {r.term for r in T.emphasis_terms(topics).collect()}
    assert {"继续看好", "超预期", "翻10倍空间", "强call", "务必重视", "重点推荐"} <= terms
    assert not terms & {"云桥数码", "电缆", "排产", "0倍空间", "10倍空间"}


def test_full_width_text_is_folded(spark):
    topics = topic_frame(spark, [("", "收盘：强ＣＡＬＬ　５倍空间")])
    assert {r.term for r in T.emphasis_terms(topics).collect()} == {"强call", "5倍空间"}
    assert one(spark, text.normalize_term(F.lit("  ＡＢ　 c "))) == "AB c"
    assert one(spark, text.normalize_term(F.lit(" 　 "))) is None


def test_search_needs_all_words_newest_first(spark):
    topics = topic_frame(spark, [("云桥数码", "还能翻倍吗"), ("云桥数码翻倍", "周一复盘"), ("云桥数码", "只提到公司")])
    assert one(spark, text.split_terms(F.lit(" 云桥数码，翻倍, 云桥数码 "))) == ["云桥数码", "翻倍"]
    pages = [L.search_topics(topics, ["云桥数码", "翻倍"], p, 1).collect() for p in (1, 2)]
    assert [(p[0].id, p[0].total) for p in pages] == [(1, 2), (0, 2)]


def test_search_wildcards_can_be_escaped(spark):
    topics = topic_frame(spark, [("a", "50% up"), ("b", "50 up")])
    assert L.search_topics(topics, ["0%u"], 1, 5).count() == 2
    assert [r.id for r in L.search_topics(topics, ["0%"], 1, 5, escape=True).collect()] == [0]


def bars_frame(spark, closes, stock=1):
    rows = [(stock, day(i), *[Decimal(str(c))] * 4, Decimal(1), Decimal(1), Decimal(0), "qfq") for i, c in enumerate(closes)]
    from tidemark.schema import BAR
    return spark.createDataFrame(rows, BAR)


def test_window_must_be_complete(spark):
    def best(n):
        rows = B.max_forward_return(bars_frame(spark, [10] + [11] * n)).orderBy("trade_date").first()
        return rows.max_return_20d, rows.rise_20d
    assert best(19) == (None, False)
    assert best(20) == (Decimal("0.100000"), True)


def test_zero_base_gives_no_return(spark):
    row = B.max_forward_return(B.forward_returns(bars_frame(spark, [0] + [11] * 20))).orderBy("trade_date").first()
    assert row.return_1d is None and row.max_return_20d is None and row.rise_20d is False


def test_event_date_follows_the_beijing_close(spark):
    topics = spark.createDataFrame([(1, dt.datetime(2026, 1, 2, 6, 59)), (2, dt.datetime(2026, 1, 2, 7, 0)),
                                    (3, dt.datetime(2025, 1, 1)), (4, dt.datetime(2026, 3, 1))], "id bigint, published_at timestamp")
    links = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "topic_id bigint, stock_id bigint")
    got = {r.topic_id: r.event_date for r in E.event_returns(topics, links, bars_frame(spark, [10, 11, 12, 13])).collect()}
    assert got == {1: day(1), 2: day(2), 3: day(0)}


def ramp(spark, extra=()):
    rows = []
    for i in range(170):
        c = 10 + i * 0.02
        rows.append([c - 0.03, c + 0.08, c - 0.22, c, 1000.0])
    rows[150] = [12.8, 14.9, 12.7, 14.75, 2300.0]
    rows += extra
    return spark.createDataFrame([(1, day(i), *r) for i, r in enumerate(rows)],
                                 "stock_id bigint, trade_date date, open double, high double, low double, close double, volume double")


def test_signal_on_a_ramp_and_no_look_ahead(spark):
    points = I.zzr(ramp(spark)).orderBy("trade_date").collect()
    fired = [i for i, p in enumerate(points) if p.signal]
    assert fired and fired[0] >= 130
    assert points[fired[0]].trend and points[fired[0]].breakout and points[fired[0]].money_flow_up
    longer = I.zzr(ramp(spark, [[20.0, 21.0, 19.0, 20.5, 2000.0]])).orderBy("trade_date").collect()
    assert longer[:170] == points


def test_start_at_moves_the_warm_up(spark):
    later = I.zzr(ramp(spark), start_at=day(40).isoformat()).filter("signal").count()
    assert later == 0 and I.zzr(ramp(spark)).filter("signal").count() > 0


def test_excluded_names_and_codes(spark):
    def out(name, code="600000"):
        return one(spark, codes.is_excluded(F.lit(name).cast("string"), F.lit(code)))
    assert all(out(n) for n in ("ST康美", "*ST海航", "st abc", "*st x", "退市海创"))
    assert not any(out(n) for n in ("贵州茅台", "", None, "BEST"))
    assert out("九号公司", "689009") and out("x", "689001") and not out("中芯国际", "688981")


def test_market_labels(spark):
    rows = spark.createDataFrame([("300750",), ("688981",), (" 920001",), ("830001",), ("600519",), ("900001",), (None,)], "c string")
    got = [r.m for r in rows.select(codes.market_of(F.col("c")).alias("m")).collect()]
    assert got == ["创业板", "科创板", "北交所", "北交所", "主板", "其他", "其他"]


@pytest.mark.parametrize("raw,want", [
    ("2026-09-16T10:52:34.729+0800", dt.datetime(2026, 9, 16, 2, 52, 34, 729000)), ("2026-09-16T10:00:00Z", dt.datetime(2026, 9, 16, 10)),
    ("2026-09-16 10:00:00", dt.datetime(2026, 9, 16, 10)), ("2026-09-16", dt.datetime(2026, 9, 16)), (" ", dt.datetime(2000, 1, 1))])
def test_parse_time(spark, raw, want):
    parsed = times.parse_time(F.lit(raw), F.lit("2000-01-01").cast("timestamp"))
    assert one(spark, parsed.cast("timestamp_ntz")) == want


def test_readable_content(spark):
    def ok(title, content=""):
        return one(spark, text.has_real_content(F.lit(title), F.lit(content)))
    assert not ok("%23%E6%96%87%E4%BB%B6%23", " # ") and not ok("#附件#") and ok("#标签# 正文") and ok("100%")


def test_clean_text_resolves_hashtags(spark):
    body = '&lt;b&gt;x&amp;amp;y <e type="hashtag" hid="1" title="%23%E5%85%89%E6%A8%A1%E5%9D%97%23" /> a+b <br/> '
    assert one(spark, text.clean_text(F.lit(body))) == "x&amp;y #光模块 a+b"


def test_redaction_and_title(spark):
    assert one(spark, text.redact(F.lit("Token = abc;\n cookie: x, ok"), 300)) == "Token=[redacted]; cookie=[redacted], ok"
    assert one(spark, text.fill_title(F.lit(""), F.lit("first\nsecond"))) == "first"


def payload_frame(spark, *items):
    return spark.createDataFrame([(i, json.dumps(p, ensure_ascii=False)) for i, p in enumerate(items)], "page_id int, payload string")


def test_payload_envelopes(spark):
    talk = {"topic_id": 42, "group": {"group_id": 7, "name": "圈"}, "title": "", "talk": {"owner": {"name": "Ann"}, "text": "第一行\n第二行"},
            "create_time": "2026-01-01T08:00:00.000+0800", "tags": [{"title": "<b>T</b>"}, "T", "U"]}
    inner = {"items": [{"topic_id": "5", "text": "hi", "user": {"alias": "Bo"}}], "has_more": False, "next_end_time": "later"}
    frame = payload_frame(
        spark, {"succeeded": True, "resp_data": {"topics": [talk]}}, {"ok": True, "data": {"topics": [talk, {"topic_id": None}]}},
        {"ok": True, "result": {"content": [{"type": "text", "text": "no json"}, {"type": "text", "text": json.dumps(inner)}]}},
        {"count": 1, "has_more": True, "next_end_time": "n", "topics_brief": [{"topic_id": "9", "content": "c", "owner": {"name": "O"}}]},
        {"succeeded": False, "resp_data": {"topics": [talk]}}, {"nothing": 1})
    topics, pages = P.normalize_payloads(frame, "2026-02-02 00:00:00", page_size=1)
    got = {(r.page_id, r.topic_id): r for r in topics.collect()}
    assert set(got) == {(0, "42"), (1, "42"), (2, "5"), (3, "9")}
    first = got[(0, "42")]
    assert (first.title, first.author, first.tags, first.group_id) == ("第一行", "Ann", ["T", "U"], "7")
    assert first.content == "第一行\n第二行" and first.source_url.endswith("/42")
    assert first.published_at == dt.datetime(2026, 1, 1) and got[(2, "5")].author == "Bo"
    state = {r.page_id: (r.rejected, r.topics, r.has_more, r.cursor) for r in pages.collect()}
    assert state == {0: (False, 1, True, None), 1: (False, 2, True, None), 2: (False, 1, False, "later"),
                     3: (False, 1, True, "n"), 4: (True, 0, None, None), 5: (False, 0, False, None)}
    cursors = {r.page_id: r.next_end_time for r in P.page_cursors(pages, topics, 1).collect()}
    assert cursors[0] == "2026-01-01T07:59:59.999+0800" and cursors[2] == "later"


def test_payloads_of_any_depth(spark):
    item = {"topic_id": None, "topic_uid": "u1", "text": "deep"}
    page = {"items": [item], "has_more": 0, "next_end_time": "c"}
    frames = []
    for depth in range(9):
        nested = page
        for level in range(depth):
            name = ("resp_data", "data", "result")[level % 3]
            nested = {name: nested} if level % 2 else {"content": [{"text": 5}, {"text": json.dumps(nested)}]}
        frames.append(nested)
    topics, pages = P.normalize_payloads(payload_frame(spark, *frames), "2026-02-02 00:00:00")
    assert sorted((r.page_id, r.topic_id) for r in topics.collect()) == [(d, "u1") for d in range(9)]
    assert {(r.rejected, r.has_more, r.cursor) for r in pages.collect()} == {(False, False, "c")}


def test_payload_without_a_marked_list(spark):
    topics, pages = P.normalize_payloads(payload_frame(
        spark, {"topics": [{"topic_uid": "a"}, {"topic_uid": "b"}], "has_more": "yes", "data": {"next_end_time": 7}},
        {"data": {"items": [{"topic_uid": "a"}]}, "has_more": True}, {"data": {"list": []}, "topics": [{"topic_uid": "z"}]}), "2026-02-02 00:00:00")
    assert sorted((r.page_id, r.topic_id) for r in topics.collect()) == [(0, "a"), (0, "b")]
    assert {r.page_id: (r.topics, r.has_more, r.cursor) for r in pages.collect()} == {0: (2, True, None), 1: (0, True, None), 2: (0, False, None)}


def test_tags_are_cleaned_like_texts(spark):
    tags = F.array(F.lit("a&nbsp;b &#233;"), F.lit('<e type="hashtag" hid="1" title="%23x%20y%23"/>'), F.lit("<i>&amp;</i>"), F.lit(None).cast("string"), F.lit("a\xa0b é"))
    assert one(spark, text.distinct_tags(tags)) == ["a\xa0b é", "#x y", "&"]


def test_payload_shape_holds_no_values(spark):
    shape = {(r.path, r.kind, r.list_length) for r in P.payload_shape(payload_frame(spark, {"a": {"b": [1, 2]}, "secret": "s"})).collect()}
    assert shape == {("$", "object", None), ("$.a", "object", None), ("$.a.b", "list", 2), ("$.a.b[0]", "number", None), ("$.secret", "string", None)}


def test_calendar_rows(spark):
    rows = spark.createDataFrame([("2026-01-05 00:00", None, None), (None, "2026-01-06", None), ("", "", "2026-01-07"), ("bad", None, None),
                                  ("2025-12-31", None, None)], "trade_date string, `交易日` string, calendarDate string")
    assert sorted(r.trade_date.day for r in quotes.trading_days(rows, "2026-01-01", "2026-12-31").collect()) == [5, 6, 7]


def gap_case(spark, have, days, stocks=((1, "600001", "A"), (2, "600002", "B"))):
    bars = spark.createDataFrame([(s, day(d)) for s, d in have], "stock_id bigint, trade_date date")
    calendar = spark.createDataFrame([(day(d),) for d in days], "trade_date date")
    frame = spark.createDataFrame(list(stocks), "id bigint, stock_code string, stock_name string")
    return bars, calendar, frame


def test_gaps_mid_tail_head_and_silent(spark):
    case = gap_case(spark, [(1, 1), (1, 3), (1, 4)], range(7))
    got = sorted(((r.day - day(0)).days, r.code) for r in Q.detect_gaps(*case).collect())
    assert got == sorted([(2, "600001")] + [(d, "600002") for d in range(7)])
    missing = sorted((r.day - day(0)).days for r in Q.missing_days(case[0], case[1]).collect())
    assert missing == [2, 5, 6]
    every = sorted(((r.day - day(0)).days, r.stock_id) for r in Q.missing_days(*case).collect())
    assert every == sorted([(d, 1) for d in (2, 5, 6)] + [(d, 2) for d in range(7)])


def test_gaps_with_bars_outside_the_calendar(spark):
    case = gap_case(spark, [(1, 0), (1, 3), (1, 8)], (1, 2, 4, 6, 9), stocks=((1, "600001", "A"), (3, "689009", "C"), (4, "600004", "ST d")))
    assert sorted((r.day - day(0)).days for r in Q.detect_gaps(*case).collect()) == [1, 2, 4, 6]


def test_suspension_needs_an_answer(spark):
    case = gap_case(spark, [(1, 0), (1, 4)], range(5), stocks=((1, "600001", "A"),))
    gaps = Q.detect_gaps(*case)
    source = spark.createDataFrame([(1, day(2))], "stock_id bigint, trade_date date")
    kinds = {(r.day - day(0)).days: r.kind for r in Q.classify_gaps(gaps, source, case[2].select(F.col("id").alias("stock_id"))).collect()}
    assert kinds == {1: "suspension", 2: "sync_failure", 3: "suspension"}
    silent = Q.classify_gaps(gaps, source, case[2].filter("id = 9").select(F.col("id").alias("stock_id")))
    assert {r.kind for r in silent.collect()} == {"unclassified"}


def test_backfill_outcomes(spark):
    gaps = spark.createDataFrame([(day(1), 1, "a", "A"), (day(3), 1, "a", "A"), (day(1), 2, "b", "B"), (day(2), 3, "c", "C")],
                                 "day date, stock_id bigint, code string, name string")
    answers = spark.createDataFrame([("a", None, "ConnectionError"), ("b", 0, None), ("c", 2, None)], "code string, rows bigint, error string")
    out = {r.code: (r.status, r.reason, len(r.dates)) for r in Q.backfill_outcome(Q.backfill_spans(gaps), answers).collect()}
    assert out == {"a": ("failed", "ConnectionError", 2), "b": ("suspended", None, 1), "c": ("done", None, 1)}


def test_upsert_is_idempotent_and_keeps_the_past(spark):
    schema = "stock_id bigint, trade_date date, adjust_type string, close double"
    existing = spark.createDataFrame([(1, day(0), "qfq", 1.0), (1, day(1), "qfq", 1.0)], schema)
    incoming = spark.createDataFrame([(1, "2026-01-01", "qfq", 9.0, 1), (1, "2026-01-02", "qfq", 9.0, 2), (1, "oops", "qfq", 9.0, 3),
                                      (1, "2026-01-02", "qfq", 8.0, 4)], "stock_id bigint, date string, adjust_type string, close double, seq bigint")
    early, _ = G.upsert_bars(existing, incoming, "2026-01-02 07:09:00")
    assert early.count() == 0
    changes, counts = G.upsert_bars(existing, incoming, "2026-01-02 07:10:00")
    assert [(r.close, r.change) for r in changes.collect()] == [(8.0, "replace")]
    assert tuple(counts.first()) == (1, 2, 1, 1)
    table = G.merged_bars(existing, changes)
    again, _ = G.upsert_bars(table, incoming, "2026-01-03 00:00:00")
    assert again.count() == 0 and sorted(r.close for r in table.collect()) == [1.0, 8.0]


def test_csv_import_headers_and_defaults(spark, tmp_path):
    (tmp_path / "q.csv").write_text("﻿stock_code,name,date,close,open\n600519,茅台,2026-01-05,10,\n600519,,2026-01-05,11,9\n,x,2026-01-05,1,1\n600519,,bad,1,1\n", "utf-8")
    bars, names = quotes.read_quotes_csv(spark, str(tmp_path / "q.csv"))
    row = bars.collect()
    assert len(row) == 1 and (row[0].close, row[0].open, row[0].volume, row[0].adjust_type) == (10, 10, 0, "qfq")
    assert [tuple(r) for r in names.collect()] == [("600519", "茅台")]
    with pytest.raises(Exception):
        quotes.read_quotes_csv(spark, str(tmp_path / "q.csv"), mode="failfast")[0].collect()


def test_csv_files_of_different_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,date,close,high\n600001,2026-01-05,10,11\n600001,2026-01-06,x,1\n600001,2026-01-07,5,?\n", "utf-8")
    (tmp_path / "b.csv").write_text("high,close,date,code,extra\n99,98,2026-01-05,600001,e\n21,20,2026-01-06,600001,e\n", "utf-8")
    bars, _ = quotes.read_quotes_csv(spark, str(tmp_path))
    assert {(r.trade_date.day, int(r.close), int(r.high)) for r in bars.collect()} == {(5, 10, 11), (6, 20, 21)}


def test_stock_master_keeps_rows_and_counts_arrivals(spark):
    known = spark.createDataFrame([(7, "600001", "Old", "SH", "steel"), (8, "000002", "Same", "SZ", "cars")],
                                  "id bigint, stock_code string, stock_name string, exchange string, industry string")
    fresh = spark.createDataFrame([("600001", "Zed", 1), ("600001", "Alpha", 2), ("2", "Same", 3), ("9", "New", 4), ("x", "junk", 5), ("10", " ", 6)],
                                  "code string, name string, seq int")
    merged, counts = G.merge_master(known, fresh, "seq")
    assert {r.stock_code: (r.stock_name, r.change, r.id, r.industry) for r in merged.collect()} == {
        "600001": ("Alpha", "updated", 7, "steel"), "000002": ("Same", "kept", 8, "cars"), "000009": ("New", "imported", None, None)}
    assert tuple(counts.first()) == (1, 1, 4)


def test_old_mentions_add_no_lookup_rows(spark):
    topics = spark.createDataFrame([(1, dt.datetime(1900, 1, 1)), (2, dt.datetime(2026, 1, 2))], "id bigint, published_at timestamp")
    links = spark.createDataFrame([(1, 1), (2, 1)], "topic_id bigint, stock_id bigint")
    bars = bars_frame(spark, [10, 11, 12])
    assert E.day_lookup(bars, ["close"], E.earliest_start(topics)).count() == 3
    got = {r.topic_id: r.trade_date for r in E.forward_asof(topics, links, bars, ["close"]).collect()}
    assert got == {1: day(0), 2: day(1)}


def test_other_adjustments_do_not_matter(spark):
    bars = ramp(spark).withColumn("adjust_type", F.lit("qfq"))
    more = bars.unionByName(bars.withColumns({"adjust_type": F.lit("hfq"), "close": F.col("close") * 3}))
    columns = ["stock_id", "trade_date", "active", "signal", "mom"]
    assert sorted(I.zzr(more).select(columns).collect()) == sorted(I.zzr(bars).select(columns).collect())


def test_month_is_pushed_down(spark, tmp_path):
    rows = [("a", dt.datetime(2026, 1, 31, 15, 59), 1), ("b", dt.datetime(2026, 1, 31, 16), 2), ("c", dt.datetime(2026, 2, 28, 16), 3)]
    spark.createDataFrame(rows, "topic_id string, published_at timestamp, seq int").write.parquet(str(tmp_path / "t"))
    sliced = G.month_slice(spark.read.parquet(str(tmp_path / "t")), "2026-02")
    assert [r.topic_id for r in sliced.collect()] == ["b"]
    assert "GreaterThanOrEqual(published_at" in sliced._jdf.queryExecution().toString()


def test_keyword_csv(spark, tmp_path):
    words = spark.createDataFrame([(1, "涨价", "涨价", "manual", True, False)], "id bigint, keyword string, normalized_keyword string, category string, active boolean, deleted boolean")
    links = spark.createDataFrame([(1, 1)], "topic_id bigint, keyword_id bigint")
    stocks = spark.createDataFrame([(1, "600519", "x")], "id bigint, stock_code string, stock_name string")
    topics = spark.createDataFrame([(1, dt.datetime(2026, 1, 1))], "id bigint, published_at timestamp")
    returns = E.event_returns(topics, spark.createDataFrame([(1, 1)], "topic_id bigint, stock_id bigint"), bars_frame(spark, [10] + [12] * 20))
    S.write_keyword_csv(S.keyword_stats(words, links, returns, stocks), str(tmp_path / "out"))
    lines = [line for f in (tmp_path / "out").glob("*.csv") for line in f.read_text("utf-8").splitlines()]
    assert lines == [",".join(S.CSV_COLUMNS), "涨价,1,1,0.2,1.0,0.2,1.0,1,false"]


def test_dictionary_changes(spark):
    words = spark.createDataFrame([(1, "old", "old", "manual", True, False), (2, "gone", "gone", "manual", False, True), (3, "mined", "mined", "auto", True, False),
                                   (4, "gen", "gen", "general", True, False)],
                                  "id bigint, keyword string, normalized_keyword string, category string, active boolean, deleted boolean")
    changes = spark.createDataFrame([(1, "seed", "gone", None), (2, "seed", "fresh", None), (3, "rename", "old", "new"), (4, "delete", "mined", None),
                                     (5, "create", " ", None), (6, "seed", "gen", None)], "seq bigint, action string, word string, new_word string")
    kept, rejected = D.merge_dictionary(words, changes)
    got = {r.normalized_keyword: (r.category, r.active, r.deleted) for r in kept.collect()}
    assert got == {"new": ("manual", True, False), "gone": ("manual", False, True), "mined": ("auto", True, False),
                   "fresh": ("manual", True, False), "gen": ("manual", True, False)}
    assert [(r.word, r.reason) for r in rejected.collect()] == [("mined", "mined")]


def test_dictionary_changes_in_order(spark):
    words = spark.createDataFrame([(1, "a", "a", "manual", True, False), (2, "b", "b", "manual", True, False)],
                                  "id bigint, keyword string, normalized_keyword string, category string, active boolean, deleted boolean")
    steps = [("create", "n", None), ("deactivate", "n", None), ("create", "m", None), ("rename", "m", "m2"), ("rename", "a", "b"),
             ("rename", "b", "c"), ("rename", "a", "b"), ("delete", "b", None), ("activate", "a", None), ("rename", "c", " "), ("seed", "b", None)]
    changes = spark.createDataFrame([(i, *x) for i, x in enumerate(steps)], "seq bigint, action string, word string, new_word string")
    kept, rejected = D.merge_dictionary(words, changes)
    assert {r.normalized_keyword: (r.id, r.active, r.deleted) for r in kept.collect()} == {
        "n": (None, False, False), "m2": (None, True, False), "c": (2, True, False), "b": (1, False, True)}
    assert sorted((r.seq, r.reason) for r in rejected.collect()) == [(4, "conflict"), (8, "unknown"), (9, "empty")]


def test_pending_batches_resume(spark):
    stocks = spark.createDataFrame([(i, f"60000{i}", "n" if i != 3 else "") for i in range(6)], "id bigint, stock_code string, stock_name string")
    manifest = spark.createDataFrame([("600000", "completed", "w"), ("600001", "failed", "w"), ("600002", "completed", "other")], "stock_code string, status string, window string")
    got = [(r.batch, r.stock_code) for r in G.pending_batches(stocks, G.manifest_for_run(manifest, "w"), 2, 2).orderBy("stock_code").collect()]
    assert got == [(0, "600001"), (0, "600002"), (1, "600004"), (1, "600005")]

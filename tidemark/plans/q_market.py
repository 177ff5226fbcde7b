"""Indicators, screener, market table and backtest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import backtest as K
from ..operators import bars as B
from ..operators import indicators as I
from ..operators import market as M
from ..session import materialize
from .fixtures import duck
from .registry import query

BOARD = """CASE WHEN stock_code LIKE '300%' OR stock_code LIKE '301%' THEN '创业板' WHEN stock_code LIKE '688%' THEN '科创板'
 WHEN stock_code LIKE '4%' OR stock_code LIKE '8%' OR stock_code LIKE '920%' THEN '北交所'
 WHEN LEFT(stock_code, 3) IN ('600','601','603','605','000','001','002','003') THEN '主板' ELSE '其他' END"""


def num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def step(value: str, before: str, period: int) -> str:
    """One step of an exponential average, in the order alpha * value + keep * level."""
    alpha = 2 / (period + 1)
    return f"({num(alpha)} * {value} + {num(1 - alpha)} * {before})"


B0 = """b AS (SELECT stock_id, trade_date, CAST(open AS DOUBLE) AS o, CAST(high AS DOUBLE) AS h, CAST(low AS DOUBLE) AS l,
  CAST(close AS DOUBLE) AS c, CAST(volume AS DOUBLE) AS v,
  ROW_NUMBER() OVER (PARTITION BY stock_id ORDER BY trade_date) AS bar FROM {src}),
p AS (SELECT *, (3 * c + h + l + o) / 6 AS price FROM b)"""
EMAS = (5, 6, 10, 18, 20, 60)
MOM = "CASE WHEN {s} = 0 THEN 0 ELSE 500 * ({f} - {s}) / {s} END"


def averages(extra: int | None = None) -> str:
    """Recursive averages over bar numbers (`r`), joined back to the bars (`a`)."""
    names = [*EMAS] + ([extra] if extra and extra not in EMAS else [])
    first = ", ".join(f"c AS e{n}" for n in names)
    nxt = ", ".join(f"{step('p.c', f'r.e{n}', n)} AS e{n}" for n in names)
    mom = MOM.format(f="e6", s="e18")
    cols = ", ".join(f"e{n}" for n in names)
    return f"""r AS (
  SELECT stock_id, bar, price AS e35, price AS q2, price AS t0, {first}, CAST(0 AS DOUBLE) AS mom, CAST(0 AS DOUBLE) AS ms FROM p WHERE bar = 1
  UNION ALL
  SELECT stock_id, bar, e35, q2, {step('q2', 't_', 2)} AS t0, {cols}, m_ AS mom, {step('m_', 'ms_', 3)} AS ms FROM (
    SELECT *, {mom} AS m_ FROM (
      SELECT p.stock_id, p.bar, {step('p.price', 'r.e35', 35)} AS e35, {step('p.price', 'r.q2', 2)} AS q2,
             r.t0 AS t_, r.ms AS ms_, {nxt}
      FROM r JOIN p ON p.stock_id = r.stock_id AND p.bar = r.bar + 1) x) y),
a AS (SELECT p.*, r.* EXCLUDE (stock_id, bar) FROM p JOIN r USING (stock_id, bar))"""


def frame(n: int) -> str:
    return f"(PARTITION BY stock_id ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = "(PARTITION BY stock_id ORDER BY trade_date)"


def points(vr: float = 4.0, dev: float = 1.18, same_day: bool = False) -> str:
    recent = "braw" if same_day else f"BOOL_OR(braw) OVER {frame(3)}"
    return f"""l1 AS (SELECT *, (MIN(e35) OVER {frame(10)} + MIN(e35) OVER {frame(30)} + MIN(e35) OVER {frame(90)}) / 3 AS l1 FROM a),
f AS (SELECT *, (MIN(l1) OVER {frame(5)} + MIN(l1) OVER {frame(15)} + MIN(l1) OVER {frame(30)}) / 3 AS l2,
  CASE WHEN AVG(v) OVER {frame(5)} = 0 THEN 0 ELSE v / (AVG(v) OVER {frame(5)}) END AS ratio,
  CASE WHEN SUM(v) OVER {frame(20)} = 0 THEN 0 ELSE SUM(v * (2 * c - h - l) / GREATEST(h - l, 0.01::DOUBLE)) OVER {frame(20)} / SUM(v) OVER {frame(20)} END AS cmf,
  MAX(h) OVER (PARTITION BY stock_id ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ph FROM l1),
g AS (SELECT *, COALESCE(t0 > l2 AND mom > 0 AND mom > ms AND ms > LAG(ms) OVER {W}, FALSE) AS trend,
  COALESCE(c > ph AND c > o AND ratio > 1.5 AND ratio < {num(vr)} AND e5 > e10 AND e10 > e20 AND e20 > e60 AND c / e20 < {num(dev)}, FALSE) AS braw,
  COALESCE(cmf > 0.05 AND cmf > LAG(cmf) OVER {W} AND c > e20 AND e20 > LAG(e20) OVER {W}, FALSE) AS flow FROM f),
g2 AS (SELECT *, {recent} AS breakout FROM g),
g3 AS (SELECT *, bar > 130 AND trend AND breakout AND flow AS active FROM g2),
z AS (SELECT *, active AND NOT COALESCE(LAG(active) OVER {W}, FALSE) AS signal FROM g3)"""


def zz(body: str, src: str = "f_bars", names=("bars",), extra: int | None = None, more: str = "", **params) -> str:
    return duck(f"WITH RECURSIVE {more}{B0.format(src=src)},\n{averages(extra)},\n{points(**params)}\n{body}", *names,
                recursive=True)


def ez(body: str) -> str:
    return duck(f"WITH RECURSIVE {B0.format(src='f_bars')},\n{averages()}\n{body}", "bars", recursive=True)


def rounded(df, places: int, *names: str):
    return df.withColumns({n: F.round(n, places) for n in names})


# -- indicators ---------------------------------------------------------------

@query("w1_ema", ez("SELECT stock_id, trade_date, ROUND(e6, 6) AS e6, ROUND(e60, 6) AS e60, ROUND(t0, 6) AS t0 FROM a"))
def _(t):
    rows = I.ema(t.bars.select("stock_id", "trade_date", "open", "high", "low", "close")
                 .withColumn("price", I.typical_price()),
                 {"e6": ("close", (6,)), "e60": ("close", (60,)), "t0": ("price", (2, 2))})
    return rounded(rows.select("stock_id", "trade_date", "e6", "e60", "t0"), 6, "e6", "e60", "t0")


@query("w2_rolling_extremes", duck(f"""
SELECT stock_id, trade_date, MIN(CAST(low AS DOUBLE)) OVER {frame(20)} AS min_20, MAX(CAST(low AS DOUBLE)) OVER {frame(20)} AS max_20 FROM f_bars""", "bars"))
def _(t):
    return B.rolling(t.bars, "low", 20, ("min", "max")).select("stock_id", "trade_date", "min_20", "max_20")


@query("w3_rolling_sum_mean", duck(f"""
SELECT stock_id, trade_date, SUM(CAST(volume AS DOUBLE)) OVER {frame(5)} AS sum_5, ROUND(AVG(CAST(volume AS DOUBLE)) OVER {frame(5)}, 9) AS avg_5 FROM f_bars""", "bars"))
def _(t):
    return rounded(B.rolling(t.bars, "volume", 5, ("sum", "avg")).select("stock_id", "trade_date", "sum_5", "avg_5"), 9, "avg_5")


@query("w4_typical_price", duck(f"WITH {B0.format(src='f_bars')} SELECT stock_id, trade_date, ROUND(price, 9) AS price FROM p", "bars"))
def _(t):
    return t.bars.select("stock_id", "trade_date", F.round(I.typical_price(), 9).alias("price"))


@query("w5_floor_lines", ez(f"""SELECT stock_id, trade_date, ROUND(l1, 6) AS l1,
ROUND((MIN(l1) OVER {frame(5)} + MIN(l1) OVER {frame(15)} + MIN(l1) OVER {frame(30)}) / 3, 6) AS l2 FROM
(SELECT *, (MIN(e35) OVER {frame(10)} + MIN(e35) OVER {frame(30)} + MIN(e35) OVER {frame(90)}) / 3 AS l1 FROM a) q"""))
def _(t):
    slim = t.bars.select("stock_id", "trade_date", "open", "high", "low", "close").withColumn("price", I.typical_price())
    rows = I.floor_lines(I.ema(slim, {"e35": ("price", (35,))}))
    return rounded(rows.select("stock_id", "trade_date", "l1", "l2"), 6, "l1", "l2")


@query("w6_fast_line", ez("SELECT stock_id, trade_date, ROUND(t0, 6) AS t0 FROM a"))
def _(t):
    slim = t.bars.select("stock_id", "trade_date", "open", "high", "low", "close")
    return rounded(I.fast_line(slim).select("stock_id", "trade_date", "t0"), 6, "t0")


@query("w7_momentum", ez("SELECT stock_id, trade_date, ROUND(mom, 6) AS mom, ROUND(ms, 6) AS mom_signal FROM a"))
def _(t):
    return rounded(I.momentum_lines(t.bars), 6, "mom", "mom_signal")


@query("w8_ema_stack", ez("SELECT stock_id, trade_date, e5 > e10 AND e10 > e20 AND e20 > e60 AS stacked FROM a"))
def _(t):
    return I.ema_stack(t.bars.select("stock_id", "trade_date", "close")).select("stock_id", "trade_date", "stacked")


@query("w9_volume_ratio", zz("SELECT stock_id, trade_date, ROUND(ratio, 4) AS volume_ratio FROM f"))
def _(t):
    return I.volume_ratio(t.bars).select("stock_id", "trade_date", F.round("ratio_raw", 4).alias("volume_ratio"))


@query("w10_money_flow", zz("SELECT stock_id, trade_date, ROUND(cmf, 6) AS cmf FROM f"))
def _(t):
    return I.money_flow(t.bars).select("stock_id", "trade_date", F.round("cmf_raw", 6).alias("cmf"))


@query("w11_trend", zz("SELECT stock_id, trade_date, trend FROM g"))
def _(t):
    return I.features(t.bars).select("stock_id", "trade_date", "trend")


@query("w12_breakout", zz("SELECT stock_id, trade_date, braw AS breakout_raw, breakout, ROUND(ph, 6) AS breakout_level FROM g2"))
def _(t):
    return I.breakout(I.features(t.bars)).select("stock_id", "trade_date", "breakout_raw", "breakout",
                                                 F.round("prior_high", 6).alias("breakout_level"))


@query("w12_breakout_same_day", zz("SELECT stock_id, trade_date, breakout, signal FROM z", vr=6.0, dev=1.05, same_day=True))
def _(t):
    return I.zzr(t.bars, 6.0, 1.05, True).select("stock_id", "trade_date", "breakout", "signal")


@query("w13_money_flow_condition", zz("SELECT stock_id, trade_date, flow AS money_flow_up FROM g"))
def _(t):
    return I.features(t.bars).select("stock_id", "trade_date", "money_flow_up")


POINT = """trend, breakout, flow AS money_flow_up, active, signal, ROUND(mom, 6) AS mom, ROUND(ms, 6) AS mom_signal,
ROUND(cmf, 6) AS cmf, ROUND(ratio, 4) AS volume_ratio, ROUND(ph, 6) AS breakout_level"""
POINTS = ("trend", "breakout", "money_flow_up", "active", "signal", "mom", "mom_signal", "cmf", "volume_ratio",
          "breakout_level")


@query("w14_zzr", zz(f"SELECT stock_id, trade_date, {POINT} FROM z"))
def _(t):
    """Bars of another adjustment lie in the table as well and must not matter."""
    other = t.bars.filter("stock_id % 3 = 0").withColumns({"adjust_type": F.lit("hfq"), **{n: (F.col(n) * 2).cast(t.bars.schema[n].dataType) for n in ("open", "high", "low", "close")}})
    return I.zzr(t.bars.unionByName(other)).select("stock_id", "trade_date", *POINTS)


@query("w15_zzr_screen", zz(f"""SELECT s.stock_code, s.stock_name, {BOARD} AS market, z.trade_date AS signal_date, z.c AS close, {POINT}
FROM z JOIN f_stocks s ON s.id = z.stock_id WHERE signal""", names=("bars", "stocks")))
def _(t):
    """The screen of every date at once: all signals, joined to their stocks."""
    named = t.stocks.select(F.col("id").alias("stock_id"), "stock_code", "stock_name")
    return (I.zzr(t.bars, adjust="qfq").filter("signal").join(named, "stock_id")
            .select("stock_code", "stock_name", C.market_of(F.col("stock_code")).alias("market"),
                    F.col("trade_date").alias("signal_date"), "close", *POINTS))


@query("w15_zzr_screen_page", zz(f"""SELECT s.stock_code, z.trade_date AS signal_date, z.c AS close, ROUND(cmf, 6) AS cmf, ROUND(mom, 6) AS mom,
 COUNT(*) OVER () AS total FROM z JOIN f_stocks s ON s.id = z.stock_id
WHERE signal AND z.trade_date IN (DATE '1997-12-06', DATE '1996-03-01', DATE '1998-01-15')
ORDER BY ROUND(cmf, 6) DESC, ROUND(mom, 6) DESC, s.stock_code, z.trade_date LIMIT 20""", names=("bars", "stocks")))
def _(t):
    found = M.zzr_screen(t.bars, t.stocks, ["1997-12-06", "1996-03-01", "1998-01-15"])
    return M.paginate(found.select("stock_code", "signal_date", "close", "cmf", "mom"), M.screen_order(), 1, 20)


@query("w16_quote_history", zz(f"""SELECT stock_id, trade_date, c AS close, ROUND(pct, 6) AS change_pct, {POINT},
 CAST(SUM(CASE WHEN signal THEN 1 ELSE 0 END) OVER (PARTITION BY stock_id) AS BIGINT) AS zzr_signal_count
FROM (SELECT *, (c / LAG(c) OVER {W} - 1) * 100 AS pct, ROW_NUMBER() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS rn FROM z) q WHERE rn <= 250""",
    src="(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS rk FROM f_bars) n WHERE rk <= 251)"))
def _(t):
    rows = M.quote_history(t.bars, 250)
    return rounded(rows.select("stock_id", "trade_date", "close", "change_pct", *POINTS, "zzr_signal_count"), 6, "change_pct")


CANDLE = """SELECT stock_id, MAX(trade_date) AS trade_date, CAST(ARG_MIN(open, trade_date) AS DOUBLE) AS open, CAST(MAX(high) AS DOUBLE) AS high,
 CAST(MIN(low) AS DOUBLE) AS low, CAST(ARG_MAX(close, trade_date) AS DOUBLE) AS close, CAST(SUM(volume) AS DOUBLE) AS volume, COUNT(*) AS bars,
 ROUND((CAST(ARG_MAX(close, trade_date) AS DOUBLE) / CAST(ARG_MIN(open, trade_date) AS DOUBLE) - 1) * 100, 6) AS change_pct{more}
FROM {src} GROUP BY stock_id, candle"""
OHLC = ("open", "high", "low", "close", "volume")


@query("w17_resample_5", duck(CANDLE.format(more="", src=f"(SELECT *, (ROW_NUMBER() OVER {W} - 1) // 5 AS candle FROM f_bars) q"), "bars"))
def _(t):
    rows = B.resample_bars(t.bars, 5).withColumns({c: F.col(c).cast("double") for c in OHLC})
    return rounded(rows, 6, "change_pct")


@query("w17_resample_20_flags", zz("""SELECT stock_id, MAX(trade_date) AS trade_date, COUNT(*) AS bars, BOOL_OR(trend) AS trend, BOOL_OR(breakout) AS breakout,
 BOOL_OR(flow) AS money_flow_up, BOOL_OR(signal) AS signal FROM (SELECT *, (bar - 1) // 20 AS candle FROM z) q GROUP BY stock_id, candle"""))
def _(t):
    flags = ("trend", "breakout", "money_flow_up", "signal")
    return B.resample_bars(I.zzr(t.bars), 20, flags).select("stock_id", "trade_date", "bars", *flags)


@query("w17_month_to_date", duck("""
SELECT stock_id, trade_date, CAST(close AS DOUBLE) AS close FROM
(SELECT *, MAX(trade_date) OVER (PARTITION BY stock_id) AS last FROM f_bars) q WHERE DATE_TRUNC('month', trade_date) = DATE_TRUNC('month', last)""", "bars"))
def _(t):
    return B.resample_bars(t.bars, "mtd").select("stock_id", "trade_date", F.col("close").cast("double").alias("close"))


@query("w17_year_to_date", duck("""
SELECT stock_id, trade_date, CAST(close AS DOUBLE) AS close FROM
(SELECT *, MAX(trade_date) OVER (PARTITION BY stock_id) AS last FROM f_bars) q WHERE YEAR(trade_date) = YEAR(last)""", "bars"))
def _(t):
    return B.resample_bars(t.bars, "ytd").select("stock_id", "trade_date", F.col("close").cast("double").alias("close"))


# -- market table --------------------------------------------------------------

LIST = ("stock_code", "stock_name", "market", "latest_date", "current_price", "change_pct", "volume", "turnover_rate")


def list_sql(n: int, where: str = "TRUE") -> str:
    return f"""WITH n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS rn FROM f_bars),
ml AS (SELECT s.stock_code, s.stock_name, {BOARD} AS market, a.trade_date AS latest_date, CAST(a.close AS DOUBLE) AS current_price,
 ROUND((CAST(a.close AS DOUBLE) / CAST(b.close AS DOUBLE) - 1) * 100, 9) AS change_pct, CAST(a.volume AS DOUBLE) AS volume, CAST(a.turnover_rate AS DOUBLE) AS turnover_rate
FROM f_stocks s LEFT JOIN n a ON a.stock_id = s.id AND a.rn = 1 LEFT JOIN n b ON b.stock_id = s.id AND b.rn = {n + 1} WHERE {where})"""


for _n in (1, 20, 60):
    @query(f"l1_market_list_{_n}d", duck(list_sql(_n) + " SELECT * FROM ml", "bars", "stocks"))
    def _(t, n=_n):
        return rounded(M.market_list(t.bars, t.stocks, f"{n}d"), 9, "change_pct")


@query("l1_market_list_filtered", duck(list_sql(5, "stock_code LIKE '688%' AND (stock_code ILIKE '%1%' OR stock_name ILIKE '%1%')") + " SELECT * FROM ml", "bars", "stocks"))
def _(t):
    return rounded(M.market_list(t.bars, t.stocks, "5d", needle="1", market="star"), 9, "change_pct")


for _p, _unit in (("mtd", "month"), ("ytd", "year")):
    @query(f"l2_market_list_{_p}", duck(f"""WITH d AS (SELECT MAX(b.trade_date) AS newest FROM f_bars b JOIN f_stocks s ON s.id = b.stock_id),
n AS (SELECT stock_id, MAX(trade_date) AS latest_date, ARG_MAX(close, trade_date) AS c, ARG_MAX(volume, trade_date) AS v, ARG_MAX(turnover_rate, trade_date) AS tr,
  ARG_MIN(close, trade_date) FILTER (WHERE trade_date >= DATE_TRUNC('{_unit}', newest)) AS base FROM f_bars CROSS JOIN d GROUP BY 1)
SELECT s.stock_code, s.stock_name, {BOARD} AS market, latest_date, CAST(c AS DOUBLE) AS current_price,
 ROUND((CAST(c AS DOUBLE) / CAST(base AS DOUBLE) - 1) * 100, 9) AS change_pct, CAST(v AS DOUBLE) AS volume, CAST(tr AS DOUBLE) AS turnover_rate
FROM f_stocks s LEFT JOIN n ON n.stock_id = s.id""", "bars", "stocks"))
    def _(t, p=_p):
        return rounded(M.market_list(t.bars, t.stocks, p), 9, "change_pct")


for _d in ("desc", "asc"):
    @query(f"l3_market_page_{_d}", duck(list_sql(10) + f""" SELECT stock_code, change_pct, (SELECT COUNT(*) FROM ml) AS total FROM ml
ORDER BY change_pct {_d} NULLS LAST, stock_code, stock_name LIMIT 20 OFFSET 20""", "bars", "stocks"))
    def _(t, d=_d):
        rows = rounded(M.market_list(t.bars, t.stocks, "10d"), 9, "change_pct").select("stock_code", "stock_name", "change_pct")
        return M.paginate(rows, M.by_change(d == "desc"), 2, 20).select("stock_code", "change_pct", "total")


@query("l4_search_stocks", duck(f"""SELECT stock_code, stock_name, {BOARD} AS market FROM f_stocks
WHERE LEFT(stock_code, 3) IN ('300','301') AND (stock_code ILIKE '%2%' OR stock_name ILIKE '%2%') ORDER BY stock_code LIMIT 20""", "stocks"))
def _(t):
    return M.search_stocks(t.stocks, "2", "gem", 20)


@query("f1_market_of", duck(f"SELECT id, stock_code, {BOARD} AS market FROM f_stocks", "stocks"))
def _(t):
    return t.stocks.select("id", "stock_code", C.market_of(F.col("stock_code")).alias("market"))


@query("f2_market_filter", duck("""SELECT id, TRUE AS in_all, LEFT(stock_code, 3) IN ('600','601','603','605','000','001','002','003') AS in_main,
 LEFT(stock_code, 3) IN ('300','301') AS in_gem, LEFT(stock_code, 3) = '688' AS in_star,
 LEFT(stock_code, 1) IN ('4','8') OR LEFT(stock_code, 3) = '920' AS in_bse FROM f_stocks""", "stocks"))
def _(t):
    return t.stocks.select("id", *[C.market_filter(F.col("stock_code"), m).alias(f"in_{m}")
                                   for m in ("all", "main", "gem", "star", "bse")])


@query("f3_is_excluded", duck("""SELECT id, UPPER(stock_name) LIKE 'ST%' OR UPPER(stock_name) LIKE '*ST%' OR stock_name LIKE '%退市%' OR stock_code LIKE '68900%' AS excluded
FROM f_stocks""", "stocks"))
def _(t):
    return t.stocks.select("id", C.is_excluded(F.col("stock_name"), F.col("stock_code")).alias("excluded"))


@query("f10_exchange_of", duck("SELECT id, CASE WHEN LEFT(stock_code, 1) = '6' THEN 'SH' ELSE 'SZ' END AS exchange FROM f_stocks", "stocks"))
def _(t):
    return t.stocks.select("id", "exchange")


@query("j9_period_baseline", duck("""
SELECT stock_id, YEAR(trade_date) AS year, MIN(trade_date) AS base_date, CAST(ARG_MIN(close, trade_date) AS DOUBLE) AS base_close FROM f_bars GROUP BY 1, 2""", "bars"))
def _(t):
    first = F.min(F.struct("trade_date", "close"))
    return (t.bars.groupBy("stock_id", F.year("trade_date").cast("bigint").alias("year")).agg(first.alias("f"))
            .select("stock_id", "year", F.col("f.trade_date").alias("base_date"),
                    F.col("f.close").cast("double").alias("base_close")))


# -- backtest -------------------------------------------------------------------

def trades_sql(hold: int = 10, stop: float = -0.07, exit_ema: int | None = None, start: str = "1900-01-01",
               end: str = "2999-12-31") -> str:
    stopped = f"b.l <= s.entry * {num(1 + stop)}" if stop else "FALSE"
    sell = f"LEAST(b.o, s.entry * {num(1 + stop)})" if stop else "0"
    under = f"b.c < b.e{exit_ema}" if exit_ema else "FALSE"
    return f"""n AS (SELECT *, LEAD(o) OVER {W} AS entry, LEAD(trade_date) OVER {W} AS entry_date, COUNT(*) OVER (PARTITION BY stock_id) AS total FROM z),
sg AS (SELECT stock_id, bar AS i, trade_date AS signal_date, entry, entry_date FROM n
  WHERE signal AND total >= 131 AND entry > 0 AND trade_date BETWEEN DATE '{start}' AND DATE '{end}'),
hb AS (SELECT s.*, b.bar - s.i - 1 AS held, b.trade_date AS exit_date,
  CASE WHEN {stopped} THEN {sell} WHEN {under} THEN b.c WHEN b.bar = s.i + 1 + {hold} OR b.bar = b.total THEN b.o END AS exit,
  CASE WHEN {stopped} THEN 'stop' WHEN {under} THEN 'ema_exit' WHEN b.bar = s.i + 1 + {hold} THEN 'time' WHEN b.bar = b.total THEN 'data_end' END AS reason
  FROM sg s JOIN n b ON b.stock_id = s.stock_id AND b.bar BETWEEN s.i + 2 AND s.i + 1 + {hold}),
tr AS (SELECT stock_id, signal_date, entry_date, exit_date, entry, exit, exit / entry - 1 AS ret, reason, held FROM
  (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_id, i ORDER BY held) AS k FROM hb WHERE reason IS NOT NULL) q WHERE k = 1)"""


TRADE = ("stock_id", "signal_date", "entry_date", "exit_date", "entry", "exit", "return", "reason", "held")
TRADES = """SELECT stock_id, signal_date, entry_date, exit_date, entry, ROUND(exit, 6) AS exit, ROUND(ret, 9) AS "return", reason, held FROM tr"""


def bt(body: str, exit_ema: int | None = None, vr: float = 4.0, dev: float = 1.18, same_day: bool = False, **kw) -> str:
    text = zz("@@", extra=exit_ema, vr=vr, dev=dev, same_day=same_day)
    return text.replace("\n@@", f",\n{trades_sql(exit_ema=exit_ema, **kw)}\n{body}")


def trade_view(df):
    return df.select(*TRADE).withColumns({"exit": F.round("exit", 6), "return": F.round("return", 9)})


@query("b1_backtest", bt(TRADES))
def _(t):
    return trade_view(K.backtest(t.bars))


@query("b1_backtest_ema_exit", bt(TRADES, exit_ema=10, hold=15, stop=0, start="1994-01-01", end="1997-12-31"))
def _(t):
    return trade_view(K.backtest(t.bars, [{"hold": 15, "stop": 0.0}], exit_ema=10, start="1994-01-01", end="1997-12-31"))


SWEEP = [{}, {"volume_ratio_max": 6.0, "deviation_max": 1.05}, {"same_day": True, "hold": 5, "stop": -0.03}]


def _sweep_sql() -> str:
    parts = [bt(f'SELECT CAST({i} AS INT) AS setting, q.* FROM ({TRADES}) q', vr=s.get("volume_ratio_max", 4.0),
                dev=s.get("deviation_max", 1.18), same_day=s.get("same_day", False), hold=s.get("hold", 10),
                stop=s.get("stop", -0.07)) for i, s in enumerate(SWEEP)]
    return " UNION ALL ".join(f"SELECT * FROM ({p}) u{i}" for i, p in enumerate(parts))


@query("b2_parameter_sweep", _sweep_sql())
def _(t):
    df = K.backtest(t.bars, SWEEP)
    return df.select("setting", *TRADE).withColumns({"exit": F.round("exit", 6), "return": F.round("return", 9)})


@query("b1_signal_count", bt("SELECT COUNT(*) AS signals FROM sg"))
def _(t):
    return K.signal_count(K.signals(t.bars)).select("signals")


@query("j8_holding_window", bt("""SELECT stock_id, signal_date, COUNT(*) AS bars, MIN(l) AS lowest FROM
 (SELECT s.stock_id, s.signal_date, b.l FROM sg s JOIN n b ON b.stock_id = s.stock_id AND b.bar BETWEEN s.i + 2 AND s.i + 11) q GROUP BY 1, 2"""))
def _(t):
    points = K.signals(t.bars)
    opened = F.when(K.entry_rule(), F.struct(F.col("trade_date").alias("signal_date")))
    rows = points.withColumn("o", opened).withColumn(
        "covering", F.collect_list("o").over(B.by_stock().rowsBetween(-11, -2))).filter(F.size("covering") > 0)
    return (rows.select("stock_id", "low", F.inline("covering")).groupBy("stock_id", "signal_date")
            .agg(F.count(F.lit(1)).alias("bars"), F.min("low").alias("lowest")))


@query("a10_trade_summary", bt("""SELECT COUNT(*) AS trades, ROUND(AVG(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 9) AS win_rate, ROUND(AVG(ret), 9) AS mean_return,
 ROUND(MEDIAN(ret), 9) AS median_return, ROUND(MAX(ret), 9) AS best, ROUND(MIN(ret), 9) AS worst,
 ROUND(SUM(CASE WHEN ret > 0 THEN ret ELSE 0 END) / ABS(SUM(CASE WHEN ret <= 0 THEN ret END)), 9) AS profit_factor, ROUND(AVG(held), 9) AS mean_held FROM tr"""))
def _(t):
    names = ("win_rate", "mean_return", "median_return", "best", "worst", "profit_factor", "mean_held")
    return rounded(K.trade_summary(K.backtest(t.bars)), 9, *names)


@query("a11_trades_by_reason", bt("SELECT reason, COUNT(*) AS trades, ROUND(AVG(ret), 9) AS mean_return FROM tr GROUP BY 1"))
def _(t):
    return rounded(K.trades_by_reason(K.backtest(t.bars)), 9, "mean_return")


@query("a11_reasons_by_count", bt("SELECT reason, COUNT(*) AS trades, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, reason) AS place FROM tr GROUP BY 1"))
def _(t):
    rows = K.trades_by_reason(K.backtest(t.bars))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*K.by_count())).cast("bigint")).select("reason", "trades", "place")


@query("a10_entries", bt("SELECT (SELECT COUNT(*) FROM sg) AS entries, COUNT(*) AS trades FROM tr"))
def _(t):
    rows = materialize(K.held_bars(K.signals(t.bars)))  # few of all bars; trades and entries come from one pass
    return K.trade_summary(K.trades_of(rows), K.signal_count(rows)).select("entries", "trades")


@query("w15_scanned", zz(f"""SELECT s.stock_code, z.trade_date AS signal_date, ROUND(cmf, 6) AS cmf, (SELECT COUNT(*) FROM f_stocks) AS scanned
FROM z JOIN f_stocks s ON s.id = z.stock_id WHERE signal AND z.trade_date IN (DATE '1996-09-04', DATE '1996-10-25', DATE '1997-02-24', DATE '1997-12-06', DATE '1996-03-01', DATE '1998-01-15')""", names=("bars", "stocks")))
def _(t):
    return M.zzr_screen(t.bars, t.stocks, ["1996-09-04", "1996-10-25", "1997-02-24", "1997-12-06", "1996-03-01", "1998-01-15"]).select(
        "stock_code", "signal_date", F.round("cmf", 6).alias("cmf"), "scanned")


@query("a12_trades_by_year", bt("""SELECT YEAR(signal_date) AS year, COUNT(*) AS trades, ROUND(AVG(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 9) AS win_rate,
 ROUND(AVG(ret), 9) AS mean_return FROM tr GROUP BY 1"""))
def _(t):
    rows = K.trades_by_year(K.backtest(t.bars))
    return rounded(rows.withColumn("year", F.col("year").cast("bigint")), 9, "win_rate", "mean_return")


@query("a13_extreme_trades", bt("""SELECT * FROM (SELECT 'worst' AS side, stock_id, signal_date, ROUND(ret, 9) AS "return", reason FROM tr ORDER BY ret, stock_id, signal_date LIMIT 5) a
UNION ALL SELECT * FROM (SELECT 'best' AS side, stock_id, signal_date, ROUND(ret, 9) AS "return", reason FROM tr ORDER BY ret DESC, stock_id, signal_date LIMIT 5) b"""))
def _(t):
    rows = K.extreme_trades(K.backtest(t.bars)).select("side", "stock_id", "signal_date", "return", "reason")
    return rounded(rows, 9, "return")

"""Market table, screener, history view and stock search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import market_filter, market_of
from ..session import materialize
from .bars import adjusted, by_stock, latest_bars
from .indicators import zzr

PERIODS = {"1d": 1, "3d": 3, "5d": 5, "10d": 10, "20d": 20, "60d": 60}


def select_stocks(stocks: DataFrame, needle: str = "", market: str = "all", escape: bool = False) -> DataFrame:
    """Stocks of a board whose code or name contains `needle` (any case). `%` and `_`
    act as wildcards unless `escape` is set."""
    chosen = stocks.filter(market_filter(F.col("stock_code"), market))
    text = needle.strip()
    if text:
        pattern = f"%{like_text(text, escape)}%"
        chosen = chosen.filter(F.col("stock_code").ilike(pattern) | F.col("stock_name").ilike(pattern))
    return chosen


def like_text(text: str, escape: bool) -> str:
    if not escape:
        return text
    return text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")


def search_stocks(stocks: DataFrame, needle: str = "", market: str = "all", limit: int = 20) -> DataFrame:
    found = select_stocks(stocks, needle, market)
    return found.orderBy("stock_code").limit(limit).select(
        "stock_code", "stock_name", market_of(F.col("stock_code")).alias("market"))


def market_list(bars: DataFrame, stocks: DataFrame, period: str = "1d", needle: str = "", market: str = "all",
                adjust: str = "qfq") -> DataFrame:
    """Newest price and period change of every chosen stock, stocks without bars included.

    `nd`: against the close n bars earlier. `mtd` / `ytd`: against the first close inside
    the month or year of the newest date over all chosen stocks.
    """
    chosen = select_stocks(stocks, needle, market).select("id", "stock_code", "stock_name")
    own = adjusted(bars, adjust).join(chosen.select(F.col("id").alias("stock_id")), "stock_id", "left_semi")
    if period in PERIODS:
        n = PERIODS[period]
        recent = latest_bars(own.select("stock_id", "trade_date", "close", "volume", "turnover_rate"), n + 1)
        base = F.max(F.when(F.col("rn") == n + 1, F.col("close")))
        newest = F.col("rn") == 1
        figures = recent.groupBy("stock_id").agg(
            F.max(F.when(newest, F.struct("trade_date", "close", "volume", "turnover_rate"))).alias("last"),
            base.alias("base"))
    else:
        newest_day = own.agg(F.max("trade_date").alias("d")).scalar()
        start = F.trunc("_newest", "month" if period == "mtd" else "year")
        inside = (F.col("trade_date") >= start) & (F.col("trade_date") <= F.col("_newest"))
        last = F.max_by(F.struct("trade_date", "close", "volume", "turnover_rate"), F.col("trade_date"))
        figures = own.withColumn("_newest", newest_day).groupBy("stock_id").agg(
            last.alias("last"),
            F.min(F.when(inside, F.struct("trade_date", "close"))).alias("first"))
        figures = figures.withColumn("base", F.col("first.close")).drop("first")
    change = F.when(F.col("base") != 0, (F.col("last.close").cast("double") / F.col("base").cast("double") - 1) * 100)
    return (chosen.join(figures.withColumnRenamed("stock_id", "id"), "id", "left").select(
        "stock_code", "stock_name", market_of(F.col("stock_code")).alias("market"),
        F.col("last.trade_date").alias("latest_date"), F.col("last.close").cast("double").alias("current_price"),
        change.alias("change_pct"),
        F.when(F.col("last").isNotNull(), F.coalesce(F.col("last.volume").cast("double"), F.lit(0.0))).alias("volume"),
        F.when(F.col("last").isNotNull(), F.coalesce(F.col("last.turnover_rate").cast("double"), F.lit(0.0)))
        .alias("turnover_rate")))


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = 100) -> DataFrame:
    """One page of an ordered list with the total on every row. The list is written once and read for both, so what it comes
    from is computed once; hand in narrow rows."""
    df = materialize(df)
    total = df.count()
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.withColumn("total", F.lit(total).cast("bigint"))


def by_change(descending: bool = True) -> list[Column]:
    key = F.col("change_pct").desc_nulls_last() if descending else F.col("change_pct").asc_nulls_last()
    return [key, F.col("stock_code"), F.col("stock_name")]


def zzr_screen(bars: DataFrame, stocks: DataFrame, dates: list[str] | None = None, market: str = "all",
               adjust: str = "qfq", **params) -> DataFrame:
    """Signals on the given dates (the newest date by default) over the full history up to them, with `scanned`, the number
    of stocks looked at.

    Nothing looks ahead, so the points of one pass serve any number of dates, and bars after the last of them are not
    read.
    """
    chosen = stocks.filter(market_filter(F.col("stock_code"), market)).select("id", "stock_code", "stock_name")
    own = adjusted(bars, adjust).join(chosen.select(F.col("id").alias("stock_id")), "stock_id", "left_semi")
    if dates:
        wanted = [F.lit(d).cast("date") for d in dates]
        points = zzr(own.filter(F.col("trade_date") <= F.greatest(wanted[0], *wanted)), **params).filter("signal")
        points = points.filter(F.col("trade_date").isin(*wanted))
    else:
        points = zzr(own, **params).filter("signal")
        points = points.filter(F.col("trade_date") == own.agg(F.max("trade_date").alias("d")).scalar())
    scanned = chosen.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (points.join(chosen.withColumnRenamed("id", "stock_id"), "stock_id")
            .withColumns({"market": market_of(F.col("stock_code")), "scanned": scanned})
            .select("stock_code", "stock_name", "market", F.col("trade_date").alias("signal_date"), "close",
                    "trend", "breakout", "money_flow_up", "active", "signal", "mom", "mom_signal", "cmf",
                    "volume_ratio", "breakout_level", "scanned"))


def screen_order() -> list[Column]:
    return [F.desc("cmf"), F.desc("mom"), F.asc("stock_code"), F.asc("signal_date")]


def quote_history(bars: DataFrame, limit: int = 500, codes: DataFrame | None = None, adjust: str = "qfq",
                  **params) -> DataFrame:
    """The last `limit` bars per stock with the change to the bar before, and the signal
    computed over the loaded bars only (the one extra older bar included)."""
    own = adjusted(bars, adjust)
    if codes is not None:
        own = own.join(codes.select(F.col("id").alias("stock_id")), "stock_id", "left_semi")
    loaded = latest_bars(own, limit + 1)
    w = by_stock()
    before = F.lag("close").over(w)
    points = zzr(loaded, **params).withColumn(
        "change_pct", F.when(before != 0, (F.col("close") / before - 1) * 100))
    shown = points.filter(F.col("rn") <= limit)
    return shown.withColumn("zzr_signal_count", F.count_if("signal").over(Window.partitionBy("stock_id")))



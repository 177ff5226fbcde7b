"""Trades that follow a signal. The walk over a holding window needs no join: every
bar gathers the (few) signals whose window covers it from a bounded frame, and the
first exit per signal is an aggregation on the stock's existing partitioning. A sweep
over settings shares the averages and the shuffle; only flags and exits are repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bars import STOCK, adjusted, by_stock
from .indicators import DEVIATION_MAX, VOLUME_RATIO_MAX, WARM_UP, features, fire

DEFAULT_SETTING = {"volume_ratio_max": VOLUME_RATIO_MAX, "deviation_max": DEVIATION_MAX, "same_day": False,
                   "hold": 10, "stop": -0.07}
SWEPT = ("stock_id", "setting")


def signals(bars: DataFrame, settings: list[dict] | None = None, exit_ema: int | None = None,
            adjust: str | None = "qfq") -> DataFrame:
    """Signal points per setting, with what a trade needs to start: next open, next day, bar count. Bars of other
    adjustments than `adjust` are left out, so that no window mixes them."""
    if adjust and "adjust_type" in bars.columns:
        bars = adjusted(bars, adjust)
    bars = bars.select("stock_id", "trade_date", "open", "high", "low", "close", "volume")  # others would be packed as well
    chosen = [{**DEFAULT_SETTING, **s} for s in (settings or [{}])]
    types = {"volume_ratio_max": "double", "deviation_max": "double", "same_day": "boolean", "hold": "int",
             "stop": "double"}
    variants = F.array(*[F.struct(F.lit(i).alias("setting"), *[
        F.lit(s[name]).cast(kind).alias(name) for name, kind in types.items()]) for i, s in enumerate(chosen)])
    rows = features(bars, exit_ema=exit_ema)
    if len(chosen) > 1:
        rows = rows.select("*", F.inline(variants))
        keys = SWEPT
    else:
        rows = rows.select("*", *[variants[0][name].alias(name) for name in ("setting", *types)])
        keys = STOCK
    rows = fire(rows, F.col("volume_ratio_max"), F.col("deviation_max"), F.col("same_day"), keys)
    w = by_stock(keys)
    return rows.withColumns({
        "entry": F.lead("open").over(w), "entry_date": F.lead("trade_date").over(w),
        "bars_in_all": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


def entry_rule(start: str | None = None, end: str | None = None) -> Column:
    """A signal in range, of a stock with enough bars, with a tradable next bar."""
    ok = F.col("signal") & (F.col("bars_in_all") > WARM_UP) & (F.col("entry") > 0)
    if start:
        ok = ok & (F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        ok = ok & (F.col("trade_date") <= F.lit(end).cast("date"))
    return ok


def backtest(bars: DataFrame, settings: list[dict] | None = None, exit_ema: int | None = None,
             start: str | None = None, end: str | None = None, adjust: str | None = "qfq",
             stocks: DataFrame | None = None) -> DataFrame:
    """One row per completed trade and setting; of `stocks` (column stock_id) only, if given, such as those of a board.

    Entry at the open after the signal; from the second bar after it on the first of:
    low at or under the stop, close under its `exit_ema`-bar average (when asked for),
    end of the holding window or of the data. `stop` 0 switches the stop off.
    """
    if stocks is not None:
        bars = bars.join(stocks.select("stock_id"), "stock_id", "left_semi")
    return trades_of(signals(bars, settings, exit_ema, adjust), settings, exit_ema, start, end)


def held_bars(points: DataFrame, settings: list[dict] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of `signals` that can be entered or lie in the holding window of one that can, with these in `_covering`."""
    longest = max([s.get("hold", DEFAULT_SETTING["hold"]) for s in (settings or [{}])])
    keys = SWEPT if len(settings or [{}]) > 1 else STOCK
    opened = F.when(entry_rule(start, end), F.struct(
        F.col("bar").alias("signal_bar"), F.col("trade_date").alias("signal_date"), "entry", "entry_date"))
    rows = points.withColumn("_opened", opened)
    covering = F.collect_list("_opened").over(by_stock(keys).rowsBetween(-(longest + 1), -2))
    rows = rows.withColumn("_covering", covering).filter((F.size("_covering") > 0) | F.col("_opened").isNotNull())
    return rows.select("stock_id", "setting", "hold", "stop", "trade_date", "bar", "open", "low", "close", "bars_in_all",
                       "exit_level", "signal", "entry", "_covering")


def trades_of(points: DataFrame, settings: list[dict] | None = None, exit_ema: int | None = None, start: str | None = None,
              end: str | None = None) -> DataFrame:
    """The trades of `signals`, see `backtest`; `points` may also be the rows that `held_bars` left."""
    rows = points if "_covering" in points.columns else held_bars(points, settings, start, end)
    held = rows.filter(F.size("_covering") > 0).select(
        "stock_id", "setting", "hold", "stop", "trade_date", "bar", "open", "low", "close", "bars_in_all", "exit_level",
        F.inline("_covering"))
    return _first_exits(held.filter(F.col("bar") - F.col("signal_bar") <= F.col("hold") + 1), bool(exit_ema))


def _first_exits(held: DataFrame, use_average: bool) -> DataFrame:
    after = F.col("bar") - F.col("signal_bar")
    stop_price = F.col("entry") * (1 + F.col("stop"))
    stopped = (F.col("stop") != 0) & (F.col("low") <= stop_price)
    under = (F.col("close") < F.col("exit_level")) if use_average else F.lit(False)
    timed = after == F.col("hold") + 1
    done = timed | (F.col("bar") == F.col("bars_in_all"))
    way_out = (F.when(stopped, F.struct(F.least("open", stop_price).alias("exit"), F.lit("stop").alias("reason")))
               .when(under, F.struct(F.col("close").alias("exit"), F.lit("ema_exit").alias("reason")))
               .when(done, F.struct(F.col("open").alias("exit"),
                                    F.when(timed, "time").otherwise("data_end").alias("reason"))))
    hits = held.withColumns({"_out": way_out, "held": after - 1}).filter("_out IS NOT NULL")
    first = F.min_by(F.struct("_out.exit", "_out.reason", F.col("trade_date").alias("exit_date"), "held"),
                     F.col("held"))
    trades = hits.groupBy("stock_id", "setting", "signal_bar", "signal_date", "entry_date", "entry").agg(
        first.alias("_f"))
    return trades.select("stock_id", "setting", "signal_date", "entry_date", "_f.exit_date", "entry", "_f.exit",
                         (F.col("_f.exit") / F.col("entry") - 1).alias("return"), "_f.reason",
                         F.col("_f.held").cast("bigint").alias("held"))


def signal_count(points: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Signals that could be entered, whether or not a trade came of them."""
    return points.filter(entry_rule(start, end)).groupBy("setting").agg(F.count(F.lit(1)).alias("signals"))


MEDIAN_SPLITS = 64
MEDIAN_RANKED = 4096


def exact_median(df: DataFrame, column: str, ranked: int = MEDIAN_RANKED) -> DataFrame:
    """The median of a column as a one-row frame, without holding the values anywhere.

    Duplicates collapse first (so a value shared by a third of the rows is one row). Then rounds of selection: a
    mergeable quantile sketch of the values left gives bounds that split them about evenly, whatever their spread; exact
    counts between bounds tell where the two middle positions lie, and only that stretch is left. At most `ranked`
    values are put in order in the end. The driver sees bounds and counts.
    """
    values = materialize(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c")))
    total, rows = values.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    middle, below, left = ((total - 1) // 2, total // 2), 0, values
    shares = [k / MEDIAN_SPLITS for k in range(1, MEDIAN_SPLITS)]
    while rows > ranked:
        found = left.agg(F.percentile_approx("v", shares, 20 * MEDIAN_SPLITS)).first()[0]
        bounds = sorted(set(found))
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("v")))
        counts = {r.p: (r.n, r.rows) for r in left.groupBy(part.alias("p")).agg(
            F.sum("c").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
        upto, reach = below, {}
        for p in sorted(counts):
            reach[p] = (upto, upto := upto + counts[p][0])
        first, last = (next(p for p in sorted(reach) if reach[p][1] > at) for at in middle)
        below, rows = reach[first][0], sum(n for p, (_, n) in counts.items() if first <= p <= last)
        if first:
            left = left.filter(F.col("v") >= bounds[first - 1])
        if last < len(bounds):
            left = left.filter(F.col("v") < bounds[last])
    hits, upto = [], below
    for v, c in sorted(map(tuple, left.collect())):
        hits += [v for at in middle if upto <= at < upto + c]
        upto += c
    return df.sparkSession.createDataFrame([(sum(hits) / 2 if hits else None,)], "median double")


def trade_summary(trades: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Win rate, mean, exact median, extremes, profit factor and holding time; one row. With `signals` (see
    `signal_count`) also `entries`, the signals that could be entered."""
    trades = materialize(trades)
    r = F.col("return")
    gains, losses = F.sum(F.when(r > 0, r)), F.sum(F.when(r <= 0, r))
    totals = trades.agg(
        F.count(F.lit(1)).alias("trades"), F.avg((r > 0).cast("int")).alias("win_rate"),
        F.avg(r).alias("mean_return"), F.max(r).alias("best"), F.min(r).alias("worst"),
        F.try_divide(F.coalesce(gains, F.lit(0.0)), F.abs(losses)).alias("profit_factor"),
        F.avg("held").alias("mean_held"))
    totals = totals.withColumn("median_return", exact_median(trades, "return").scalar())
    if signals is None:
        return totals
    entries = signals.agg(F.coalesce(F.sum("signals"), F.lit(0)).alias("n")).scalar()
    return totals.withColumn("entries", entries)


def trades_by_reason(trades: DataFrame) -> DataFrame:
    return trades.groupBy("reason").agg(F.count(F.lit(1)).alias("trades"), F.avg("return").alias("mean_return"))


def by_count() -> list[Column]:
    """Order of `trades_by_reason`: the most frequent first."""
    return [F.desc("trades"), F.asc("reason")]


def trades_by_year(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.year("signal_date").alias("year")).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((F.col("return") > 0).cast("int")).alias("win_rate"),
        F.avg("return").alias("mean_return"))


def extreme_trades(trades: DataFrame, k: int = 5) -> DataFrame:
    """The k worst and k best trades; ties by stock and date."""
    trades = materialize(trades)
    tie = ("stock_id", "signal_date")
    worst = trades.orderBy(F.asc("return"), *tie).limit(k).withColumn("side", F.lit("worst"))
    best = trades.orderBy(F.desc("return"), *tie).limit(k).withColumn("side", F.lit("best"))
    return worst.unionByName(best)

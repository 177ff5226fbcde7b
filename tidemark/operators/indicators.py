"""Trend / breakout / money-flow signal.

An exponential average is a recurrence, the one step here that Spark has no built-in
for. Each stock's bars (at most one per day, see `schema`) are packed into one row,
the recurrences run on arrays in an Arrow function applied as a window aggregate over
that row, and the rows are unpacked again. A window keeps the partitioning of its
input, so the rolling windows that follow need no second shuffle.

A recurrence is taken bar by bar, as it is defined. Scans that compose its steps round otherwise, and conditions such as
"above the floor line" or "rising" turn on the last bit where two lines meet.
"""

from __future__ import annotations

from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reachable
from .bars import STOCK, adjusted, by_stock, trailing

WARM_UP = 130
VOLUME_RATIO_MIN = 1.5
VOLUME_RATIO_MAX = 4.0
DEVIATION_MAX = 1.18
STACK = (5, 10, 20, 60)


def average(series: np.ndarray, period: int) -> np.ndarray:
    """Exponential average, seeded with the first value: alpha * value + keep * level, bar by bar and rounded in that order, so
    that lines which meet compare as the definition has them. From a value that is not finite on, none is."""
    if not len(series):
        return series
    alpha = 2 / (period + 1)
    keep = 1 - alpha
    steps = accumulate((alpha * series[1:]).tolist(), lambda level, added: added + keep * level, initial=float(series[0]))
    return np.fromiter(steps, np.float64, len(series))


def _chains(values: Column, chains: tuple[tuple[int, ...], ...]) -> Column:
    """One smoothed array per chain; (2, 2) is the average of the average."""

    @F.arrow_udf("array<array<double>>")
    def smooth(rows: pa.Array) -> Any:
        results, source = [], rows[0].values.to_numpy(zero_copy_only=False).astype(np.float64)
        for chain in chains:
            series = source
            for period in chain:
                series = average(series, period)
            results.append(series)
        return results

    return smooth(values).over(Window.partitionBy("stock_id"))


def pack(bars: DataFrame, columns: list[str]) -> DataFrame:
    """One row per stock with its bars in date order."""
    return reachable(bars).groupBy("stock_id").agg(
        F.array_sort(F.collect_list(F.struct("trade_date", *columns))).alias("bars"))


def typical_price() -> Column:
    """(3 close + high + low + open) / 6."""
    c, h, low, o = (F.col(name).cast("double") for name in ("close", "high", "low", "open"))
    return (3 * c + h + low + o) / 6


def ema(bars: DataFrame, specs: dict[str, tuple[str, tuple[int, ...]]], start_at: str | None = None) -> DataFrame:
    """Add exponential averages. `specs`: name -> (source column, periods applied in turn).

    `start_at` drops earlier bars first, so seeds and warm-up begin there.
    """
    if start_at is not None:
        bars = bars.filter(F.col("trade_date") >= F.lit(start_at).cast("date"))
    kept = [c for c in bars.columns if c not in ("stock_id", "trade_date")]
    packed = pack(bars, kept)
    sources: dict[str, list[str]] = {}
    for name, (source, _) in specs.items():
        sources.setdefault(source, []).append(name)
    arrays = []
    for source, names in sources.items():
        series = F.transform(F.col("bars")[source], lambda value: value.cast("double"))
        packed = packed.withColumn(f"_{source}", _chains(series, tuple(specs[n][1] for n in names)))
        arrays += [F.col(f"_{source}")[i].alias(n) for i, n in enumerate(names)]
    rows = packed.select("stock_id", F.inline(F.arrays_zip("bars", *arrays)))
    return rows.select("stock_id", "bars.*", *specs)


def momentum(fast: Column, slow: Column) -> Column:
    return F.when(slow == 0, 0.0).otherwise(500 * (fast - slow) / slow)


def _with_averages(bars: DataFrame, start_at: str | None, exit_ema: int | None = None) -> DataFrame:
    """All averages the signal needs, in one pass over the packed bars."""
    prices = bars.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close")}) \
        .withColumn("volume", F.coalesce(F.col("volume").cast("double"), F.lit(0.0))) \
        .withColumn("price", typical_price())
    if start_at is not None:
        prices = prices.filter(F.col("trade_date") >= F.lit(start_at).cast("date"))
    kept = [c for c in prices.columns if c not in ("stock_id", "trade_date")]
    packed = pack(prices, kept)
    on_price = _chains(F.col("bars")["price"], ((35,), (2, 2)))
    on_close = _chains(F.col("bars")["close"], tuple((n,) for n in (6, 18, *STACK, exit_ema or 1)))
    packed = packed.withColumns({"_p": on_price, "_c": on_close})
    packed = packed.withColumn("_mom", F.zip_with(F.col("_c")[0], F.col("_c")[1], momentum))
    packed = packed.withColumn("_s", _chains(F.col("_mom"), ((3,),)))
    arrays = [F.col("_p")[0].alias("e35"), F.col("_p")[1].alias("t0"), F.col("_mom").alias("mom_raw"),
              F.col("_s")[0].alias("mom_signal_raw")]
    levels = [*[f"e{n}" for n in STACK], "exit_level"]
    arrays += [F.col("_c")[i + 2].alias(name) for i, name in enumerate(levels)]
    rows = packed.select("stock_id", F.inline(F.arrays_zip("bars", *arrays)))
    return rows.select("stock_id", "bars.*", "e35", "t0", "mom_raw", "mom_signal_raw", *levels)


def floor_lines(rows: DataFrame) -> DataFrame:
    """L1 = mean of the 10/30/90-bar lows of the 35-bar average, L2 = mean of the 5/15/30-bar lows of L1."""
    def mean_low(frame: DataFrame, column: str, spans: tuple[int, int, int], name: str) -> DataFrame:
        # A longer low is the least of shorter lows side by side, so only the first
        # span is scanned bar by bar.
        w = by_stock()
        frame = frame.withColumn("_0", F.min(column).over(trailing(spans[0])))
        for i in (1, 2):
            steps = spans[i] // spans[i - 1]
            parts = [F.lag(f"_{i - 1}", k * spans[i - 1]).over(w) for k in range(1, steps)]
            frame = frame.withColumn(f"_{i}", F.least(F.col(f"_{i - 1}"), *parts))
        return frame.withColumn(name, (F.col("_0") + F.col("_1") + F.col("_2")) / 3).drop("_0", "_1", "_2")

    return mean_low(mean_low(rows, "e35", (10, 30, 90), "l1"), "l1", (5, 15, 30), "l2")


def fast_line(bars: DataFrame) -> DataFrame:
    """Twice-smoothed 2-bar average of the typical price."""
    return ema(bars.withColumn("price", typical_price()), {"t0": ("price", (2, 2))})


def momentum_lines(bars: DataFrame) -> DataFrame:
    return _with_averages(bars, None).select(
        "stock_id", "trade_date", F.col("mom_raw").alias("mom"), F.col("mom_signal_raw").alias("mom_signal"))


def ema_stack(bars: DataFrame) -> DataFrame:
    """Averages of 5, 10, 20 and 60 bars and whether they stand in descending order."""
    rows = ema(bars, {f"e{n}": ("close", (n,)) for n in STACK})
    return rows.withColumn("stacked", _stacked())


def _stacked() -> Column:
    return (F.col("e5") > F.col("e10")) & (F.col("e10") > F.col("e20")) & (F.col("e20") > F.col("e60"))


def volume_ratio(rows: DataFrame) -> DataFrame:
    """Volume over its 5-bar mean (0 without volume)."""
    volume = F.col("volume").cast("double")
    mean = F.avg(volume).over(trailing(5))
    return rows.withColumn("ratio_raw", F.when(mean == 0, 0.0).otherwise(volume / mean))


def money_flow(rows: DataFrame) -> DataFrame:
    """20-bar money flow: where the close sits in the day's span, weighted by volume."""
    c, h, low, v = (F.col(n).cast("double") for n in ("close", "high", "low", "volume"))
    flow = v * (2 * c - h - low) / F.greatest(h - low, F.lit(0.01))
    frame = trailing(20)
    total = F.sum(v).over(frame)
    return rows.withColumn("cmf_raw", F.when(total == 0, 0.0).otherwise(F.sum(flow).over(frame) / total))


def breakout(rows: DataFrame, volume_ratio_max: Column | float = VOLUME_RATIO_MAX,
             deviation_max: Column | float = DEVIATION_MAX, same_day: Column | bool = False,
             keys: tuple[str, ...] = STOCK) -> DataFrame:
    """Close above the previous 20-bar high on rising, but not excessive, volume.

    Needs `ratio_raw` and the average stack. Adds the raw flag, its level and the flag
    with recency (the same day, or one of the last three bars).
    """
    close, open_ = F.col("close").cast("double"), F.col("open").cast("double")
    prior = F.max(F.col("high").cast("double")).over(by_stock(keys).rowsBetween(-20, -1))
    rows = rows.withColumn("prior_high", prior)
    raw = ((close > F.col("prior_high")) & (close > open_)
           & (F.col("ratio_raw") > VOLUME_RATIO_MIN) & (F.col("ratio_raw") < volume_ratio_max)
           & _stacked() & (F.try_divide(close, F.col("e20")) < deviation_max))
    rows = rows.withColumn("breakout_raw", F.coalesce(raw, F.lit(False)))
    recent = F.max("breakout_raw").over(trailing(3, keys))
    same_day = F.lit(same_day) if isinstance(same_day, bool) else same_day
    return rows.withColumn("breakout", F.when(same_day, F.col("breakout_raw")).otherwise(recent))


def features(bars: DataFrame, start_at: str | None = None, exit_ema: int | None = None) -> DataFrame:
    """Everything of the signal that no tunable filter touches."""
    w = by_stock()
    rows = money_flow(volume_ratio(floor_lines(_with_averages(bars, start_at, exit_ema))))
    trend = ((F.col("t0") > F.col("l2")) & (F.col("mom_raw") > 0) & (F.col("mom_raw") > F.col("mom_signal_raw"))
             & (F.col("mom_signal_raw") > F.lag("mom_signal_raw").over(w)))
    flow = ((F.col("cmf_raw") > 0.05) & (F.col("cmf_raw") > F.lag("cmf_raw").over(w))
            & (F.col("close") > F.col("e20")) & (F.col("e20") > F.lag("e20").over(w)))
    return rows.withColumns({"bar": F.row_number().over(w), "trend": F.coalesce(trend, F.lit(False)),
                             "money_flow_up": F.coalesce(flow, F.lit(False))})


def fire(rows: DataFrame, volume_ratio_max: Column | float = VOLUME_RATIO_MAX,
         deviation_max: Column | float = DEVIATION_MAX, same_day: Column | bool = False,
         keys: tuple[str, ...] = STOCK) -> DataFrame:
    """Active bars (all three conditions, after the warm-up) and their rising edges."""
    rows = breakout(rows, volume_ratio_max, deviation_max, same_day, keys)
    rows = rows.withColumn("active", (F.col("bar") > WARM_UP) & F.col("trend") & F.col("breakout")
                           & F.col("money_flow_up"))
    before = F.lag("active").over(by_stock(keys))
    return rows.withColumn("signal", F.col("active") & ~F.coalesce(before, F.lit(False)))


def zzr(bars: DataFrame, volume_ratio_max: float = VOLUME_RATIO_MAX, deviation_max: float = DEVIATION_MAX,
        same_day: bool = False, start_at: str | None = None, adjust: str | None = "qfq") -> DataFrame:
    """Bars with the ten point columns. Nothing looks ahead: a bar's point depends on
    it and earlier bars only. One adjustment is looked at (`qfq` unless another is named); `None` takes all rows as
    they are, for bars that have one adjustment anyway or no such column."""
    if adjust and "adjust_type" in bars.columns:
        bars = adjusted(bars, adjust)
    rows = fire(features(bars, start_at), volume_ratio_max, deviation_max, same_day)
    keep = [c for c in bars.columns if c not in ("stock_id", "trade_date")]
    return rows.select(
        "stock_id", "trade_date", "bar", *keep, "trend", "breakout", "money_flow_up", "active", "signal",
        F.round("mom_raw", 6).alias("mom"), F.round("mom_signal_raw", 6).alias("mom_signal"),
        F.round("cmf_raw", 6).alias("cmf"), F.round("ratio_raw", 4).alias("volume_ratio"),
        F.round("prior_high", 6).alias("breakout_level"))

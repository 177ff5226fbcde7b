"""Per-stock bar windows.

Every window here is partitioned by stock over rows that are unique per
(stock, day), so a partition holds at most one row per day of history, however
the raw input is skewed. All functions share one window spec, hence one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HORIZONS = (1, 3, 5, 10, 20)
MAX_HORIZONS = (5, 20)


STOCK = ("stock_id",)


def by_stock(keys: tuple[str, ...] = STOCK) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("trade_date")


def trailing(n: int, keys: tuple[str, ...] = STOCK) -> WindowSpec:
    """The current bar and the n-1 before it (fewer at the start)."""
    return by_stock(keys).rowsBetween(-(n - 1), 0)


def following(n: int) -> WindowSpec:
    return by_stock().rowsBetween(1, n)


def adjusted(bars: DataFrame, adjust: str = "qfq") -> DataFrame:
    return bars.filter(F.col("adjust_type") == adjust)


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """close(t+n) / close(t) - 1 per horizon; NULL with fewer than n bars ahead or a zero base."""
    w = by_stock()
    base = F.col("close")
    return bars.withColumns({
        f"return_{n}d": _as_return(F.try_divide(F.lead("close", n).over(w) - base, base)) for n in horizons})


def max_forward_return(bars: DataFrame, horizons: tuple[int, ...] = MAX_HORIZONS,
                       threshold: str = "0.1") -> DataFrame:
    """Highest close of the next n bars against this close, only for complete windows,
    with a flag that compares before rounding."""
    base = F.col("close")
    out = {}
    for n in horizons:
        ahead = following(n)
        best = F.when(F.count("close").over(ahead) == n, F.max("close").over(ahead))
        out[f"max_return_{n}d"] = _as_return(F.try_divide(best - base, base))
        out[f"rise_{n}d"] = rise_flag(best, base, threshold)
    return bars.withColumns(out)


def outcomes_ahead(ahead: Column, threshold: str = "0.1") -> dict[str, Column]:
    """What `forward_returns` and `max_forward_return` say of a bar, from the closes from it on (`ahead`, an array)."""
    base, out = F.get(ahead, F.lit(0)), {}
    for n in HORIZONS:
        out[f"return_{n}d"] = _as_return(F.try_divide(F.get(ahead, F.lit(n)) - base, base))
    for n in MAX_HORIZONS:
        coming = F.filter(F.slice(ahead, 2, n), lambda close: close.isNotNull())
        best = F.when(F.size(coming) == n, F.array_max(coming))
        out[f"max_return_{n}d"] = _as_return(F.try_divide(best - base, base))
        out[f"rise_{n}d"] = rise_flag(best, base, threshold)
    return out


def rise_flag(best: Column, base: Column, threshold: str = "0.1") -> Column:
    """best/base - 1 >= threshold without dividing: exact for decimals, false for NULL or a zero base."""
    gain = F.lit(threshold).cast("decimal(6,4)")
    return F.coalesce((base != 0) & (best - base >= base * gain), F.lit(False))


def _as_return(value: Column) -> Column:
    return F.round(value, 6).cast("decimal(12,6)")


def rolling(bars: DataFrame, column: str, n: int, kinds: tuple[str, ...] = ("min", "max", "sum", "avg")) -> DataFrame:
    """Rolling extremes, sum and mean over the available bars."""
    frame = trailing(n)
    fns = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}
    return bars.withColumns({f"{kind}_{n}": fns[kind](F.col(column).cast("double")).over(frame) for kind in kinds})


def latest_bars(bars: DataFrame, n: int) -> DataFrame:
    """The n newest bars per stock with `rn` (1 = newest). The `<=` bound lets Spark
    drop older bars before the shuffle (window group limit)."""
    newest = Window.partitionBy("stock_id").orderBy(F.desc("trade_date"))
    return bars.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)


def resample_bars(bars: DataFrame, period: int | str, flags: tuple[str, ...] = ()) -> DataFrame:
    """Candles of n consecutive bars counted from the oldest, or, for `mtd` / `ytd`,
    the daily bars of the stock's last month or year."""
    w = by_stock()
    if period in ("mtd", "ytd"):
        unit = "month" if period == "mtd" else "year"
        last = F.max("trade_date").over(Window.partitionBy("stock_id"))
        return (bars.withColumn("_last", F.trunc(last, unit))
                .filter(F.trunc("trade_date", unit) == F.col("_last")).drop("_last")
                .withColumn("bars", F.lit(1).cast("bigint")))
    grouped = bars.withColumn("_candle", F.floor((F.row_number().over(w) - 1) / F.lit(int(period))))
    open_ = F.min_by("open", "trade_date")
    close = F.max_by("close", "trade_date")
    return (grouped.groupBy("stock_id", "_candle").agg(
        F.max("trade_date").alias("trade_date"), open_.alias("open"),
        F.max("high").alias("high"), F.min("low").alias("low"), close.alias("close"),
        F.sum(F.coalesce("volume", F.lit(0))).alias("volume"),
        F.count(F.lit(1)).alias("bars"),
        *[F.max(flag).alias(flag) for flag in flags])
        .withColumn("change_pct", F.when(F.col("open") != 0, (
            F.col("close").cast("double") / F.col("open").cast("double") - 1) * 100))
        .drop("_candle"))

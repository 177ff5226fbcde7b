"""Missing bars, suspensions, back-fill and purges.

Gaps are enumerated from one bar to the next (positions between two neighbours in the
trading calendar), so the work grows with the bars and the gaps, not with the full
stock x calendar grid. The calendar holds one row per day and is the only broadcast
side; its length is bounded by the number of days it spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import is_excluded
from .bars import by_stock


def _positions(calendar: DataFrame) -> DataFrame:
    """(day, pos): trading days numbered from 1. One row per day, so one small window."""
    days = calendar.select(F.col("trade_date").alias("day")).distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("day")))


def _natural_days(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """(date, upto, open): for every natural day from the first bar or trading day to the
    last, the number of trading days up to it and whether it is one."""
    span = bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).unionByName(
        positions.agg(F.min("day").alias("a"), F.max("day").alias("b"))).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    marked = every.join(positions, every["date"] == positions["day"], "left")
    upto = F.count("pos").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("date", upto.alias("upto"), F.col("pos").isNotNull().alias("open"))


def _between(bars: DataFrame, calendar: DataFrame, after_last: bool) -> DataFrame:
    """(stock_id, pos) of missing trading days at or after the first bar, and before the
    last one unless `after_last`."""
    positions = _positions(calendar)
    days = _small(_natural_days(positions, bars))
    placed = bars.select("stock_id", "trade_date").join(days, F.col("trade_date") == F.col("date"))
    w = by_stock()
    total = positions.agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    nxt = F.lead(F.when(F.col("open"), F.col("upto") - 1).otherwise(F.col("upto"))).over(w)
    placed = placed.withColumn("_from", F.col("upto") + 1).withColumn("_to", nxt)
    if after_last:
        placed = placed.withColumn("_to", F.coalesce("_to", total.scalar()))
    # An off-calendar first bar still starts the range: upto counts the days before it.
    return (placed.filter(F.col("_to") >= F.col("_from"))
            .select("stock_id", F.explode(F.sequence("_from", "_to")).alias("pos")))


def _small(days: DataFrame) -> DataFrame:
    """Broadcast a per-day table: one row per natural day of the spanned period."""
    return F.broadcast(days)


def detect_gaps(bars: DataFrame, calendar: DataFrame, stocks: DataFrame, start: str | None = None,
                end: str | None = None) -> DataFrame:
    """(day, stock_id, code, name): eligible stocks without a bar on a trading day between
    their first and last bar; stocks without any bar are missing on every day.

    `start` / `end` restrict both the calendar and the bars before detection.
    """
    calendar = _in_range(calendar, start, end)
    bars = _in_range(bars, start, end)
    chosen = stocks.filter(~is_excluded(F.col("stock_name"), F.col("stock_code"))).select(
        F.col("id").alias("stock_id"), F.col("stock_code").alias("code"), F.col("stock_name").alias("name"))
    positions = _positions(calendar)
    own = bars.select("stock_id", "trade_date").join(chosen.select("stock_id"), "stock_id", "left_semi")
    inside = _between(own, calendar, after_last=False)
    return (inside.unionByName(_never(chosen, bars, positions)).join(_small(positions), "pos").join(chosen, "stock_id")
            .select("day", "stock_id", "code", "name"))


def _in_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    return df


def missing_days(bars: DataFrame, calendar: DataFrame, stocks: DataFrame | None = None) -> DataFrame:
    """(stock_id, day) missing since the first bar, days after the last one included. Of `stocks` (column id), those
    without any bar miss every day."""
    positions = _positions(calendar)
    missing = _between(bars.select("stock_id", "trade_date"), calendar, after_last=True)
    if stocks is not None:
        missing = missing.unionByName(_never(stocks.select(F.col("id").alias("stock_id")), bars, positions))
    return missing.join(_small(positions), "pos").select("stock_id", "day")


def _never(chosen: DataFrame, bars: DataFrame, positions: DataFrame) -> DataFrame:
    """(stock_id, pos): every trading day of stocks that have no bar."""
    silent = chosen.select("stock_id").join(bars.select("stock_id"), "stock_id", "left_anti")
    total = positions.agg(F.count(F.lit(1)).cast("bigint").alias("n")).scalar()
    return (silent.withColumn("n", total).filter("n > 0")
            .select("stock_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("pos")))


def classify_gaps(gaps: DataFrame, source_bars: DataFrame, probed: DataFrame) -> DataFrame:
    """Split gaps with the source's answer: what it lacks too is a suspension, what it has
    is a sync failure; stocks the source did not answer for stay unclassified."""
    has = source_bars.select("stock_id", F.col("trade_date").alias("day"), F.lit(True).alias("_has"))
    asked = probed.select("stock_id", F.lit(True).alias("_asked")).distinct()
    return (gaps.join(has, ["stock_id", "day"], "left").join(asked, "stock_id", "left")
            .withColumn("kind", F.when(F.col("_asked").isNull(), "unclassified")
                        .when(F.col("_has").isNull(), "suspension").otherwise("sync_failure"))
            .drop("_has", "_asked"))


def backfill_spans(gaps: DataFrame) -> DataFrame:
    """Per code what to fetch: first and last missing day and all missing days (at most one per trading day)."""
    return gaps.groupBy("code").agg(
        F.min("name").alias("name"), F.min("day").alias("start_date"), F.max("day").alias("end_date"),
        F.sort_array(F.collect_set("day")).alias("dates"))


def backfill_outcome(spans: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome per code. `results`: (code, rows, error); an error is a failure with its
    reason, an empty answer a suspension, rows mean done; no answer yet is pending."""
    status = (F.when(F.col("error").isNotNull(), "failed").when(F.col("rows").isNull(), "pending")
              .when(F.col("rows") == 0, "suspended").otherwise("done"))
    return (spans.join(results.select("code", "rows", "error"), "code", "left")
            .withColumn("status", status).withColumnRenamed("error", "reason").drop("rows"))


def backfill_status(outcome: DataFrame) -> DataFrame:
    """One row: totals and the run's status."""
    n = F.count_if(F.col("status") == "failed")
    return outcome.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"),
                       F.count_if(F.col("status") == "suspended").alias("suspended"), n.alias("failed"),
                       F.when(n > 0, "completed_with_failures").otherwise("completed").alias("status"))


def gap_report(gaps: DataFrame) -> DataFrame:
    """Missing stocks per day and in total; the stocks themselves are the rows of `gaps`."""
    total = gaps.agg(F.count(F.lit(1)).alias("n"))
    return (gaps.groupBy("day").agg(F.count(F.lit(1)).alias("missing"))
            .withColumn("total_missing", total.scalar()))


def purge_excluded(bars: DataFrame, returns: DataFrame, links: DataFrame, stocks: DataFrame
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, returns, counts) without excluded, named stocks; stocks and links stay."""
    out = stocks.filter((F.col("stock_name") != "") & is_excluded(F.col("stock_name"), F.col("stock_code"))).select(
        F.col("id").alias("stock_id"))
    counts = _removed(bars, returns, links, out).withColumn("stocks_removed", F.lit(0).cast("bigint")).select(
        "stocks_removed", F.col("bars").alias("quote_rows_removed"), F.col("returns").alias("event_returns_removed"),
        F.col("links").alias("topic_links_kept"))
    return bars.join(out, "stock_id", "left_anti"), returns.join(out, "stock_id", "left_anti"), counts


def purge_unnamed(bars: DataFrame, returns: DataFrame, links: DataFrame, stocks: DataFrame
                  ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(stocks, bars, returns, links, counts) without stocks of blank name."""
    out = stocks.filter("stock_name = ''").select(F.col("id").alias("stock_id"))
    counts = (_removed(bars, returns, links, out)
              .withColumn("stocks_removed", out.agg(F.count(F.lit(1)).alias("n")).scalar())
              .select("stocks_removed", F.col("bars").alias("quote_rows_removed"), F.col("links").alias("topic_links_removed")))
    return (stocks.filter("stock_name <> ''"), *[df.join(out, "stock_id", "left_anti") for df in (bars, returns, links)],
            counts)


def _removed(bars: DataFrame, returns: DataFrame, links: DataFrame, out: DataFrame) -> DataFrame:
    parts = None
    for name, df in (("bars", bars), ("returns", returns), ("links", links)):
        part = df.select("stock_id").join(out, "stock_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("part"), "n")
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(*[F.max(F.when(F.col("part") == p, F.col("n"))).alias(p) for p in ("bars", "returns", "links")])

"""Bar sources: CSV files, provider frames, fallback source and trading calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import num_or_zero

CSV_COLUMNS = ("code", "stock_code", "name", "stock_name", "date", "open", "high", "low", "close", "volume", "amount",
               "turnover_rate", "adjust_type")
# Column names of the two providers and of calendar feeds.
PRIMARY_COLUMNS = {"date": "日期", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘", "volume": "成交量",
                   "amount": "成交额", "turnover_rate": "换手率"}
FALLBACK_COLUMNS = {"date": "date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
                    "amount": "amount", "turnover_rate": "turnover"}
CALENDAR_COLUMNS = ("trade_date", "交易日", "calendarDate")


def _given(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the named columns that exist."""
    found = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_quotes_csv(spark: SparkSession, path: str, mode: str = "permissive") -> tuple[DataFrame, DataFrame]:
    """(bars, names) of CSV files with a header, columns in any order and any order of their own per file.

    Files are grouped by their header line (read from the head of each file; as many come to the driver as there are
    files) and every group is read by its own header. Rows count in the order of file names and lines. `mode="failfast"`
    makes a malformed date or number an error, `permissive` leaves such rows out of the bars.
    """
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    heads = (spark.read.text(path).select("value", file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"))
             .where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header")))
    groups: dict[str, list[str]] = {}
    found = sorted(heads.collect(), key=lambda row: row["file"])
    for row in found:
        groups.setdefault(row["header"], []).append(row["file"])
    # A number tells the place of a row: file, block of the file, row of the block. Names of files would travel with every row.
    ranks = spark.createDataFrame([(row["file"], k) for k, row in enumerate(found)], "_file string, _rank bigint")
    digits, within = F.lit(f"{10 ** 24}").cast("decimal(25,0)"), F.lit(f"{10 ** 10}").cast("decimal(11,0)")
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a block is read by one task
    parts = []
    for files in groups.values():
        rows = spark.read.csv(files, header=True, inferSchema=False, encoding="UTF-8")
        rows = rows.withColumnsRenamed({c: c.lstrip("\ufeff").strip() for c in rows.columns})
        given = [c for c in CSV_COLUMNS if c in rows.columns]
        placed = rows.select(*given, file.alias("_file"), block.alias("_block"), line.alias("_line"))
        at = F.col("_rank") * digits + F.col("_block") * within + F.col("_line")
        parts.append(placed.join(F.broadcast(ranks), "_file").select(*given, at.cast("decimal(38,0)").alias("seq")))
    if not parts:
        return normalize_quote_rows(spark.createDataFrame([], ", ".join(f"{c} string" for c in (*CSV_COLUMNS, "seq"))), mode)
    return normalize_quote_rows(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), mode)


def normalize_quote_rows(raw: DataFrame, mode: str = "permissive", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Text rows to bars keyed by code: rows without code, date or close are ignored, missing
    prices default to the close, missing amounts to 0, the adjustment to `qfq`; the first row
    per key wins. `names` holds the last non-empty name per code."""
    strict = mode == "failfast"
    price = "decimal(18,6)"
    close = _given(raw, "close")
    day = _given(raw, "date")
    numbers = {**{n: (F.coalesce(_given(raw, n), close), price) for n in ("open", "high", "low")}, "close": (close, price),
               "volume": (F.coalesce(_given(raw, "volume"), F.lit("0")), "decimal(24,4)"),
               "amount": (F.coalesce(_given(raw, "amount"), F.lit("0")), "decimal(24,4)"),
               "turnover_rate": (F.coalesce(_given(raw, "turnover_rate"), F.lit("0")), "decimal(12,6)")}
    rows = raw.select(
        _given(raw, "code", "stock_code").alias("stock_code"), _given(raw, "name", "stock_name").alias("name"),
        day.alias("_day"), (F.to_date(day) if strict else F.try_to_date(day)).alias("trade_date"),
        *[(text.cast(kind) if strict else text.try_cast(kind)).alias(n) for n, (text, kind) in numbers.items()],
        close.alias("_close"), F.coalesce(_given(raw, "adjust_type"), F.lit("qfq")).alias("adjust_type"), F.col(order).alias("seq"))
    rows = rows.filter("stock_code IS NOT NULL AND _day IS NOT NULL AND _close IS NOT NULL")
    names = rows.filter("name IS NOT NULL").groupBy("stock_code").agg(F.max_by("name", "seq").alias("stock_name"))
    # Rows that are not whole have no order, so none of them is first: a filter on them would parse every number twice.
    # Column by column, since values of a fixed width are reduced in a hash table, and a struct only by sorting.
    whole = " AND ".join(f"{n} IS NOT NULL" for n in ("trade_date", *numbers))
    ranked = rows.withColumn("_order", F.when(F.expr(whole), F.col("seq")))
    bars = ranked.groupBy("stock_code", "trade_date", "adjust_type").agg(
        F.min("_order").alias("_first"), *[F.min_by(n, "_order").alias(n) for n in numbers])
    return bars.filter("_first IS NOT NULL").select("stock_code", "trade_date", "adjust_type", *numbers), names


def import_quotes(existing: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars whose key the table does not have yet."""
    return bars.join(existing.select("stock_code", "trade_date", "adjust_type"),
                     ["stock_code", "trade_date", "adjust_type"], "left_anti")


def normalize_bars(df: DataFrame, mapping: dict[str, str], adjust: str = "qfq", keep: tuple[str, ...] = ("code",),
                   signed: bool = False) -> DataFrame:
    """Provider rows to common columns: tolerant numbers, rows without a date or a positive close dropped. `signed` keeps
    every close that is a number: prices adjusted for dividends can pass zero."""
    numbers = [num_or_zero(F.col(mapping[n])).alias(n) for n in
               ("open", "high", "low", "close", "volume", "amount", "turnover_rate")]
    close = F.col(mapping["close"]).try_cast("double")
    priced = close.isNotNull() if signed else close > 0
    rows = df.select(*keep, F.col(mapping["date"]).cast("string").alias("date"), *numbers,
                     F.lit(adjust).alias("adjust_type"), priced.alias("_priced"))
    return rows.filter("date IS NOT NULL AND date <> '' AND date <> 'None' AND _priced").drop("_priced")


def union_with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All primary rows, and fallback rows of keys for which the primary has none."""
    return primary.unionByName(fallback.join(primary.select(*keys), keys, "left_anti"))


def trading_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct trading days in the range from whichever calendar column is filled."""
    text = F.substring(F.trim(F.coalesce(_given(df, *CALENDAR_COLUMNS), F.lit(""))), 1, 10)
    days = df.select(F.try_to_date(text, "yyyy-MM-dd").alias("trade_date"))
    return days.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).distinct()

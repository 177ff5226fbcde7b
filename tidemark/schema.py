"""Table schemas. Bars are keyed by (stock_id, trade_date, adjust_type): a stock
never has more rows per adjustment than there are days, which is what bounds
every per-stock window and per-stock array in this package."""

from pyspark.sql import types as T

_PRICE = T.DecimalType(18, 6)
_AMOUNT = T.DecimalType(24, 4)
_RATE = T.DecimalType(12, 6)

BAR = T.StructType([
    T.StructField("stock_id", T.LongType()),
    T.StructField("trade_date", T.DateType()),
    T.StructField("open", _PRICE),
    T.StructField("high", _PRICE),
    T.StructField("low", _PRICE),
    T.StructField("close", _PRICE),
    T.StructField("volume", _AMOUNT),
    T.StructField("amount", _AMOUNT),
    T.StructField("turnover_rate", _RATE),
    T.StructField("adjust_type", T.StringType()),
])

TOPIC = T.StructType([
    T.StructField("topic_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

STOCK = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("stock_code", T.StringType()),
    T.StructField("stock_name", T.StringType()),
    T.StructField("exchange", T.StringType()),
    T.StructField("industry", T.StringType()),
])

KEYWORD = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("normalized_keyword", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("deleted", T.BooleanType()),
])

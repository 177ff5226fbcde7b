"""Times: lenient parsing to UTC and the Beijing-date rule of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Shanghai"
SESSION_CLOSE_HOUR = 15


def parse_time(text: Column, default: Column) -> Column:
    """UTC timestamp of `...+0800`, `...Z` or naive text; blank text gives `default`."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    iso = F.regexp_replace(raw, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(iso, F.lit("T00:00:00Z"))) \
        .when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.when(raw == "", default).otherwise(F.try_to_timestamp(iso))


def local_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), LOCAL_ZONE)


def first_event_date(ts: Column) -> Column:
    """Beijing date of a post, the next day for posts at or after the close."""
    local = local_time(ts)
    day = F.to_date(local)
    return F.when(F.hour(local) >= SESSION_CLOSE_HOUR, F.date_add(day, 1)).otherwise(day)


def month_of(ts: Column) -> Column:
    """First day of the Beijing month."""
    return F.trunc(F.to_date(local_time(ts)), "month")

"""Stock codes: board, exchange and exclusion rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes per board, board labels, exclusion marks.
BOARD_PREFIXES = {
    "main": ("600", "601", "603", "605", "000", "001", "002", "003"),
    "gem": ("300", "301"),
    "star": ("688",),
    "bse": ("4", "8", "920"),
}
BOARD_LABELS = {"gem": "创业板", "star": "科创板", "bse": "北交所", "main": "主板"}
OTHER_BOARD = "其他"
EXCLUDED_NAME = r"(?i)^\*?ST|退市"
DEPOSITARY_PREFIX = "68900"


def _starts_with_any(code: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes])


def market_of(code: Column) -> Column:
    """Board label of a code."""
    clean = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    label = None
    for board, text in BOARD_LABELS.items():
        hit = _starts_with_any(clean, BOARD_PREFIXES[board])
        label = F.when(hit, text) if label is None else label.when(hit, text)
    return label.otherwise(OTHER_BOARD)


def market_filter(code: Column, market: str = "all") -> Column:
    """Board predicate; prefixes become StringStartsWith, which Parquet can push down."""
    if market == "all":
        return F.lit(True)
    return _starts_with_any(code, BOARD_PREFIXES[market])


def is_excluded(name: Column, code: Column) -> Column:
    """Special-treatment, delisting or depositary-receipt stocks."""
    return (F.coalesce(name, F.lit("")).rlike(EXCLUDED_NAME)
            | F.coalesce(code, F.lit("")).startswith(DEPOSITARY_PREFIX))


def is_eligible(name: Column, code: Column) -> Column:
    """Named and not excluded: the stocks a full-market sync covers."""
    return (F.coalesce(name, F.lit("")) != "") & ~is_excluded(name, code)


def exchange_of(code: Column) -> Column:
    return F.when(code.startswith("6"), "SH").otherwise("SZ")

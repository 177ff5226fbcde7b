"""Tolerant numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def num_or_zero(value: Column) -> Column:
    """The number a text holds, 0.0 when it holds none."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def decimal_round(value: Column, places: int, precision: int) -> Column:
    return F.round(value, places).cast(f"decimal({precision},{places})")

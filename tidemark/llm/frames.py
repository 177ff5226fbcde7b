"""Rows that pass through an operator with whatever columns they have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(df: DataFrame, *named: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with all columns but `named` under neutral names, so that none clashes with a working column; and a
    function that gives a result its old columns back."""
    names = df.columns
    neutral = {c: c if c in named else f"_kept_{k}" for k, c in enumerate(names)}
    return (df.select(*[F.col(f"`{c}`").alias(neutral[c]) for c in names]),
            lambda out: out.select(*[F.col(neutral[c]).alias(c) for c in names]))

"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType


def to_degrees(c: Column) -> Column:
    """Text or number to double; unreadable text, NaN and infinity become NULL."""
    d = c.try_cast("double")
    return F.when(F.abs(d) < float("inf"), d)


def to_whole(c: Column, kind: str | DataType) -> Column:
    """Text to a whole number, also one written as ``1.0``; unreadable and fractional text becomes NULL."""
    d = c.try_cast("double")
    return F.coalesce(c.try_cast(kind), F.when(d == F.floor(d), d.try_cast(kind)))


def to_date(c: Column) -> Column:
    """``mm/dd/yyyy`` text to a date, with or without leading zeros; bad text becomes NULL."""
    return F.try_to_date(c, "M/d/yyyy")


def exact_mean(c: Column) -> Column:
    """Mean of a double column that does not depend on row order (nine decimals kept)."""
    return F.sum(c.cast("decimal(18,9)")).cast("double") / F.count(c)


def min_max_scale(value: Column, low: Column, high: Column) -> Column:
    """``(value - low) / (high - low)``; NULL where the range is empty."""
    return F.try_divide(value - low, high - low)

"""Percentages: decimals from 0 to 100, apart from ratios from 0 to 1. Values beyond these bounds are not checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_ratio(c: Column) -> Column:
    """0.077546 to 7.7546."""
    return c * 100


def as_ratio(c: Column) -> Column:
    return c / 100


def parsed(c: Column, kind: str = "decimal(28,12)") -> Column:
    """A decimal text as a percentage; null if it is none, as with a sign of percent."""
    return F.trim(c).try_cast(kind)


def shown(c: Column, digits: int) -> Column:
    """With so many digits behind the point."""
    return F.bround(c.cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string")


def delta(new: Column, old: Column) -> Column:
    """A signed difference in percentage points."""
    return new - old


def negated(c: Column) -> Column:
    return -c

"""Exact arithmetic on columns that hold amounts as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column | str) -> Column:
    """An amount to the hundredth, for sums that do not depend on the order of rows."""
    return F.col(c).cast("decimal(12,2)") if isinstance(c, str) else c.cast("decimal(12,2)")


def fraction(c: str) -> Column:
    """A rate to the hundredth."""
    return F.col(c).cast("decimal(4,2)")


def total(c: Column, scale: int = 2) -> Column:
    """A sum of exact amounts."""
    return F.sum(c).cast(f"decimal(18,{scale})")

"""Join of two streams within a span of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_join(first: DataFrame, then: DataFrame, *, by: str, on: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs ``first, later`` (structs) of a key where the second's time is at most so many seconds after the first's.

    Both are streams or batch tables. As streams they keep the rows that may still find a
    partner: one of ``first`` until the watermark of both passes its time and the span, one
    of ``then`` until it passes its time. Rows later than ``late`` are left out. Null keys
    and times meet nothing, repeated rows match each.
    """
    side = lambda df, key, t, row: df.select(F.col(by).alias(key), F.col(on).cast("timestamp").alias(t), F.struct("*").alias(row)).withWatermark(t, late)
    a, b = side(first, "key", "begin", "first"), side(then, "of", "at", "later")
    span = F.expr(f"interval {int(seconds)} seconds")
    return a.join(b, (F.col("key") == F.col("of")) & (F.col("at") >= F.col("begin")) & (F.col("at") <= F.col("begin") + span)).select("first", "later")

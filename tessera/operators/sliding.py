"""Distinct values in a range of time that slides with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .temporal import MICROS, micros


def distinct_in_range(rows: DataFrame, *, by: str, on: str, value: str, seconds: int, block_seconds: int = 86_400) -> DataFrame:
    """The rows with ``distinct``: how many values their key has had in the last ``seconds``, both ends included.

    A value counts from each of its times until it comes again or falls out of the range,
    so a time's number is the sum of what began less what ended up to it. Next times and
    sums are found within blocks of time first and then over one row for each block, so
    a key, or a value of a key, with a third of the rows is not one task's work.

    Null values do not count; rows with a null key or time have null. Repeated rows stay;
    an empty table gives no rows. ValueError if there is a column ``distinct`` already.
    """
    if "distinct" in rows.columns:
        raise ValueError("a column is named distinct already")
    block = lambda t: F.floor(t / (block_seconds * MICROS))
    timed = rows.select(F.struct("*").alias("row"), F.col(by).alias("key"), micros(rows, on).alias("t"), F.col(value).alias("value"))
    known = timed.where("key is not null and t is not null")
    seen = known.where("value is not null").select("key", "value", "t").distinct().withColumn("block", block(F.col("t")))

    # The next time of the same value: in its block, else the first of the next block that has it.
    firsts = seen.groupBy("key", "value", "block").agg(F.min("t").alias("first"))
    after = firsts.select("key", "value", "block", F.lead("first").over(W.partitionBy("key", "value").orderBy("block")).alias("later"))
    within = F.lead("t").over(W.partitionBy("key", "value", "block").orderBy("t"))
    runs = seen.withColumn("next", within).join(after, ["key", "value", "block"])
    end = F.least(F.col("t") + seconds * MICROS + 1, F.coalesce("next", "later"))
    steps = runs.select("key", F.explode(F.array(F.struct(F.col("t").alias("t"), F.lit(1).alias("step")), F.struct(end.alias("t"), F.lit(-1).alias("step")))).alias("s")).select("key", "s.*")

    # Times of rows without a value take part by a step of nothing.
    steps = steps.union(known.where("value is null").select("key", "t", F.lit(0).alias("step")))
    steps = steps.groupBy("key", "t").agg(F.sum("step").alias("step")).withColumn("block", block(F.col("t")))
    order = W.partitionBy("key", "block").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = steps.groupBy("key", "block").agg(F.sum("step").alias("step")).select("key", "block", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("base"))
    counts = steps.withColumn("own", F.sum("step").over(order)).join(blocks, ["key", "block"]).select("key", "t", (F.col("base") + F.col("own")).alias("distinct"))
    out = known.join(counts, ["key", "t"]).select("row", "distinct")
    rest = timed.where("key is null or t is null").select("row", F.lit(None).cast("bigint").alias("distinct"))
    return out.union(rest).select("row.*", "distinct")

"""Exact quantiles of groups, without a sort."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.workspace import Workspace

#: Parts into which a range of values is cut at a time, and rows of a list that is broadcast.
BINS, MOST_BROADCAST = 1024, 100_000


def group_quantiles(rows: DataFrame, *, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``by..., share, n, quantile``: the least value that at least such a share of a group's values does not exceed.

    Values are whole numbers or decimals of up to 18 digits. Each pass counts the values in
    BINS parts of what is still open of a group's range and goes on in the part that holds
    the rank, so a range of R values takes log R / log BINS passes; a group sends BINS
    counts from each task, however many rows it has.

    Null values do not count, a group of nulls alone has no row; null keys are a group.
    Repeated rows count each, an empty table gives no rows. A share of 0 is the least value.
    """
    kind = rows.schema[value].dataType
    scale = getattr(kind, "scale", 0)
    whole = (F.col(value) * F.lit(10**scale)).cast("decimal(38,0)").cast("bigint") if scale else F.col(value).cast("bigint")
    work = Workspace(rows.sparkSession)
    held = work.save(rows.where(F.col(value).isNotNull()).select(F.struct(*by).alias("g"), whole.alias("v")), "values")
    spans = held.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    share = F.explode(F.array(*(F.lit(Decimal(str(s))).cast("decimal(18,12)") for s in shares)))
    # What is open of each group and share: values from lo to hi, and the rank among them.
    asked = spans.withColumn("share", share).withColumn("rank", F.greatest(F.ceil(F.col("share") * F.col("n")).cast("bigint"), F.lit(1)))
    asked = work.save(asked, "ranks")
    while asked.where("lo < hi").limit(1).count():
        # Parts as wide as lets BINS of them cover the range, in whole numbers without overflow.
        room = F.col("hi").cast("decimal(20,0)") - F.col("lo") + BINS
        asked = asked.withColumn("size", ((room - room % BINS) / BINS).cast("decimal(20,0)"))
        ranges = asked.where("lo < hi").select(F.col("g").alias("of"), "lo", "hi", "size").distinct()
        if ranges.count() <= MOST_BROADCAST:
            ranges = F.broadcast(ranges)
        inside = held.join(ranges, F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        part = F.expr("cast((cast(v as decimal(20,0)) - lo) div size as int)")
        counts = inside.groupBy("g", "lo", "hi", part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
        order = W.partitionBy("g", "lo", "hi").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("c").over(order)).select(F.col("g").alias("of"), F.col("lo").alias("l"), F.col("hi").alias("h"), "part", "c", "upto")
        at = F.col("g").eqNullSafe(F.col("of")) & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h")) & F.col("rank").between(F.col("upto") - F.col("c") + 1, F.col("upto"))
        found = asked.where("lo < hi").join(counts, at)
        begin = F.col("lo").cast("decimal(20,0)") + F.col("part") * F.col("size")
        end = F.least(begin + F.col("size") - 1, F.col("hi").cast("decimal(20,0)"))
        found = found.select("g", begin.cast("bigint").alias("lo"), end.cast("bigint").alias("hi"), "n", "share", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
        asked = work.save(asked.where("lo = hi").drop("size").union(found), "ranks")
    quantile = (F.col("lo").cast("decimal(38,0)") / F.lit(10**scale)).cast(kind) if scale else F.col("lo").cast(kind)
    return asked.select("g.*", F.col("share").cast("double").alias("share"), "n", quantile.alias("quantile"))

"""Joins and sessions over time, for keys that may hold a large share of all rows.

Each operator works within blocks of time first and then over one row for each key and
block, so that what a key needs in one task is its rows of a block, never all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MICROS = 1_000_000
#: Pieces in which an interval is entered at one width; there are at most ten widths from a second to all of time.
MOST_PIECES = 64


def micros(df: DataFrame, c: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without zone counts its own days, whatever the session's zone."""
    t = F.col(c)
    if df.schema[c].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(t.cast("timestamp"))
    day = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((day * 24 + F.hour(t)) * 60 + F.minute(t)) * (60 * MICROS) + (F.extract(F.lit("SECOND"), t) * MICROS).cast("long")


def asof_join(left: DataFrame, right: DataFrame, *, by: str, on: str, values: list[str], block_seconds: int = 86_400) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key at or before its time.

    Of right rows at the same time, the one with the greatest values is taken. Left rows with
    a null key or time stay and match nothing; repeated rows each stay; an empty right
    table gives nulls. Left columns come first, as they were; ValueError if one is named in
    ``values``.
    """
    if clash := set(values) & set(left.columns):
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    block = lambda t: F.floor(t / (block_seconds * MICROS))
    hit_of = F.struct(micros(right, on).alias("at"), F.struct(*values).alias("values"))
    rows = left.select(F.col(by).alias("key"), micros(left, on).alias("t"), F.struct("*").alias("row"))
    hits = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).select(F.col(by).alias("key"), micros(right, on).alias("t"), hit_of.alias("hit"))
    timed = rows.where("key is not null and t is not null")
    both = timed.unionByName(hits, allowMissingColumns=True).withColumns({"block": block(F.col("t")), "side": F.col("row").isNotNull()})

    order = W.partitionBy("key", "block").orderBy("t", "side", "hit").rowsBetween(W.unboundedPreceding, 0)
    within = both.withColumn("own", F.last("hit", ignorenulls=True).over(order)).where("side")
    blocks = both.groupBy("key", "block").agg(F.max("hit").alias("hit"))
    before = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.last("hit", ignorenulls=True).over(before).alias("carried"))

    found = within.join(blocks, ["key", "block"]).select("row", F.coalesce("own", "carried").alias("hit"))
    rest = rows.where("key is null or t is null").select("row", F.lit(None).cast(found.schema["hit"].dataType).alias("hit"))
    return found.union(rest).select("row.*", "hit.values.*")


def sessions(events: DataFrame, *, by: str, on: str, gap_seconds: int, block_seconds: int = 86_400) -> DataFrame:
    """``key, session, start_us, end_us, n``: runs of events of a key without a gap above ``gap_seconds``.

    Sessions of a key are numbered from 0 by time. Rows with a null key or time are in no
    session; repeated rows count each; an empty table has no sessions.
    """
    rows = events.where(F.col(by).isNotNull() & F.col(on).isNotNull()).select(F.col(by).alias("key"), micros(events, on).alias("t"))
    rows = rows.withColumn("block", F.floor(F.col("t") / (block_seconds * MICROS)))
    by_block = W.partitionBy("key").orderBy("block")
    ends = rows.groupBy("key", "block").agg(F.max("t").alias("last")).select("key", "block", F.lag("last").over(by_block).alias("before"))
    within = W.partitionBy("key", "block").orderBy("t")
    flagged = rows.join(ends, ["key", "block"]).withColumn("previous", F.coalesce(F.lag("t").over(within), "before"))
    flagged = flagged.withColumn("new", (F.col("previous").isNull() | (F.col("t") - F.col("previous") > gap_seconds * MICROS)).cast("int"))
    flagged = flagged.withColumn("run", F.sum("new").over(within.rowsBetween(W.unboundedPreceding, 0)))
    # A block's part of a session becomes a row before the blocks of a key meet.
    parts = flagged.groupBy("key", "block", "run").agg(F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.count(F.lit(1)).alias("n"), F.max("new").alias("new"))
    number = F.sum("new").over(W.partitionBy("key").orderBy("block", "run").rowsBetween(W.unboundedPreceding, 0)) - 1
    return parts.withColumn("session", number).groupBy("key", "session").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))


def interval_join(points: DataFrame, intervals: DataFrame, *, by: str, on: str, start: str, end: str, width_seconds: int) -> DataFrame:
    """Pairs ``point, span`` (structs) of a key where ``start <= on < end``.

    Intervals are entered into each piece of ``width_seconds`` that they touch, and points
    into one, so this is an equality join that adaptive execution may split. An interval of
    more than MOST_PIECES pieces is entered at a width so many times as great, or more:
    points have a row for each width that is in use. Nulls match nothing, repeated rows
    match each; an empty table gives no pairs.
    """
    piece = lambda t: F.floor(t / (F.lit(width_seconds * MICROS).cast("double") * F.pow(F.lit(float(MOST_PIECES)), F.col("level"))))
    s = intervals.select(F.col(by).alias("key"), micros(intervals, start).alias("a"), micros(intervals, end).alias("z"), F.struct("*").alias("span")).where("key is not null and a < z")
    length = (F.col("z") - F.col("a")) / (width_seconds * MICROS)
    s = s.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log(length) / math.log(MOST_PIECES)) - 1).cast("int"))
    # Ten numbers at most, taken before intervals are cut into pieces.
    levels = [r.level for r in s.select("level").distinct().collect()]
    s = s.withColumn("piece", F.explode(F.sequence(piece(F.col("a")), piece(F.col("z") - 1))))
    p = points.select(F.col(by).alias("key"), micros(points, on).alias("t"), F.struct("*").alias("point"))
    p = p.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("piece", piece(F.col("t")))
    return p.join(s, ["key", "level", "piece"]).where("t >= a and t < z").select("point", "span")

"""Items that hold more than a share of their group's rows."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import Workspace

#: Counters of all groups that a task holds before it sends them on, and rows of a list that is broadcast.
MOST_COUNTERS, MOST_BROADCAST = 200_000, 100_000


class Counters:
    """Counters of the items of a group, few enough for a share: any item missing has had at most ``error`` rows, any count is short by at most that."""

    def __init__(self, most: int):
        self.most, self.rows, self.error = most, 0, 0
        self.counts: dict = {}

    def add(self, item, n: int) -> None:
        self.rows += n
        self.counts[item] = self.counts.get(item, 0) + n
        if len(self.counts) > 2 * self.most:
            self.shrink()

    def shrink(self) -> None:
        """Leave the ``most`` greatest, each less by the next one's count."""
        if len(self.counts) > self.most:
            less = sorted(self.counts.values(), reverse=True)[self.most]
            self.error += less
            self.counts = {k: n - less for k, n in self.counts.items() if n > less}


def heavy_items(rows: DataFrame, *, by: str, item: str, share: float) -> DataFrame:
    """``group, item, n, total``: items with more than ``share`` of the rows of their group, exactly counted.

    1. Each task keeps a group's items in 1 / share counters. Merged, they bound each item's
       count from above; items whose bound is too low are none.
    2. The others are counted in a second pass.

    No state grows with the number of items. Null groups and items count as values;
    repeated rows count each; an empty table gives no rows. ValueError if share is not
    between 0 and 1.
    """
    if not 0 < share < 1:
        raise ValueError("a share is above 0 and below 1")
    most = math.ceil(1 / share)
    work = Workspace(rows.sparkSession)
    held = rows.select(F.col(by).alias("group"), F.col(item).alias("item"))
    kinds = {c: held.schema[c].dataType.simpleString() for c in ("group", "item")}

    def count(batches):
        found: dict = {}

        def sent(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for group, c in found.items():
                c.shrink()
                # A row without an item has what is common to the group.
                out.append((group, None, True, 0, c.rows, c.error))
                out += [(group, x, False, n, 0, 0) for x, n in c.counts.items()]
            found.clear()
            types = (b.column("group").type, b.column("item").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["group", "item", "whole", "n", "rows", "error"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            last = b
            own = pa.Table.from_batches([b]).append_column("one", pa.array([1] * b.num_rows)).group_by(["group", "item"]).aggregate([("one", "sum")])
            batch = defaultdict(list)
            for g, x, n in zip(*(own.column(c).to_pylist() for c in ("group", "item", "one_sum")), strict=True):
                batch[g].append((x, n))
            for g, items in batch.items():
                c = found.setdefault(g, Counters(most))
                for x, n in items:
                    c.add(x, n)
            if sum(len(c.counts) for c in found.values()) > MOST_COUNTERS:
                yield from sent(b)
        if last is not None:
            yield from sent(last)

    parts = work.save(held.mapInArrow(count, f"group {kinds['group']}, item {kinds['item']}, whole boolean, n bigint, rows bigint, error bigint"), "counters")
    totals = work.save(parts.where("whole").groupBy(F.col("group").alias("g")).agg(F.sum("rows").alias("total"), F.sum("error").alias("error")), "totals")
    over = lambda n: n > F.lit(Decimal(str(share))) * F.col("total")
    bound = parts.where("not whole").groupBy("group", "item").agg(F.sum("n").alias("n"))
    hopeful = bound.join(totals, F.col("group").eqNullSafe(F.col("g"))).where(over(F.col("n") + F.col("error")))
    hopeful = work.save(hopeful.select("g", F.col("item").alias("x")), "candidates")
    few = F.broadcast(hopeful) if hopeful.count() <= MOST_BROADCAST else hopeful
    exact = held.join(few, F.col("group").eqNullSafe(F.col("g")) & F.col("item").eqNullSafe(F.col("x"))).groupBy("group", "item").agg(F.count(F.lit(1)).alias("n"))
    return exact.join(totals.drop("error"), F.col("group").eqNullSafe(F.col("g"))).where(over(F.col("n"))).select("group", "item", "n", "total")

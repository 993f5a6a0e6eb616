"""Join on the differences of two columns, over a grid that follows the bands."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import Workspace

#: Rows of a side in one place at most; of columns with an open band, cells at most and places of a row from which a grid is made coarser.
PLACE, MOST_CELLS, MOST_COPIES = 4096, 256, 16
#: Rows that a row should find in its cell where bands are narrow, and cells of an equality.
AIM, EQUAL_CELLS = 64, 1 << 20

#: The least and the greatest difference of a right and a left value; None is without limit.
Band = tuple[float | None, float | None]


def depth_edges(column: DataFrame, cells: int) -> list:
    """Bounds between cells that hold about as many values each; distinct, ascending."""
    if cells < 2:
        return []
    found = column.agg(F.percentile_approx(column.columns[0], [k / cells for k in range(1, cells)], 100 * cells)).first()[0]
    return sorted(set(found or []))


def cell_of(value: Column, edges: list, kind: str) -> Column:
    """How many edges are at or below a value: a search by halves, so that a cell costs few comparisons."""
    if not edges:
        return F.lit(0)

    def within(a: int, z: int) -> Column:
        if a == z:
            return F.lit(a)
        mid = (a + z) // 2
        return F.when(value < F.lit(edges[mid]).cast(kind), within(a, mid)).otherwise(within(mid + 1, z))

    return within(0, len(edges))


def _copies(edges: list, band: Band, right: list) -> float:
    """Cells that a right value's band touches, in the mean over some right values."""
    n = len(edges) + 1
    at = lambda x: sum(e <= x for e in edges)
    lo = [0 if band[1] is None else at(x - band[1]) for x in right]
    hi = [n - 1 if band[0] is None else at(x - band[0]) for x in right]
    return sum(b - a + 1 for a, b in zip(lo, hi, strict=True)) / max(1, len(right))


@dataclass
class _Even:
    """Cells of equal size, so many and more in the direction of a closed band."""

    base: float
    size: float
    cells: float

    def at(self, value: Column) -> Column:
        # Doubles, differences, quotients and floors keep the order of values of any numeric type, and no pair is lost as long as that is kept.
        return F.floor((value.cast("double") - F.lit(self.base)) / F.lit(self.size)).cast("bigint")

    def wider(self, by: float) -> _Even:
        return _Even(self.base, self.size * by, self.cells / by)


def _even(column: DataFrame, band: Band) -> _Even:
    """The finest cells of a closed band: as wide as the band, so that it reaches two or three. A tenth of the values may be far off."""
    lo, hi = column.agg(F.percentile_approx(F.col(column.columns[0]).cast("double"), [0.05, 0.95], 1000)).first()[0] or (0.0, 0.0)
    if not math.isfinite(hi - lo):
        lo, hi = 0.0, 1.0
    size = max(float(band[1] - band[0]), (hi - lo) / EQUAL_CELLS) or 1.0
    return _Even(lo, size, max(1.0, (hi - lo) / size))


def _coarser(even: dict[str, _Even], rows: DataFrame, n: int) -> dict[str, _Even]:
    """Wider cells where rows are few for the bands: a cell with about AIM rows costs fewer copies than smaller ones.

    How many rows a row finds in its cell is counted, and cells are made smaller again where
    values are crowded, down to the width of the bands.
    """
    spare, by = AIM * math.prod(e.cells for e in even.values()) / max(1, n), dict.fromkeys(even, 1.0)
    for k, c in enumerate(sorted(even, key=lambda c: even[c].cells)):
        by[c] = min(even[c].cells, max(1.0, spare ** (1 / (len(even) - k))))
        spare /= by[c]
    while True:
        out = {c: e.wider(by[c]) for c, e in even.items()}
        if max(by.values(), default=1.0) == 1.0:
            return out
        n2 = rows.groupBy(*(e.at(F.col(c)).alias(c) for c, e in out.items())).count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
        if n2 <= 4 * AIM * n:
            return out
        by = {c: max(1.0, b / 4) for c, b in by.items()}


def band_join(left: DataFrame, right: DataFrame, *, x: tuple[str, str, Band], y: tuple[str, str, Band]) -> DataFrame:
    """Pairs ``l, r`` (structs) whose two differences lie in bands, bounds included.

    ``x`` and ``y`` name a left and a right column and the band of right less left; bounds
    are numbers in the columns' unit, and None leaves a side open, so ``(0, None)`` is the
    inequality left <= right. Columns are numeric, of exact types for exact bounds.

    Each left row lies in one cell of a grid; a right row has a copy in each cell that its
    bands reach. In the direction of a closed band cells are as wide as the band or, where
    rows are few, wider, so that the pairs looked at are in proportion to the pairs found
    and to the rows (where rows spread within a band). In the direction of an open band the
    bounds are quantiles of the left values; if a right row would have more than about
    MOST_COPIES copies there, they are fewer. A cell is split by a hash until no place has more
    than about PLACE rows of a side, so a value that a third of the rows share is many places.

    Nulls match nothing, NaN neither; repeated rows match each; an empty table gives no pairs.
    """
    work = Workspace(left.sparkSession)
    (lx, rx, bx), (ly, ry, by) = x, y
    usable = lambda df, *cols: df.where(reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols)))
    kinds = {"x": left.schema[lx].dataType.simpleString(), "y": left.schema[ly].dataType.simpleString()}
    of = {"l": (lx, ly), "r": (rx, ry)}
    value = lambda side, c: F.col(side).getField(of[side]["xy".index(c)])
    values = lambda df, side: df.select(*(value(side, c).alias(c) for c in "xy"))
    ls = work.save(usable(left, lx, ly).select(F.struct("*").alias("l")), "left")
    rs = work.save(usable(right, rx, ry).select(F.struct("*").alias("r")), "right")
    n_left, n_right, at = ls.count(), rs.count(), values(ls, "l")

    bands = {"x": bx, "y": by}
    even = {c: _even(at.select(c), band) for c, band in bands.items() if None not in band}
    even = _coarser(even, at.select(*even), n_left) if even else even
    cells = min(MOST_CELLS, max(1, math.ceil(math.sqrt(max(n_left, n_right) / PLACE))))
    grid = {c: depth_edges(at.select(c), cells) for c in "xy" if c not in even}
    some = {c: values(rs, "r").agg(F.percentile_approx(c, [k / 32 for k in range(1, 32)], 1000)).first()[0] or [] for c in grid}
    while (n := {c: _copies(e, bands[c], some[c]) for c, e in grid.items()}) and math.prod(n.values()) > MOST_COPIES and max(map(len, grid.values())) > 0:
        wide = max((c for c in n if grid[c]), key=n.get)
        grid[wide] = grid[wide][1::2]

    def cell(c: str, of_value: Column) -> Column:
        return even[c].at(of_value) if c in even else cell_of(of_value, grid[c], kinds[c]).cast("bigint")

    def reach(c: str) -> Column:
        lo, hi = bands[c]
        first = F.lit(0).cast("bigint") if hi is None else cell(c, value("r", c) - F.lit(hi))
        last = F.lit(len(grid[c])).cast("bigint") if lo is None else cell(c, value("r", c) - F.lit(lo))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    ls = ls.withColumns({"i": cell("x", value("l", "x")), "j": cell("y", value("l", "y"))})
    rs = rs.withColumn("i", reach("x")).withColumn("j", reach("y"))
    # Of cells with more than PLACE rows of a side, perhaps none of the other: a row stands for that many, so the list is short.
    sizes = lambda df, name: df.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / PLACE).cast("int").alias(name))
    full = F.broadcast(work.save(sizes(ls, "ls").join(sizes(rs, "rs"), ["i", "j"], "full").fillna(0).where("ls > 1 or rs > 1"), "cells"))

    # Drawn from written rows in their order: the same when a task runs again.
    places = lambda n: F.coalesce(F.col(n), F.lit(1))
    spread = lambda n: F.floor(F.rand(7) * places(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), places(n) - 1))
    a = ls.join(full, ["i", "j"], "left").where(places("rs") > 0).withColumn("p", spread("ls")).withColumn("q", every("rs")).select("i", "j", "p", "q", "l")
    b = rs.join(full, ["i", "j"], "left").where(places("ls") > 0).withColumn("q", spread("rs")).withColumn("p", every("ls")).select("i", "j", "p", "q", "r")

    def inside(c: str) -> list[Column]:
        # In the form in which cells are found, so that rounding loses no pair.
        l, r, (lo, hi) = value("l", c), value("r", c), bands[c]  # noqa: E741
        return [l <= r - F.lit(lo)] * (lo is not None) + [l >= r - F.lit(hi)] * (hi is not None)

    met = a.join(b, ["i", "j", "p", "q"])
    return reduce(DataFrame.where, inside("x") + inside("y"), met).select("l", "r")

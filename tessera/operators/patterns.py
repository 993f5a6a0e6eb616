"""Row-pattern matching over the events of a key, in time order.

A pattern is an automaton over symbols. Rows are dealt out by ranges of key and time, so a
key with many events lies in several tasks; each task sums its part of a key up as a map of
the automaton's states, the maps are composed, and parts that go on from one before are
run once more with what was open there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .temporal import micros

# ---- patterns -------------------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """A part of a pattern: places that hold a symbol each, and which of them may begin, follow one another and end."""

    symbols: tuple[str, ...]
    first: frozenset[int]
    last: frozenset[int]
    follow: frozenset[tuple[int, int]]
    empty: bool

    def _moved(self, by: int) -> Pattern:
        move = lambda s: frozenset(k + by for k in s)
        return Pattern(self.symbols, move(self.first), move(self.last), frozenset((a + by, b + by) for a, b in self.follow), self.empty)

    def __add__(self, other: Pattern) -> Pattern:
        """This, then the other."""
        o = other._moved(len(self.symbols))
        follow = self.follow | o.follow | {(a, b) for a in self.last for b in o.first}
        return Pattern(self.symbols + o.symbols, self.first | (o.first if self.empty else frozenset()), o.last | (self.last if o.empty else frozenset()), follow, self.empty and o.empty)

    def __or__(self, other: Pattern) -> Pattern:
        """This or the other."""
        o = other._moved(len(self.symbols))
        return Pattern(self.symbols + o.symbols, self.first | o.first, self.last | o.last, self.follow | o.follow, self.empty or o.empty)

    def some(self) -> Pattern:
        """Once or more often."""
        return Pattern(self.symbols, self.first, self.last, self.follow | {(a, b) for a in self.last for b in self.first}, self.empty)

    def maybe(self) -> Pattern:
        return Pattern(self.symbols, self.first, self.last, self.follow, True)

    def any(self) -> Pattern:
        """As often as there is, or not at all."""
        return self.some().maybe()


def row(*symbols: str) -> Pattern:
    """One row with one of these symbols."""
    out = Pattern((symbols[0],), frozenset({0}), frozenset({0}), frozenset(), False)
    return out | row(*symbols[1:]) if symbols[1:] else out


class Automaton:
    """A pattern's places, run over a key's rows; a set of places is a number with their bits."""

    def __init__(self, pattern: Pattern, names: list[str]):
        self.size = len(pattern.symbols)
        bits = lambda s: sum(1 << k for k in s)
        self.on = [bits(k for k, s in enumerate(pattern.symbols) if s == name) for name in names] + [0]
        self.first, self.last = bits(pattern.first), bits(pattern.last)
        self.follow = [bits(b for a, b in pattern.follow if a == k) for k in range(self.size)]
        self._after: dict[tuple[int, int], int] = {}

    def after(self, places: int, symbol: int) -> int:
        """Places that a row with the symbol leads to from some."""
        if (places, symbol) not in self._after:
            to = 0
            for k in _bits(places):
                to |= self.follow[k]
            self._after[places, symbol] = to & self.on[symbol]
        return self._after[places, symbol]

    def step(self, open_: dict[int, tuple], symbol: int, me: tuple | None) -> dict[int, tuple]:
        """Latest and earliest start of what is open at each place after a row; ``me`` starts anew, if given."""
        out: dict[int, tuple] = {}
        for k, (late, early) in open_.items():
            for j in _bits(self.follow[k] & self.on[symbol]):
                have = out.get(j)
                out[j] = (max(late, have[0]), min(early, have[1])) if have else (late, early)
        if me is not None:
            for j in _bits(self.first & self.on[symbol]):
                out[j] = (me, out[j][1] if j in out else me)
        return out

    def ended(self, open_: dict[int, tuple]) -> tuple | None:
        """Latest and earliest start of a match that ends here."""
        hits = [x for k, x in open_.items() if self.last >> k & 1]
        return (max(late for late, _ in hits), min(early for _, early in hits)) if hits else None


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


# ---- the operator ---------------------------------------------------------------------


def _start(kind: str) -> str:
    return f"struct<t:bigint,id:{kind}>"


def _as_start(x: tuple | None) -> dict | None:
    return None if x is None else {"t": x[0], "id": x[1]}


def match_rows(events: DataFrame, pattern: Pattern, *, by: str, on: str, id_col: str, symbols: dict[str, Column]) -> DataFrame:
    """``key, end_id, end_us, latest_id, latest_us, earliest_id, earliest_us``: rows at which a match ends.

    A key's rows are in order of time, then id. A row has the first symbol whose condition
    holds; one without any is in no match. A match is a run of consecutive rows of a key.
    Matches may overlap: there is one result for each row at which any ends, with the start
    of the shortest and that of the longest of them.

    Rows with a null key, time or id are left out, and matches run on over them; repeated
    rows count each, in any order, as they are equal. An empty table gives no rows; other
    columns do not matter. ValueError if the pattern matches no row at all, or names a
    symbol that is not given.

    A task holds a range of keys and times; for a key in several tasks each sends one row,
    so what meets in one place is a row for each task.
    """
    names = list(symbols)
    if pattern.empty or set(pattern.symbols) - set(names):
        raise ValueError("a pattern needs rows, and conditions for all its symbols")
    automaton = Automaton(pattern, names)
    none = len(names)
    symbol = F.coalesce(*(F.when(c, F.lit(k)) for k, c in enumerate(symbols.values())), F.lit(none)).cast("int")
    rows = events.select(F.col(by).alias("key"), micros(events, on).alias("t"), F.col(id_col).alias("id"), symbol.alias("symbol"))
    rows = rows.where("key is not null and t is not null and id is not null")
    id_kind, key_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "key"))
    order = ["key", "t", "id", "symbol"]
    work = Workspace(events.sparkSession)

    def local(batches):
        """Matches within a task's part of a key; its last row also has the part's map of places and what is open."""
        now, held, open_, maps = None, None, {}, {}
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*order, "part")]
            out = []
            for key, t, id_, s, part in zip(*columns, strict=True):
                if held is not None:
                    out.append((*held, _summary(maps, open_) if key != now else None))
                if key != now:
                    now, open_, maps = key, {}, {k: 1 << k for k in range(automaton.size)}
                maps = {k: to for k, x in maps.items() if (to := automaton.after(x, s))}
                open_ = automaton.step(open_, s, (t, id_))
                late, early = automaton.ended(open_) or (None, None)
                held = (key, t, id_, s, part, _as_start(late), _as_start(early))
            if out:
                yield _local_batch(out, b)
            last = b
        if held is not None:
            yield _local_batch([(*held, _summary(maps, open_))], last)

    def _local_batch(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        start = pa.struct([("t", pa.int64()), ("id", like.column("id").type)])
        open_type = pa.struct([("maps", pa.list_(pa.struct([("place", pa.int32()), ("to", pa.int64())]))), ("open", pa.list_(pa.struct([("place", pa.int32()), ("late", start), ("early", start)])))])
        kinds = (like.column("key").type, pa.int64(), like.column("id").type, pa.int32(), pa.int32(), start, start, open_type)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*order, "part", "late", "early", "summary"])

    start = _start(id_kind)
    opened = f"array<struct<place:int,late:{start},early:{start}>>"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = f"key {key_kind}, t bigint, id {id_kind}, symbol int, part int, late {start}, early {start}, summary struct<maps:array<struct<place:int,to:bigint>>,open:{opened}>"
    found = work.save(dealt.mapInArrow(local, schema), "parts")

    # Keys in several parts; a part goes on from the one before in at most one key.
    parts = work.save(found.where("summary is not null").select("key", "part", "summary"), "maps")
    many = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")

    def composed(key, table):
        """What is open before each part of a key but the first."""
        before: dict[int, tuple] = {}
        out = []
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            if before:
                out.append({"key": r["key"], "part": r["part"], "carried": [{"place": k, "late": _as_start(x), "early": _as_start(y)} for k, (x, y) in before.items()]})
            after: dict[int, tuple] = {o["place"]: (_pair(o["late"]), _pair(o["early"])) for o in r["summary"]["open"]}
            for m in r["summary"]["maps"]:
                if m["place"] in before:
                    late, early = before[m["place"]]
                    for j in _bits(m["to"]):
                        after[j] = (max(late, after[j][0]), min(early, after[j][1])) if j in after else (late, early)
            before = after
        kind = table.schema.field("summary").type.field("open").type.value_type.field("late").type
        return pa.Table.from_pylist(out, pa.schema([("key", table.schema.field("key").type), ("part", pa.int32()), ("carried", pa.list_(pa.struct([("place", pa.int32()), ("late", kind), ("early", kind)])))]))

    carried = parts.join(many, "key", "left_semi").groupBy("key").applyInArrow(composed, f"key {key_kind}, part int, carried {opened}")
    # A row for each part at most, however many keys there are.
    carried = F.broadcast(work.save(carried, "carried"))

    def resumed(batches):
        """The rows of parts that go on, with matches that began before."""
        now, open_ = None, {}
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*order, "part", "late", "early", "carried")]
            out = []
            for key, t, id_, s, part, late, early, before in zip(*columns, strict=True):
                if (key, part) != now:
                    now, open_ = (key, part), {o["place"]: (_pair(o["late"]), _pair(o["early"])) for o in before}
                open_ = automaton.step(open_, s, None) if open_ else open_
                if hit := automaton.ended(open_) if open_ else None:
                    late, early = late or _as_start(hit[0]), _as_start(hit[1])
                if late:
                    out.append((key, t, id_, late, early))
            if out:
                kind = b.column("late").type
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (b.column("key").type, pa.int64(), b.column("id").type, kind, kind), strict=True)], ["key", "t", "id", "late", "early"])

    on_part = ["key", "part"]
    again = found.drop("summary").join(carried, on_part).repartition(*on_part).sortWithinPartitions("key", "part", "t", "id", "symbol").select(*order, "part", "late", "early", "carried")
    again = again.mapInArrow(resumed, f"key {key_kind}, t bigint, id {id_kind}, late {start}, early {start}")
    whole = found.join(carried, on_part, "left_anti").where("late is not null").select("key", "t", "id", "late", "early")
    return whole.union(again).select("key", F.col("id").alias("end_id"), F.col("t").alias("end_us"), F.col("late.id").alias("latest_id"), F.col("late.t").alias("latest_us"), F.col("early.id").alias("earliest_id"), F.col("early.t").alias("earliest_us"))


def _pair(start: dict) -> tuple:
    return start["t"], start["id"]


def _summary(maps: dict[int, int], open_: dict[int, tuple]) -> dict:
    return {"maps": [{"place": k, "to": x} for k, x in maps.items()], "open": [{"place": k, "late": _as_start(late), "early": _as_start(early)} for k, (late, early) in open_.items()]}

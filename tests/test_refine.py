"""Quantiles, heavy items, sliding counts, triangles and the join of streams against plain versions."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import heavy, quantiles, triangles
from tessera.operators.heavy import Counters, heavy_items
from tessera.operators.quantiles import group_quantiles
from tessera.operators.sliding import distinct_in_range
from tessera.sources.workspace import Workspace
from tessera.streaming.joins import within_join
from tessera.streaming.windows import run_to_table

# ---- quantiles ------------------------------------------------------------------------


@pytest.mark.parametrize("bins", [quantiles.BINS, 50])
def test_quantiles_equal_sorted_values(spark, monkeypatch, bins):
    """A group with most rows and few values, a null key, the ends of the type's range."""
    monkeypatch.setattr(quantiles, "BINS", bins)
    r = random.Random(bins)
    rows = [("hot", r.choice([1, 2, 2, 2, 900])) for _ in range(400)] + [(f"g{r.randrange(9)}", r.randrange(-1000, 1000)) for _ in range(300)]
    rows += [(None, 5), (None, -(2**63)), (None, 2**63 - 1), ("none", None), ("hot", None)]
    shares = [0, 0.001, 0.25, 0.5, 0.9, 1]
    got = group_quantiles(spark.createDataFrame([(g, v, 1, 2) for g, v in rows], "g string, v bigint, lo int, n int").drop("n"), by=["g"], value="v", shares=shares)
    want = []
    for g in {g for g, v in rows if v is not None}:
        own = sorted(v for k, v in rows if k == g and v is not None)
        want += [(g, float(s), len(own), own[max(1, math.ceil(Decimal(str(s)) * len(own))) - 1]) for s in shares]
    assert sorted(((x.g, float(x.share), x.n, x.quantile) for x in got.collect()), key=str) == sorted(want, key=str)


def test_quantiles_of_decimals_and_edges(spark):
    df = spark.createDataFrame([(k % 2, k, Decimal(k) / 100) for k in range(-50, 50)], "a int, b int, v decimal(12,2)")
    got = {(x.a, float(x.share)): x.quantile for x in group_quantiles(df, by=["a"], value="v", shares=[0.5, 1.0]).collect()}
    assert got == {(0, 0.5): Decimal("-0.02"), (0, 1.0): Decimal("0.48"), (1, 0.5): Decimal("-0.01"), (1, 1.0): Decimal("0.49")}
    assert group_quantiles(df.limit(0), by=["a"], value="v", shares=[0.5]).count() == 0


# ---- heavy items ----------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.08, 0.03, 0.011])
def test_heavy_items_equal_counts(spark, share):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.choice(["x", "x", "y", None, str(int(r.expovariate(0.02))), str(int(r.expovariate(0.3)))])) for _ in range(3000)]
    got = heavy_items(spark.createDataFrame([(*x, 1) for x in rows], "g string, i string, n int").repartition(7), by="g", item="i", share=share)
    totals = Counter(g for g, _ in rows)
    want = [(g, i, n, totals[g]) for (g, i), n in Counter(rows).items() if n > Decimal(str(share)) * totals[g]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_heavy_edges(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 1.5), ("a", None)], "g string, i double")
    assert [tuple(r) for r in heavy_items(df, by="g", item="i", share=0.5).collect()] == [("a", 1.5, 2, 3)]
    assert heavy_items(df.limit(0), by="g", item="i", share=0.5).count() == 0
    with pytest.raises(ValueError):
        heavy_items(df, by="g", item="i", share=1.0)


def test_counters_are_few_and_their_error_bounds_hold():
    """State never grows with the items, and what merged counters say is at most so far off."""
    r = random.Random(2)
    for _ in range(50):
        most, merged, error, rows = r.randrange(1, 30), Counter(), 0, []
        for _ in range(r.randrange(1, 5)):
            c, part = Counters(most), [int(r.expovariate(r.choice([0.5, 0.01]))) for _ in range(r.randrange(500))]
            for x in part:
                c.add(x, 1)
                assert len(c.counts) <= 2 * most
            c.shrink()
            assert len(c.counts) <= most and c.rows == len(part) and c.error * (most + 1) <= len(part)
            merged.update(c.counts)
            error += c.error
            rows += part
        assert all(merged[x] <= n <= merged[x] + error for x, n in Counter(rows).items())


def test_counters_are_sent_on_when_there_are_many_groups(spark, monkeypatch):
    monkeypatch.setattr(heavy, "MOST_BROADCAST", 3)
    rows = [(g, i % 3) for g in range(300) for i in range(4)]
    got = heavy_items(spark.createDataFrame(rows, "g int, i int"), by="g", item="i", share=0.4)
    assert sorted(map(tuple, got.collect())) == [(g, 0, 2, 4) for g in range(300)]


# ---- sliding counts -------------------------------------------------------------------

T = datetime(2024, 1, 1)


@pytest.mark.parametrize("seconds", [0, 50, 3600])
@pytest.mark.parametrize("block", [86_400, 40])
def test_sliding_counts_equal_sets(spark, seconds, block):
    r = random.Random(seconds + block)
    rows = [("hot" if r.random() < 0.5 else r.choice("abc"), r.randrange(500), "v" if r.random() < 0.4 else r.choice(["w", "x", "y", "z", None]), i) for i in range(600)]
    rows += [(None, 3, "v", 700), ("a", None, "v", 701), *[("a", 5, "w", 702)] * 2]
    df = spark.createDataFrame([(k, None if t is None else T + timedelta(seconds=t), v, i) for k, t, v, i in rows], "k string, ts timestamp_ntz, v string, t int")
    got = distinct_in_range(df, by="k", on="ts", value="v", seconds=seconds, block_seconds=block)
    want = [(i, None if k is None or t is None else len({v for a, b, v, _ in rows if a == k and b is not None and t - seconds <= b <= t and v is not None})) for k, t, v, i in rows]
    assert sorted(((x.t, x.distinct) for x in got.collect()), key=str) == sorted(want, key=str)
    assert distinct_in_range(df.limit(0), by="k", on="ts", value="v", seconds=1).count() == 0


# ---- triangles ------------------------------------------------------------------------


def edges(seed, n, most):
    """A third of the edges have one end in common."""
    r = random.Random(seed)
    return [(7 if r.random() < 0.35 else r.randrange(most), r.randrange(most)) for _ in range(n)]


@pytest.mark.parametrize("cell", [triangles.CELL, 60])
def test_triangles_equal_nested_loops(spark, monkeypatch, cell):
    monkeypatch.setattr(triangles, "CELL", cell)
    ab, bc, ca = edges(1, 300, 40), edges(2, 300, 40), edges(3, 300, 40)
    frame = lambda rows, names: spark.createDataFrame([*rows, (None, 1), (1, None)], names)
    got = triangles.triangles(frame(ab, "a int, b int"), frame(bc, "x bigint, y bigint"), frame(ca, "cell bigint, kind bigint"))
    want = sorted({(a, b, c) for a, b in ab for x, c in bc if x == b for y, z in ca if y == c and z == a})
    assert sorted(map(tuple, got.collect())) == want and want
    assert triangles.triangles(frame(ab, "a int, b int"), frame(bc, "x bigint, y bigint"), frame(ca, "c int, a int").limit(0)).count() == 0


def test_triangles_shuffle_less_than_two_joins(spark, monkeypatch):
    """Cells are bounded where one value has a third of the edges, and all copies of edges are fewer than the rows between two joins."""
    monkeypatch.setattr(triangles, "CELL", 3000)
    n = 30_000
    pairs = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(300))).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(600)).alias("y"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(300)).alias("z")).cache()
    ab, bc, ca = (pairs.select(*c).distinct() for c in (("x", "y"), ("y", "z"), ("z", "x")))
    both = [df.select(F.lit(k).alias("kind"), *(F.col(df.columns["ab bc ca".split()[k].index(c)]).cast("bigint").alias(c) if c in "ab bc ca".split()[k] else F.lit(None).cast("bigint").alias(c) for c in "abc")) for k, df in enumerate((ab, bc, ca))]
    out = triangles.dealt(both[0].union(both[1]).union(both[2]), Workspace(spark))
    sizes = [r["count"] for r in out.groupBy("depth", "cell").count().collect()]
    between = ab.join(bc, "y").count()
    assert max(sizes) <= 3000 and sum(sizes) < between
    pairs.unpersist()


# ---- streams --------------------------------------------------------------------------


def test_streams_meet_whatever_their_order(spark, tmp_path):
    """Rows come in any order within the allowance, later ones are left out; what is past leaves the state."""
    at = lambda h: T + timedelta(hours=h)
    batches = [
        ([("u", at(1), 1), (None, at(1), 2)], []), ([], [("u", at(5), 11), ("v", at(3), 12)]), ([("v", at(2), 3)], [("u", at(30), 13)]),
        ([("w", at(100), 4)], [("w", at(100), 14)]), ([("w", at(200), 5)], [("w", at(201), 15)]), ([("u", at(3), 6)], [("u", at(4), 16), ("w", at(202), 17)]), ([("w", at(300), 7)], [("w", at(300), 18)]),
    ]
    kind = "k string, ts timestamp_ntz, i int"
    for k, sides in enumerate(batches):
        for name, rows in zip("ab", sides, strict=True):
            spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
    stream = lambda name: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    pairs = within_join(stream("a"), stream("b"), by="k", on="ts", seconds=86_400, late="10 hours").select(F.col("first.i").alias("a"), F.col("later.i").alias("b"))
    seen = []
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event): ...
        def onQueryIdle(self, event): ...
        def onQueryTerminated(self, event): ...

        def onQueryProgress(self, event):
            seen.extend(s.numRowsTotal for s in event.progress.stateOperators)

    spark.streams.addListener(listener := Listener())
    try:
        got = sorted(map(tuple, run_to_table(pairs, f"file://{tmp_path}").collect()))
    finally:
        spark.streams.removeListener(listener)
    assert got == [(1, 11), (3, 12), (4, 14), (5, 15), (5, 17), (7, 18)]
    assert max(seen, default=0) <= 12
    batch = within_join(*(spark.read.schema(kind).parquet(f"{tmp_path}/{n}/*") for n in "ab"), by="k", on="ts", seconds=86_400)
    assert sorted((r.first.i, r.later.i) for r in batch.collect()) == sorted([*got, (6, 11), (6, 16), (1, 16)])


# ---- triangles in cells ---------------------------------------------------------------


def test_cells_take_few_copies_of_edges_that_meet_nearby(spark):
    """Sixteen tables beside each other: edges have hardly more copies than for one, and n edges without order at most about the root of n over a cell's."""
    n = 16 * 20_000
    ids = spark.range(n).withColumn("t", F.floor(F.col("id") / 20_000))
    near = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2000)) + F.col("t") * 2000).alias(c) for k, c in enumerate("abc")]
    lines = Workspace(spark).save(ids.select(*near), "lines")
    found = {}
    for name, one in (("near", lines), ("one", lines.where("a < 2000"))):
        null = F.lit(None).cast("bigint")
        rows = [one.select(F.lit(k).alias("kind"), *(F.col(c) if c in names else null.alias(c) for c in "abc")) for k, names in enumerate(triangles.KINDS)]
        out = triangles.dealt(rows[0].union(rows[1]).union(rows[2]), Workspace(spark))
        found[name] = out.count() / (3 * one.count()), out.groupBy("depth", "cell").count().agg(F.max("count")).first()[0]
    assert found["near"][0] < 3 and found["one"][0] == 1 and max(v[1] for v in found.values()) <= triangles.FEW


@pytest.mark.parametrize("cell", [triangles.CELL, 60])
def test_triangles_by_b_equal_nested_loops(spark, monkeypatch, cell):
    """Edges in one cell and in several, cells split by hashes, and edges that are there twenty times."""
    monkeypatch.setattr(triangles, "CELL", cell)
    ab, bc, ca = edges(1, 300, 40), edges(2, 300, 40), edges(3, 300, 40)
    want = {(a, b, c) for a, b in ab for x, c in bc if x == b for y, z in ca if y == c and z == a}
    want = sorted((b, sum(t[1] == b for t in want), len({t[0] for t in want if t[1] == b}), len({t[2] for t in want if t[1] == b})) for b in {t[1] for t in want})
    frame = lambda rows, names, times: spark.createDataFrame([*rows * times, (None, 1), (1, None)], names)
    for times in (1, 20):
        got = triangles.triangles_by_b(frame(ab, "a int, b int", times), frame(bc, "x bigint, y bigint", 1), frame(ca, "c int, a int", times))
        assert sorted(map(tuple, got.collect())) == want and want
    assert triangles.triangles_by_b(frame(ab, "a int, b int", 1), frame(bc, "x int, y int", 1).limit(0), frame(ca, "c int, a int", 1)).count() == 0


def test_cells_of_large_tables_have_finer_ranges(spark, monkeypatch):
    """Where 128 ranges would each be too full a cell there are more, so nothing is split by hashes; packed rows hold the same edges in few bytes."""
    monkeypatch.setattr(triangles, "CELL", 2000)
    monkeypatch.setattr(triangles, "FEW", 100)
    n = 64 * 2500
    ids = spark.range(n).withColumn("t", F.floor(F.col("id") / 2500))
    lines = Workspace(spark).save(ids.select(*((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(500)) + F.col("t") * 500).alias(c) for k, c in enumerate("abc"))), "lines")
    null = F.lit(None).cast("bigint")
    rows = [lines.select(F.lit(k).alias("kind"), *(F.col(c) if c in names else null.alias(c) for c in "abc")) for k, names in enumerate(triangles.KINDS)]
    edges = rows[0].union(rows[1]).union(rows[2])
    plain = triangles.dealt(edges, Workspace(spark)).cache()
    assert plain.where("depth > 0").count() == 0 and plain.count() < 3 * 3 * n
    packed = triangles.dealt(edges, Workspace(spark), triangles.plan(edges, 3 * n)).collect()
    got = [(r.cell, r.kind, r.alone, x, y) for r in packed for x, y in zip(*(v.tolist() for v in triangles._unpacked(r.n, r.x, r.y, r.width, bytes(r.steps))), strict=True)]
    assert set(got) == {(r.cell, r.kind, r.alone, r.x, r.y) for r in plain.collect()}
    assert sum(len(r.steps) for r in packed) < 4 * len(got)
    plain.unpersist()


def test_triangles_of_far_ids(spark):
    """Ids over all 64 bits, whose pairs have no place in a grid of 64 bits."""
    far = [-(2**63), -5, 0, 3, 2**62, 2**63 - 1]
    ab, bc, ca = ([(x, y) for k, x in enumerate(far) for j, y in enumerate(far) if (k + j) % m] for m in (2, 3, 4))
    want = sorted((a, b, c) for a, b in ab for x, c in bc if x == b for y, z in ca if y == c and z == a)
    frames = [spark.createDataFrame(rows, "x bigint, y bigint") for rows in (ab, bc, ca)]
    assert sorted(map(tuple, triangles.triangles(*frames).collect())) == want and want
    counts = sorted((b, sum(t[1] == b for t in want), len({t[0] for t in want if t[1] == b}), len({t[2] for t in want if t[1] == b})) for b in {t[1] for t in want})
    assert sorted(map(tuple, triangles.triangles_by_b(*frames).collect())) == counts

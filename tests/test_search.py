"""Nearest neighbours, row patterns and band joins against plain versions."""

import random
import re
import tracemalloc
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import band, nearest, patterns
from tessera.operators.patterns import match_rows, row
from tessera.plans.analytics import QUERIES

from .test_entry import SF

# ---- nearest neighbours ---------------------------------------------------------------


def exact(rows, k):
    """{id: [(neighbour, cosine)]} of all pairs."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    s = x @ x.T
    return {i: sorted(((j, float(s[a, b])) for b, j in enumerate(ids) if j != i), key=lambda r: (-round(r[1], 12), r[0]))[:k] for a, i in enumerate(ids)}


def recall(got, want):
    """The share of the neighbours' similarities that are reached, rank by rank; equal ones may stand for each other."""
    hit = n = 0
    for i, found in want.items():
        own = [s for _, s in got.get(i, [])]
        n += len(found)
        hit += sum(a >= b - 1e-6 for a, (_, b) in zip(own, found, strict=False))
    return hit / n


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[0], r.rank)):
        out.setdefault(r[0], []).append((r.neighbour, r.similarity))
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_neighbours_reach_their_recall(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got, want = answers(QUERIES["nearest_vectors"](spark, path)), exact(rows, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    near = {i: dict(v) for i, v in got.items()}
    assert sum(j in near[i] for i, v in want.items() for j, _ in v) / sum(map(len, want.values())) >= 0.95
    x = {i: np.array(v, np.float64) for i, v in rows}
    for i in list(got)[:50]:
        assert all(abs(s - x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])) < 1e-6 for j, s in got[i])


def test_neighbours_in_clusters_with_copies(spark, monkeypatch):
    """Lists of very different length, many copies of one vector, blocks and chunks of few rows."""
    for name, n in (("LIST", 8), ("BLOCK", 16), ("QUERIES", 32)):
        monkeypatch.setattr(nearest, name, n)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[min(k % 40, 11)] + 0.3 * rng.normal(size=8)).tolist()) for k in range(900)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got, want = answers(nearest.nearest(df, 5, id_col="id", vector_col="v")), exact(rows, 5)
    assert recall(got, want) >= 0.95
    assert [j for j, _ in got[1299]] == [0, 1000, 1001, 1002, 1003] and [j for j, _ in got[1000]] == [0, 1001, 1002, 1003, 1004]


def test_neighbours_of_other_queries_and_edges(spark):
    kind = "id int, v array<float>, vec int, node int, q int"
    bad = [(None, [1.0, 2.0]), (50, None), (51, [None, 1.0]), (52, [0.0, 0.0]), (53, [float("nan"), 1.0]), (54, [float("inf"), 1.0])]
    items = spark.createDataFrame([(*r, 1, 2, 3) for r in [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.1]), *bad]], kind)
    queries = spark.createDataFrame([(1, [1.0, 0.1], 1, 2, 3), (9, [0.0, -3.0], 1, 2, 3), (7, None, 1, 2, 3)], kind)
    got = answers(nearest.nearest(items, 2, id_col="id", vector_col="v", queries=queries))
    assert {i: [j for j, _ in v] for i, v in got.items()} == {1: [2, 3], 9: [1, 2]}
    got = answers(nearest.nearest(items, 9, id_col="id", vector_col="v"))
    assert {i: [j for j, _ in v] for i, v in got.items()} == {1: [2, 3, 4], 2: [1, 3, 4], 3: [4, 1, 2], 4: [3, 1, 2]}
    assert nearest.nearest(items.limit(0), 2, id_col="id", vector_col="v").count() == 0
    assert nearest.nearest(items.where("id = 1"), 2, id_col="id", vector_col="v").count() == 0


def test_probes_are_the_nearest_lists():
    rng = np.random.default_rng(1)
    book = nearest.Codebook((rng.normal(size=(7, 3)), rng.normal(size=(5, 3))), [])
    x = rng.normal(size=(20, 6))
    for n in (1, 3, 12, 35, 99):
        got = book.probes(x, n)
        for r, own in zip(x, got, strict=True):
            gap = [((r[:3] - a) ** 2).sum() + ((r[3:] - b) ** 2).sum() for a in book.halves[0] for b in book.halves[1]]
            assert own.tolist() == np.argsort(gap, kind="stable")[:n].tolist()


# ---- row patterns ---------------------------------------------------------------------

T = datetime(2024, 1, 1)
PATTERNS = {
    "V[VC]*E+P": row("V") + row("V", "C").any() + row("E").some() + row("P"),
    "(VC|C)+": ((row("V") + row("C")) | row("C")).some(),
    "P": row("P"),
    "V?C(E|P)?V": row("V").maybe() + row("C") + (row("E") | row("P")).maybe() + row("V"),
    "(V+C?)*P": (row("V").some() + row("C").maybe()).any() + row("P"),
}


def plain_matches(rows, regex):
    """By key: every run of rows is tried."""
    out, keys = [], {}
    for k, t, i, s in rows:
        if None not in (k, t, i):
            keys.setdefault(k, []).append((t, i, s if s in "VCEP" else "-"))
    for k, own in keys.items():
        own.sort()
        text = "".join(s for *_, s in own)
        for z in range(len(own)):
            starts = [a for a in range(z + 1) if re.fullmatch(regex, text[a : z + 1])]
            if starts:
                out.append((k, own[z][1], own[max(starts)][1], own[min(starts)][1]))
    return sorted(out)


@pytest.mark.parametrize("regex", PATTERNS)
def test_matches_equal_all_runs(spark, regex):
    """A hot key over many partitions, among keys of few rows; ties in time go by id."""
    r = random.Random(regex)
    rows = [("hot" if r.random() < 0.5 else f"k{r.randrange(60)}", r.randrange(400), i, r.choice("VVCCEEPx")) for i in range(900)]
    rows += [(None, 1, 5, "P"), ("k1", None, 6, "P"), ("k1", 3, None, "P")]
    df = spark.createDataFrame([(k, None if t is None else T + timedelta(seconds=t), i, s, 1, 2) for k, t, i, s in rows], "k string, ts timestamp_ntz, i int, s string, part int, key int")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = match_rows(df, PATTERNS[regex], by="k", on="ts", id_col="i", symbols={s: F.col("s") == s for s in "VCEP"})
        assert sorted((x.key, x.end_id, x.latest_id, x.earliest_id) for x in got.collect()) == plain_matches(rows, regex)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pattern_edges(spark):
    df = spark.createDataFrame([("a", T, 1, "V"), ("a", T, 1, "V"), ("a", T + timedelta(seconds=1), 2, None)], "k string, ts timestamp, i int, s string")
    symbols = {"V": F.col("s") == "V"}
    got = match_rows(df, row("V") + row("V"), by="k", on="ts", id_col="i", symbols=symbols).collect()
    assert [(x.end_id, x.latest_id, x.earliest_id) for x in got] == [(1, 1, 1)]
    assert match_rows(df.limit(0), row("V"), by="k", on="ts", id_col="i", symbols=symbols).count() == 0
    for bad in (row("V").maybe(), row("X")):
        with pytest.raises(ValueError):
            match_rows(df, bad, by="k", on="ts", id_col="i", symbols=symbols)


# ---- band joins -----------------------------------------------------------------------

BANDS = [((-3, 3), (0, 5)), ((0, None), (2, 4)), ((None, -1), (None, 0)), ((0, 0), (None, None))]


@pytest.mark.parametrize("bands", BANDS)
@pytest.mark.parametrize("place", [band.PLACE, 9])
def test_band_equals_all_pairs(spark, monkeypatch, bands, place):
    """A third of the rows share one value; nulls and NaN match nothing."""
    monkeypatch.setattr(band, "PLACE", place)
    r = random.Random(place)
    some = lambda n: [(k, 7 if r.random() < 0.35 else r.randrange(60), r.choice([None, float("nan"), *map(float, range(30))])) for k in range(n)]
    left, right = some(150), [*some(120), (None, None, 1.0), (5, 7, 3.0), (5, 7, 3.0)]
    kind = "k int, a int, b double, i int, x int, l int"
    frame = lambda rows: spark.createDataFrame([(*row_, 1, 2, 3) for row_ in rows], kind)
    got = band.band_join(frame(left), frame(right), x=("a", "a", bands[0]), y=("b", "b", bands[1]))
    within = lambda gap, lo_hi: (lo_hi[0] is None or gap >= lo_hi[0]) and (lo_hi[1] is None or gap <= lo_hi[1])
    ok = lambda v: v is not None and v == v
    want = sorted((p[0] or -1, q[0] or -1) for p in left for q in right if all(map(ok, (p[1], q[1], p[2], q[2]))) and within(q[1] - p[1], bands[0]) and within(q[2] - p[2], bands[1]))
    assert sorted((x.l.k or -1, x.r.k or -1) for x in got.collect()) == want


def test_band_places_are_bounded(spark, monkeypatch):
    """However skewed the columns are, no place has many rows of a side."""
    monkeypatch.setattr(band, "PLACE", 50)
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 900).cast("int").alias("a"), F.when(F.col("id") % 3 == 0, Decimal("1.50")).otherwise((F.col("id") % 70).cast("decimal(12,2)")).cast("decimal(12,2)").alias("b"))
    met = []
    monkeypatch.setattr(type(df), "join", lambda self, other, on, *a, f=type(df).join: met.append((self, other)) or f(self, other, on, *a))
    pairs = band.band_join(df, df, x=("a", "a", (0, 1)), y=("b", "b", (Decimal("0.5"), Decimal("0.5"))))
    monkeypatch.undo()
    a, b = met[-1]
    for side in (a, b):
        assert side.groupBy("i", "j", "p", "q").count().agg(F.max("count")).first()[0] <= 3 * 50
    want = df.alias("l").join(df.alias("r"), F.expr("r.a - l.a between 0 and 1 and r.b - l.b = 0.5")).count()
    assert pairs.count() == want


def test_no_band_pairs(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert band.band_join(df.limit(0), df, x=("a", "a", (0, 1)), y=("b", "b", (0, 1))).count() == 0
    assert band.band_join(df, df.limit(0), x=("a", "a", (0, None)), y=("b", "b", (0, 1))).count() == 0


def test_queries_have_rows(spark):
    assert QUERIES["bought_after_errors"](spark, SF).count() > 0
    assert QUERIES["similar_orders"](spark, "/root/testdata/sf0.01").count() > 0


def test_band_looks_at_few_pairs(spark, monkeypatch):
    """Pairs that meet in a place follow the rows and the pairs found, not the square of PLACE; far values and crowds change nothing."""
    n, crowd = 40_000, 4000
    df = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("b"))
    far = spark.range(n, n + 40).select("id", (F.col("id") * 10**12).alias("a"), F.lit(5).cast("bigint").alias("b"))
    crowded = spark.range(2 * n, 2 * n + crowd).select("id", (F.pmod(F.xxhash64("id"), F.lit(20_000)) + 500_000).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).alias("b"))
    df = df.union(far).union(crowded)
    met = []
    monkeypatch.setattr(type(df), "join", lambda self, other, on, *a, f=type(df).join: met.append((self, other)) or f(self, other, on, *a))
    pairs = band.band_join(df, df, x=("a", "a", (-50, 50)), y=("b", "b", (1, 7)))
    monkeypatch.undo()
    place = ["i", "j", "p", "q"]
    a, b = (side.groupBy(*place).count().withColumnRenamed("count", name) for side, name in zip(met[-1], ("na", "nb"), strict=True))
    looked = a.join(b, place).agg(F.sum(F.col("na") * F.col("nb"))).first()[0]
    want = df.alias("l").join(df.alias("r"), F.expr("r.b - l.b between 1 and 7 and r.a - l.a between -50 and 50")).count()
    assert pairs.count() == want > 0
    assert looked <= 400 * n


def test_probes_take_memory_by_the_step():
    """A batch of 10,000 queries against 1,600 and 6,400 lists and 8,192 guides: some tens of MB either way, and the same lists as at once."""
    rng = np.random.default_rng(5)
    x, shown = (rng.normal(size=(n, 16)).astype(np.float32) for n in (10_000, 8192))
    peaks = []
    for k in (40, 80):
        book = nearest.Codebook(tuple(rng.normal(size=(k, 8)).astype(np.float32) for _ in range(2)), [])
        tracemalloc.start()
        n = sum(len(row) for row, _, _ in nearest._probed(x, book, k * k, 100, shown))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert n == len(x) * k * k
    assert max(peaks) < 120
    got = list(nearest._probed(x[:600], book, 50, 100, shown))
    row, lists, low = (np.concatenate(c) for c in zip(*got, strict=True))
    assert row.tolist() == np.repeat(np.arange(600), 50).tolist() and lists.tolist() == book.probes(x[:600], 50).ravel().tolist()
    assert np.allclose(low[::50], np.sort(x[:600] @ shown.T, 1)[:, -100], atol=1e-4)


def test_searches_write_rows_by_the_vector(spark, monkeypatch):
    """Of vectors without clusters, which probe nearly all lists: four times the vectors, about four times the rows of probes and candidates."""
    monkeypatch.setattr(nearest, "LIST", 16)
    monkeypatch.setattr(nearest, "FEW_BLOCKS", 1)
    saved = []
    monkeypatch.setattr(nearest.Workspace, "save", lambda self, df, name, f=nearest.Workspace.save: saved.append((name, f(self, df, name))) or saved[-1][1])
    rng = np.random.default_rng(11)
    sizes = []
    for n in (500, 2000):
        rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, 16)))]
        df = spark.createDataFrame(rows, "id int, v array<double>")
        asking = df.where("id < 100") if n == 500 else None  # few queries meet slices of the items
        got, want = answers(nearest.nearest(df, 5, id_col="id", vector_col="v", queries=asking)), exact(rows, 5)
        assert recall(got, {i: w for i, w in want.items() if n > 500 or i < 100}) >= 0.95
        if n == 500:
            saved.clear()
            assert nearest.nearest(df, 5, id_col="id", vector_col="v").count() == 5 * n
        sizes.append(sum(t.count() for name, t in saved if name in ("probes", "candidates")))
        saved.clear()
    assert sizes[1] <= 5 * sizes[0] and sizes[1] <= 40 * 2000


def test_best_candidates_are_kept_some_at_a_time(monkeypatch):
    """Few candidates are held, and the best of all blocks stay; a query meets the lists within its reach only."""
    monkeypatch.setattr(nearest, "KEPT", 200)
    monkeypatch.setattr(nearest, "TOGETHER", 500)
    rng = np.random.default_rng(2)
    x, items = (rng.normal(size=(n, 8)).astype(np.float32) for n in (40, 600))
    x, items = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, items))
    book = nearest.train(items, 600)
    book = nearest.Codebook(tuple(nearest._kmeans(items[:, c], 3, 1) for c in (slice(0, 4), slice(4, 8))), book.parts)
    codes, lists = book.encode(items), book.list_of(items)
    for probes in (9, 2):
        near = book.probes(x, probes)
        reach = book.gap(x, near[:, -1])
        best = nearest._Best(np.arange(40) + 100, x, np.full(40, -2.0), reach, book, 5)
        for k in range(9):
            own = np.flatnonzero(lists == k)
            best.meet(k, own, codes[own])
        found = {}
        for b in best.rows():
            for q, node in zip(b.column("q").to_pylist(), b.column("node").to_pylist(), strict=True):
                found.setdefault(q - 100, []).append(node)
        s = x @ book.decode(codes).T
        for q in range(40):
            own = np.flatnonzero(np.isin(lists, near[q]))
            assert found[q] == own[np.lexsort((own, -s[q, own]))[:5]].tolist()

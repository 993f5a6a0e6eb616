"""Near duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, neardup

from .helpers import DOCS, edge_docs, edge_table, empty_table, prose


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(rows):
    """component by row, from all pairs of different sets; null if no row of a component has an id"""
    sets = sorted({tuple(sorted(shingles(r[1]))) for r in rows} - {()})
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(map(set, sets)):
        for j in range(i + 1, len(sets)):
            if 100 * (both := len(a.intersection(sets[j]))) >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    at, least = {s: find(i) for i, s in enumerate(sets)}, {}
    group = [at.get(tuple(sorted(shingles(r[1])))) for r in rows]
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    comp = [r[0] if g is None else least.get(g) for r, g in zip(rows, group, strict=True)]
    return sorted(((r[0], len(shingles(r[1])), c, r[0] == c) for r, c in zip(rows, comp, strict=True)), key=str)


def _got(df):
    return sorted(map(tuple, neardup.near_duplicates(df).select("id", "n_shingles", "component_id", "kept").collect()), key=str)


def family(seed, n, words, changes):
    """A chain: each copy changes a few words of the one before."""
    r, out, w = random.Random(seed), [], prose(seed, words)
    for _ in range(n):
        out.append(" ".join(w))
        for _ in range(changes):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("block", [neardup.BLOCK, 4])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "GROW", 1)
    texts = [*family(1, 30, 120, 1), *family(2, 25, 80, 2), *family(3, 12, 60, 1), *family(4, 10, 200, 8), *(" ".join(prose(100 + i, 40)) for i in range(20)), *["same text of six short words"] * 9]
    random.Random(5).shuffle(texts)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    assert _got(spark.createDataFrame(rows, DOCS)) == plain(rows)


def test_edges(spark):
    assert _got(edge_table(spark)) == plain(edge_docs())
    kept = neardup.drop_near_duplicates(edge_table(spark))
    assert kept.columns == edge_table(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 8, None, None], key=str)
    assert _got(empty_table(spark)) == [] == neardup.drop_near_duplicates(empty_table(spark)).collect()


def test_ids_that_repeat_or_are_missing(spark):
    """Classes are those of texts: an id with two texts, rows that repeat both, and rows without an id."""
    near, other = family(7, 4, 60, 1), [" ".join(prose(50 + i, 30)) for i in range(4)]
    rows = [(5, near[0]), (5, other[0]), (6, near[1]), (5, near[2]), (None, near[3]), (7, other[1]), (7, other[1]), (None, other[1]), (None, other[2]), (None, other[2]), (8, None), (8, None), (9, other[3]), (9, other[3] + "  ")]
    rows = [(*r, "en", "a", k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, DOCS)
    assert _got(df) == plain(rows)
    kept = [(r.doc_id, r.text) for r in neardup.drop_near_duplicates(df).collect()]
    assert sorted(k for k, _ in kept if k) == [5, 5, 7, 8, 8, 9] and sorted(t in near for _, t in kept) == [False] * 6 + [True]
    assert (None, other[2]) in kept and len(kept) == 7


def test_lists_too_large_to_broadcast_change_nothing(spark):
    """Rows and bytes bound a broadcast; beyond either, rows are joined by a shuffle with the same result."""
    wide = spark.createDataFrame([(k, "x" * 1000) for k in range(10)], "k int, text string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.maybe_broadcast(wide, 10)) and not hinted(common.maybe_broadcast(wide, 9))
    texts = [*family(1, 20, 90, 1), *family(2, 9, 80, 2), *["same text of six short words"] * 5]
    df = spark.createDataFrame([(k % 30, t, "en", "a", 0) for k, t in enumerate(texts)], DOCS)
    want = sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(df).collect())
    assert want and sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(df, most_broadcast=0).collect()) == want
    assert common.small(wide, 10, 10_300) and not common.small(wide, 10, 10_000)


def test_rows_of_a_hot_bucket_grow_less_than_its_square(spark):
    """Members that nothing links are dealt into blocks; each two of them meet once."""

    def dealt(m):
        members = spark.range(m).select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("band"), "id", F.col("id").alias("comp"), F.lit(9).alias("n"), F.lit(b"").alias("sig"), F.lit(m).alias("size"), F.lit(0).alias("bytes"))
        groups = neardup._block_groups(members, [])
        return groups.count(), groups.groupBy("p", "q").count().agg(F.max("count")).first()[0]

    (a, _), (b, largest) = dealt(10_000), dealt(160_000)
    assert b <= a * 16**1.55 and b <= 160_000**1.5 / neardup.GROW * 1.1 and largest < 2.4 * neardup.GROW * 400


def test_pruning_bounds_follow_the_posterior():
    need, n = neardup.least_matches(), neardup.BANDS * neardup.ROWS
    assert len(need) == n // neardup.BATCH and (np.diff(need) > 0).all()
    # The share of links at the threshold that the bounds lose, by simulation.
    r = np.random.default_rng(3)
    a = np.zeros((20_000, n), np.uint32)
    assert len(neardup.likely(a, (r.random(a.shape) >= 0.75).astype(np.uint32))) > 0.995 * len(a)
    assert len(neardup.likely(a, (r.random(a.shape) >= 0.4).astype(np.uint32))) < 0.01 * len(a)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = np.unique(base[:3500]), np.unique(base[500:])
    same = (neardup.signature(a) == neardup.signature(b)).mean()
    assert abs(same - 3000 / 4000) < 0.12

"""SimHash near duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import Scratch

from .helpers import edge_docs, edge_table, empty_table, prose, words


def plain_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps):
    """The first of each fingerprint's component, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(k) for k in range(len(fps))]


def plain(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    root, least = roots(fps), {}
    for r, k in zip(rows, root, strict=True):
        if r[0] is not None:
            least[k] = min(r[0], least.get(k, r[0]))
    return sorted(((r[0], f"{fp:016x}", least.get(k)) for r, fp, k in zip(rows, fps, root, strict=True)), key=str)


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_edges_equal_brute_force(spark):
    base = [" ".join(prose(k, 400)) for k in range(6)]
    rows = [*edge_docs(), *((100 + k, t + " one more") for k, t in enumerate(base)), *((200 + k, t.upper()) for k, t in enumerate(base)), (300, "one  two\x0bthree"), (301, "ONE two three")]
    rows = [(r[0], r[1], None, None, None) for r in rows]
    df = spark.createDataFrame([(*r, 7, "k", 9, "r", 3, b"s", 1, 5, "l") for r in rows], edge_table(spark).schema)
    got = sorted(map(tuple, simhash.simhash_duplicates(df.repartition(5)).collect()), key=str)
    assert got == plain(rows)
    assert simhash.simhash_duplicates(empty_table(spark)).count() == 0


def test_hash_is_the_one_of_the_engine(spark):
    texts = ["", "a", "ab cd", "x" * 31, "y" * 32, "ü 中文 \U0001f600" * 9, "z" * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] & (1 << 64) - 1 for r in df.select(F.xxhash64("t")).collect()] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_a_long_text_in_pieces(monkeypatch):
    text = "  ".join(prose(3, 500)) + "\n"
    whole = simhash.fingerprint(text.encode())
    for size in (1, 7, 100, 10**6):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)
    assert simhash.fingerprint(b"two words") == plain_fingerprint("two words")


@pytest.mark.parametrize(("bucket", "splits"), [(simhash.BUCKET, simhash.SPLITS), (6, 2), (6, 0), (2, 1)])
def test_links_equal_all_pairs(spark, monkeypatch, bucket, splits):
    """Clusters of near fingerprints and chains, in buckets that are split or dealt in tiles."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SPLITS", splits)
    rng = random.Random(bucket + splits)
    fps = [0, 1, 7, (1 << 64) - 1]
    for _ in range(30):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            fps.append(at)
            at = near(rng, at, rng.randrange(1, 5))
    low = rng.getrandbits(64)
    fps += [low & ~0xFFFF | rng.getrandbits(16) for _ in range(60)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    scratch = Scratch(spark)
    got = simhash.links(simhash.buckets(scratch.save(simhash.pivot_table(df)), scratch)).collect()
    root = dict(zip(fps, roots(fps), strict=True))
    unsigned = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in got]
    assert all(root[u] == root[v] for u, v in unsigned)
    joined = {x: x for x in fps}

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for u, v in unsigned:
        joined[find(u)] = find(v)
    assert len({find(x) for x in fps}) == len(set(root.values()))


def test_pivots_discard_no_near_pair_and_most_others():
    rng = random.Random(5)
    a = np.array([rng.getrandbits(64) for _ in range(4000)], np.uint64)
    b = np.array([near(rng, int(x), rng.randrange(4)) for x in a], np.uint64)
    gap = lambda x, y: np.abs(simhash.distances(x.view(np.int64)).astype(int) - simhash.distances(y.view(np.int64)).astype(int)).max(1)
    assert (gap(a, b) <= simhash.NEAR).all()
    assert (gap(a, np.roll(a, 1)) <= simhash.NEAR).mean() < 0.001


def test_every_near_pair_shares_a_mask():
    rng = random.Random(6)
    for splits in range(3):
        masks = simhash.masks(splits)
        assert len(masks) == 4 ** (splits + 1)
        for _ in range(200):
            diff = near(rng, 0, 3)
            assert any(diff & m == 0 for m in masks)

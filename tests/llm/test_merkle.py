"""The Merkle manifest against a plain one."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

from .helpers import DOCS, edge_docs, edge_table, empty_table


def h(text):
    return sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def low(x):
    return None if x is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def climb(nodes):
    """All levels, and for each first node the siblings on the way up as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, at, strict=True):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            p.append((run[: k % 16], run[k % 16 + 1 :]))
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def plain(rows):
    """id, leaf, subroot, root, proof, folded root, verified of each row."""
    leaf = lambda r, text: h("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    by = {}
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, low(r[1]) if bad else r[1])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s]), *climb([x[2] for x in sorted(by[s])])) for s in names}
    root, upper = climb([trees[s][1] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        leaves, subroot, paths = trees[s]
        for (known, i, own, tampered), path in zip(leaves, paths, strict=True):
            x = tampered
            for before, after in path + above:
                x = h("".join([*before, x, *after]))
            proof = h("".join(d for before, after in path + above for d in before + after))
            out.append((i if known else None, own, subroot, root, proof, x, x == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, merkle.tamper_fifth(df).collect()), key=str)


def test_edges_equal_a_plain_manifest(spark):
    assert got(edge_table(spark).repartition(3)) == plain(edge_docs())
    assert got(edge_table(spark).where("doc_id = 6")) == plain(edge_docs()[5:6])
    assert merkle.tamper_fifth(empty_table(spark)).count() == 0


@pytest.mark.parametrize("most", [merkle.MOST_TOP, 2])
def test_many_leaves_and_sources(spark, monkeypatch, most):
    """A hot source of several blocks and many small ones; with a small top, rounds go on over the sources."""
    monkeypatch.setattr(merkle, "MOST_TOP", most)
    rows = [(k * 7 % 700, f"Text {k} of many", "en", "hot", k) for k in range(700)] + [(1000 + k, f"Other {k}", None, None if k == 3 else f"s{k % 300}", 1) for k in range(330)]
    rows += [(5, "Same ROW", "en", "same", 8)] * 40
    want = plain(rows)
    assert got(spark.createDataFrame(rows, DOCS).repartition(6)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_every_change_is_found(spark):
    rows = [(k, f"text {k}", "en", f"s{k % 3}", 1) for k in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    out = merkle.manifest(df, tamper=F.col("doc_id") % 4 == 1, tampered_text=F.concat("text", F.lit("!"))).collect()
    assert all(r.verified == (r.id % 4 != 1) for r in out) and len(out) == 60

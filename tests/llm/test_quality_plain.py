"""The features and the boosting of the quality classifier against plain Python."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality

from .helpers import edge_docs, prose


def plain_features(text):
    raw = (text or "").encode()
    words = []
    for part in raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" "):
        if part:
            words.append(part)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n, some, solid = len(words), max(len(words), 1), max(sum(map(len, words)), 1)
    has = lambda those: sum(c in those for c in raw)
    upper, lower, high = has(range(65, 91)), has(range(97, 123)), sum(c >= 128 for c in raw)
    letters, symbols = max(upper + lower + high, 1), b"#$%&*+<=>@\\^_`{|}~[]/"
    return [
        math.log2(1 + n), solid / some, upper / letters, has(b"0123456789") / solid, has(symbols) / solid, has(b"!?") / solid, has(b"|") / some, sum(w[-1] in symbols + b"!?" for w in words) / some,
        len(set(low)) / some, sum(a == b for a, b in zip(low, low[1:], strict=False)) / some, max((low.count(w) for w in set(low)), default=0) / some, has(b"\n") / some, has(b".,;:") / some,
        sum(len(w) <= 3 for w in words) / some, high / solid, sum(len(w) > 1 and 65 <= w[0] <= 90 and 65 <= w[1] <= 90 for w in words) / some,
    ]


def test_features_equal_plain_ones():
    texts = [r[1] for r in edge_docs() if len(r[1] or "") < 1000] + [" ".join(prose(k, 80)) for k in range(5)]
    texts += ["A", "AB", "Ab aB", "the the THE the", "a|b | c|", "wow! what? #tag_ x=", "12 3.5, 7;", "line\nline\n\nend", "ends in A", "B", "ÄÖ Ü ß", "\x0b\x0c\r\n\t ", "x" * 500]
    got = quality.text_features(pa.array(texts, pa.string()))
    assert np.isfinite(got).all() and got.shape == (len(texts), len(quality.FEATURES))
    for text, row in zip(texts, got, strict=True):
        assert row.tolist() == pytest.approx(plain_features(text)), text


# ---- boosting -------------------------------------------------------------------------


def cut(g, h, least):
    best, total_g, total_h, left_g, left_h = (0, 1e-12), sum(g), sum(h), 0.0, 0.0
    for k in range(1, len(g)):
        left_g, left_h = left_g + g[k - 1], left_h + h[k - 1]
        right_g, right_h = total_g - left_g, total_h - left_h
        if left_h >= least and right_h >= least:
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
            if gain > best[1]:
                best = (k, gain)
    return best if best[0] else (0, 0.0)


def tree(g, h, leaves, least):
    parts = [(0, len(g))]
    while len(parts) < leaves:
        k, gain, i = max(((*cut(g[a:b], h[a:b], least), i) for i, (a, b) in enumerate(parts)), key=lambda t: t[1])
        if not k:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + k), (a + k, b)]
    return [sum(g[a:b]) / (sum(h[a:b]) + 1) for a, b in parts for _ in range(a, b)]


def pair_tree(g, h, least):
    """Every first cut of either axis, then the best second cut on each side."""
    rows, cols = len(g), len(g[0])
    best, out = 0.0, [[0.0] * cols for _ in range(rows)]
    whole = sum(map(sum, g)) ** 2 / (sum(map(sum, h)) + 1)
    for turned in (False, True):
        at = (lambda x, i, j: x[j][i]) if turned else (lambda x, i, j: x[i][j])
        n, m = (cols, rows) if turned else (rows, cols)
        for k in range(1, n):
            value, gain = {}, -whole
            for side in (range(k), range(k, n)):
                sg, sh = [[sum(at(x, i, j) for i in side) for j in range(m)] for x in (g, h)]
                c, _ = cut(sg, sh, least)
                for part in (range(c), range(c, m)) if c else (range(m),):
                    a, b = sum(sg[j] for j in part), sum(sh[j] for j in part)
                    gain += a * a / (b + 1)
                    value |= {(i, j): a / (b + 1) for i in side for j in part}
            if gain > best + 1e-9:
                best, out = gain, [[value[j, i] if turned else value[i, j] for j in range(cols)] for i in range(rows)]
    return out, best


def bin_of(x, edges):
    return sum(e <= x for e in edges)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_boosting_equals_plain_rounds(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(70, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(70) < 0.1)).astype(float)
    rounds, pair_rounds, rate, leaves, least = 3, 2, 0.3, 3, 0.5
    gam = quality.fit(x, y, bins=6, pair_bins=3, rounds=rounds, pair_rounds=pair_rounds, n_pairs=2, rate=rate, leaves=leaves, least=least)

    share = y.mean()
    z = [math.log(share / (1 - share))] * len(y)
    tables = [[0.0] * (len(e) + 1) for e in gam.edges]
    bins = [[bin_of(v, e) for v in x[:, f]] for f, e in enumerate(gam.edges)]
    slopes = lambda: [(t - 1 / (1 + math.exp(-s)), 1 / (1 + math.exp(-s)) * (1 - 1 / (1 + math.exp(-s)))) for t, s in zip(y, z, strict=True)]
    for _ in range(rounds):
        for f in range(3):
            g, h = [0.0] * len(tables[f]), [0.0] * len(tables[f])
            for b, (a, c) in zip(bins[f], slopes(), strict=True):
                g[b] += a
                h[b] += c
            step = [rate * v for v in tree(g, h, leaves, least)]
            tables[f] = [t + s for t, s in zip(tables[f], step, strict=True)]
            z = [s + step[b] for s, b in zip(z, bins[f], strict=True)]
    for own, want in zip(gam.tables, tables, strict=True):
        assert own.tolist() == pytest.approx(want)

    coarse = [[bin_of(v, e) for v in x[:, f]] for f, e in enumerate(gam.pair_edges)]

    def grids(a, b):
        out = [[[0.0] * (len(gam.pair_edges[b]) + 1) for _ in range(len(gam.pair_edges[a]) + 1)] for _ in "gh"]
        for i, j, s in zip(coarse[a], coarse[b], slopes(), strict=True):
            for grid, v in zip(out, s, strict=True):
                grid[i][j] += v
        return out

    gains = {(a, b): pair_tree(*grids(a, b), least)[1] for a in range(3) for b in range(a)}
    assert gam.pairs == sorted((k for k in gains if gains[k] > 0), key=lambda k: (-gains[k], k))[:2]
    pairs = [[[0.0] * (len(gam.pair_edges[b]) + 1) for _ in range(len(gam.pair_edges[a]) + 1)] for a, b in gam.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(gam.pairs):
            step = [[rate * v for v in r] for r in pair_tree(*grids(a, b), least)[0]]
            pairs[k] = [[t + s for t, s in zip(*r, strict=True)] for r in zip(pairs[k], step, strict=True)]
            z = [s + step[i][j] for s, i, j in zip(z, coarse[a], coarse[b], strict=True)]
    for own, want in zip(gam.pair_tables, pairs, strict=True):
        assert own.tolist() == [pytest.approx(r) for r in want]
    assert gam.score(x).tolist() == pytest.approx([1 / (1 + math.exp(-s)) for s in z])

"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import byte_counts, chunks, per_text, utf8, word_hashes, words
from .common import Scratch, held_out, small_batches

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "pipes", "marked_words", "distinct_words",
    "repeats", "top_word", "lines", "stops", "short_words", "high_bytes", "caps_words",
)
#: Labelled rows that the model learns from, at most. They are those with the least hash of their id.
MAX_TRAIN = 20_000

_CLASS = {k: np.isin(np.arange(256), list(v)) for k, v in {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "symbols": b"#$%&*+<=>@\\^_`{|}~[]/", "bangs": b"!?", "pipes": b"|", "lines": b"\n", "stops": b".,;:", "high": range(128, 256),
}.items()}


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text: shares and rates of its bytes and words, all finite."""
    data, off = utf8(texts)
    starts, ends, first = words(data, off)
    n_words = np.diff(first)
    some = np.maximum(n_words, 1)
    by_byte = byte_counts(data, off)
    count = {k: by_byte @ t.astype(np.int64) for k, t in _CLASS.items()}
    size = ends - starts
    solid = np.maximum(per_text(size, first), 1)
    letters = np.maximum(count["upper"] + count["lower"] + count["high"], 1)
    h = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), n_words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    owner = (key[new] >> np.uint64(40)).astype(np.int64)
    run = np.diff(np.append(new, len(key)))
    distinct = np.bincount(owner, minlength=len(n_words))
    top = np.zeros(len(n_words), np.int64)
    if len(run):
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        top[owner[begin]] = np.maximum.reduceat(run, begin)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marked = _CLASS["symbols"][last] | _CLASS["bangs"][last]
    head = data[starts] if len(starts) else last
    second = data[np.minimum(starts + 1, max(len(data) - 1, 0))] if len(starts) else last
    caps = _CLASS["upper"][head] & _CLASS["upper"][second] & (size > 1)
    return np.column_stack([
        np.log2(1 + n_words), solid / some, count["upper"] / letters, count["digits"] / solid, count["symbols"] / solid, count["bangs"] / solid, count["pipes"] / some, per_text(marked, first) / some,
        distinct / some, per_text(same, first) / some, top / some, count["lines"] / some, count["stops"] / some, per_text(size <= 3, first) / some, count["high"] / solid, per_text(caps, first) / some,
    ])


@dataclass
class Gam:
    """Lookup tables: one per feature, and one per chosen pair of features."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: look up every bin and add."""
        z = np.full(len(x), self.bias)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.pair_edges)]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[int, float]:
    """Where to cut a row of bins in two, and what it gains; 0 for nowhere."""
    if len(g) < 2:
        return 0, 0.0
    cg, ch = np.cumsum(g), np.cumsum(h)
    left_g, left_h = cg[:-1], ch[:-1]
    right_g, right_h = cg[-1] - left_g, ch[-1] - left_h
    gain = np.where((left_h >= least) & (right_h >= least), left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - cg[-1] ** 2 / (ch[-1] + 1), 0)
    k = int(np.argmax(gain))
    return (k + 1, float(gain[k])) if gain[k] > 1e-12 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """The values of a tree with few leaves, grown best first over the bins of a feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g[a:b], h[a:b], least), i) for i, (a, b) in enumerate(parts)]
        k, gain, i = max(found, key=lambda t: t[1])
        if not k:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """A tree that cuts one axis of a grid, then the other on either side; and its gain."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(gg)):
            value, gain = np.zeros_like(gg), -(g.sum() ** 2) / (h.sum() + 1)
            for side in (slice(0, k), slice(k, None)):
                col_g, col_h = gg[side].sum(0), hh[side].sum(0)
                c, _ = _best_cut(col_g, col_h, least)
                for cols in (slice(0, c), slice(c, None)) if c else (slice(None),):
                    sg, sh = col_g[cols].sum(), col_h[cols].sum()
                    value[side, cols] = sg / (sh + 1)
                    gain += sg**2 / (sh + 1)
            if gain > best:
                best, out = gain, (value.T if turned else value)
    return out, best


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 64, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.15, leaves: int = 3, least: float = 0.5) -> Gam:
    """Boost the features in turn, round after round; then pairs that explain what is left."""
    if not len(y):
        return Gam()
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    gam = Gam(bias=float(np.log(share / (1 - share))))
    gam.edges = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    gam.tables = [np.zeros(len(e) + 1) for e in gam.edges]
    gam.pair_edges = [_cuts(x[:, f], pair_bins) for f in range(x.shape[1])]
    if y.min() == y.max():
        return gam
    index = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(gam.edges)]
    z = np.full(len(y), gam.bias)
    for _ in range(rounds):
        for f, i in enumerate(index):
            p = 1 / (1 + np.exp(-z))
            n = len(gam.tables[f])
            step = rate * _tree(np.bincount(i, y - p, n), np.bincount(i, p * (1 - p), n), leaves, least)
            gam.tables[f] += step
            z += step[i]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(gam.pair_edges)]
    grid = lambda a, b, v: np.bincount(coarse[a] * (len(gam.pair_edges[b]) + 1) + coarse[b], v, (len(gam.pair_edges[a]) + 1) * (len(gam.pair_edges[b]) + 1)).reshape(len(gam.pair_edges[a]) + 1, -1)
    p = 1 / (1 + np.exp(-z))
    gains = {(a, b): _pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), least)[1] for a in range(x.shape[1]) for b in range(a)}
    gam.pairs = [k for k, gain in sorted(gains.items(), key=lambda t: (-t[1], t[0]))[:n_pairs] if gain > 0]
    gam.pair_tables = [np.zeros((len(gam.pair_edges[a]) + 1, len(gam.pair_edges[b]) + 1)) for a, b in gam.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(gam.pairs):
            p = 1 / (1 + np.exp(-z))
            step = rate * _pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), least)[0]
            gam.pair_tables[k] += step
            z += step[coarse[a], coarse[b]]
    return gam


def feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, x``: the features of each text, a null as an empty one."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text"):
                x = text_features(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "x"])

    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, x array<double>")


def train(features: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Gam:
    """Fit on labelled rows that are not held out, ``max_train`` of them at most."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_train)
    rows = features.join(F.broadcast(known), "id").orderBy("id", "y", "x").limit(max_train).toPandas()
    x = np.vstack(rows["x"]) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """``id, held_out, score, predicted`` for every document.

    Texts are read once, into a table of features; the model learns from a bounded sample
    of it and is broadcast (a few tables of at most 64 numbers a feature). A null text
    scores as an empty one; without any labels every score is 0.5; repeated rows get a row
    each. Labels, language, source and id are never inputs of a score.
    """
    scratch = Scratch(docs.sparkSession)
    features = scratch.save(feature_rows(docs, id_col, text_col), "features")
    model = docs.sparkSession.sparkContext.broadcast(train(features, labels, id_col=id_col, label_col=label_col, max_train=max_train))

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            s = model.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    scored = features.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that the classifier predicts to be good, columns as they were.

    The features of the labelled sample alone train the model; then each text is scored
    where it lies, so no text is shuffled or written. A null text is judged as an empty one.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("k"), F.col(label_col).alias("y"))
    sample = known.orderBy(F.xxhash64("k"), "k", "y").limit(max_train)
    taken = docs.select(id_col, text_col).join(F.broadcast(sample.select(F.col("k").alias(id_col)).distinct()), id_col, "left_semi")
    model = docs.sparkSession.sparkContext.broadcast(train(feature_rows(taken, id_col, text_col), sample.select(F.col("k").alias(id_col), F.col("y").alias(label_col)), id_col=id_col, label_col=label_col, max_train=max_train))

    def run(batches):
        for batch in batches:
            for b in chunks(batch, text_col):
                yield b.filter(pa.array(model.value.score(text_features(b.column(text_col))) >= 0.5))

    return small_batches(docs).mapInArrow(run, docs.schema)

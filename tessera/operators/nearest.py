"""Nearest-neighbour join of vectors by cosine, over inverted lists with codes of a byte a number.

Vectors lie in lists around trained centres and are compared there by their codes; the
best of each query are scored again on the full vectors. How many lists a query probes and
how many candidates it keeps follow the recall measured on some queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.workspace import Workspace

#: Vectors that centres are trained on, and queries that the recall is measured on, at most.
SAMPLE, MEASURED = 32_768, 128
#: Items of a list for which one more list is made, and centres of a half of the dimensions, at most: lists are pairs of these.
LIST, MOST_CENTRES = 256, 1024
#: Values of a dimension in a code.
VALUES = 256
#: Items in a block of a list, and queries in a chunk at most.
BLOCK, QUERIES = 1024, 1 << 17
#: Chunks of queries, or slices of the items, for which queries or items are few; queries of such a chunk and blocks of such a slice at least.
CHUNKS, FEW_QUERIES, FEW_BLOCKS = 24, 1024, 64
#: Candidates that a task keeps at most; it holds three times as many until it looks for the best.
KEPT = 1 << 20
#: Numbers of a matrix in a task, about: of queries and lists, of queries and guides.
TOGETHER = 1 << 21
#: Lloyd's rounds.
ROUNDS = 6


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's rounds from k different rows; fewer where rows are fewer."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    centres = np.unique(x, axis=0)
    if len(centres) > k:
        centres = centres[rng.choice(len(centres), k, replace=False)]
        for _ in range(ROUNDS):
            own = _nearest(x, centres)
            n = np.bincount(own, minlength=k)
            sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], 1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less each row's own norm."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_gaps(x[k : k + 4096], centres).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Codebook:
    """Centres of the two halves of the dimensions; the least value of each dimension in a code, and the step to the next."""

    halves: tuple[np.ndarray, np.ndarray]
    parts: list[np.ndarray]

    @property
    def lists(self) -> int:
        return len(self.halves[0]) * len(self.halves[1])

    def list_of(self, x: np.ndarray) -> np.ndarray:
        cut = self.halves[0].shape[1]
        return _nearest(x[:, :cut], self.halves[0]) * len(self.halves[1]) + _nearest(x[:, cut:], self.halves[1])

    def encode(self, x: np.ndarray) -> np.ndarray:
        least, step = self.parts
        return np.clip(np.rint((x - least) / step), 0, VALUES - 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        least, step = self.parts
        return codes * step + least

    def pairs(self, n: int) -> int:
        """Of how many pairs of centres ``probes`` takes the n nearest."""
        a, b = (len(h) for h in self.halves)
        return sum(min(n // (i + 1), b) for i in range(min(n, a)))

    def gap(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """As ``probes`` ranks them, how far each row is from one list."""
        cut = self.halves[0].shape[1]
        sides = ((x[:, :cut], self.halves[0][lists // len(self.halves[1])]), (x[:, cut:], self.halves[1][lists % len(self.halves[1])]))
        return sum((c * c).sum(1) - 2 * (part * c).sum(1) for part, c in sides)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n lists nearest to each row, in order.

        Among them a pair of the i-th and the j-th nearest centres has (i + 1) (j + 1) <= n,
        because so many pairs are no farther.
        """
        n, cut = min(n, self.lists), self.halves[0].shape[1]
        gaps = [_gaps(part, c) for part, c in ((x[:, :cut], self.halves[0]), (x[:, cut:], self.halves[1]))]
        order = [np.argsort(g, 1, kind="stable")[:, :n] for g in gaps]
        i, j = (np.concatenate(c) for c in zip(*((np.full(n // (a + 1), a), np.arange(n // (a + 1))) for a in range(order[0].shape[1])), strict=True))
        i, j = i[j < order[1].shape[1]], j[j < order[1].shape[1]]
        total = np.take_along_axis(gaps[0], order[0], 1)[:, i] + np.take_along_axis(gaps[1], order[1], 1)[:, j]
        best = np.argsort(total, 1, kind="stable")[:, :n]
        return np.take_along_axis(order[0], i[best], 1) * len(self.halves[1]) + np.take_along_axis(order[1], j[best], 1)


def train(sample: np.ndarray, rows: int) -> Codebook:
    """A codebook for a table of so many rows."""
    k = min(MOST_CENTRES, max(1, round(math.sqrt(rows / LIST))))
    cut = sample.shape[1] // 2
    least, most = sample.min(0), sample.max(0)
    parts = [least, np.where(most > least, (most - least) / (VALUES - 1), 1).astype(np.float32)]
    return Codebook((_kmeans(sample[:, :cut], k, 1), _kmeans(sample[:, cut:], k, 2)), parts)


# ---- tables of vectors ----------------------------------------------------------------


def unit_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec``: vectors scaled to length one, as bytes of float32. Null ids and vectors, null, infinite and NaN numbers and vectors of zeros are left out."""

    def run(batches):
        for b in batches:
            size, values = b.column("v").value_lengths().to_numpy(), b.column("v").flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(size) - size
            # Rows of a length are a matrix; a null number is NaN, which no norm survives.
            for n in np.unique(size[size > 0]).tolist():
                own = np.flatnonzero(size == n)
                x = values[at[own][:, None] + np.arange(n)]
                norm = np.sqrt((x * x).sum(1))
                good = (norm > 0) & (norm < np.inf)
                unit = (x[good] / norm[good][:, None]).astype("<f4")
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(own[good])), pa.array([r.tobytes() for r in unit], pa.binary())], ["id", "vec"])

    kind = table.schema[id_col].dataType.simpleString()
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id {kind}, vec binary")


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f4").reshape(len(values), -1) if values else np.zeros((0, 1), np.float32)


def _first(df: DataFrame, n: int, seed: int) -> np.ndarray:
    """The n vectors whose hashes are least; to the driver."""
    rows = df.orderBy(F.xxhash64("vec", F.lit(seed)), "vec").limit(n).select("vec").collect()
    return np.stack([np.frombuffer(r.vec, "<f4") for r in rows])


def build_lists(vectors: DataFrame, book: Codebook) -> DataFrame:
    """``list, block, ids, codes`` of distinct vectors ``(node, vec)``: up to about BLOCK codes of a list in a row."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column("vec"))
            if len(x):
                codes = book.encode(x)
                yield pa.RecordBatch.from_arrays([pa.array(book.list_of(x).astype(np.int64)), b.column("node"), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "node", "code"])

    rows = vectors.select("node", "vec").mapInArrow(run, "list bigint, node bigint, code binary")
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return rows.groupBy("list", "block").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_list(F.struct("node", "code"))).alias("items"))


# ---- recall ---------------------------------------------------------------------------


def _best_of(vectors: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """``q, node, sim, vec``: the k exact neighbours of a few queries, a copy of the query itself left out."""

    def run(batches):
        best: list[list] = [[] for _ in queries]
        for b in batches:
            x, nodes = _matrix(b.column("vec")), b.column("node").to_pylist()
            if not len(x):
                continue
            s = queries @ x.T
            for q, row in enumerate(s):
                near = np.argsort(-row, kind="stable")[: k + 1]
                own = [(float(row[i]), nodes[i], x[i].tobytes()) for i in near if x[i].tobytes() != queries[q].tobytes()]
                best[q] = sorted(best[q] + own, key=lambda r: (-r[0], r[1]))[:k]
        rows = [(q, node, sim, vec) for q, found in enumerate(best) for sim, node, vec in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.binary()), strict=True)], ["q", "node", "sim", "vec"])

    found = vectors.select("node", "vec").mapInArrow(run, "q int, node bigint, sim double, vec binary")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "node"))).where(F.col("rank") <= k)


def _better(vectors: DataFrame, book: Codebook, queries: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
    """How many codes are better than each of a query's ascending marks."""
    offsets = np.cumsum([0, *map(len, marks)])

    def run(batches):
        n = np.zeros(offsets[-1], np.int64)
        for b in batches:
            x = _matrix(b.column("vec"))
            if len(x):
                s = np.sort(queries @ book.decode(book.encode(x)).T, 1)
                for q, m in enumerate(marks):
                    n[offsets[q] : offsets[q + 1]] += s.shape[1] - np.searchsorted(s[q], m, side="right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["mark", "n"])

    out = np.zeros(offsets[-1], np.int64)
    for r in vectors.select("vec").mapInArrow(run, "mark bigint, n bigint").groupBy("mark").agg(F.sum("n").alias("n")).collect():
        out[r.mark] = r.n
    return out


def settings(vectors: DataFrame, book: Codebook, queries: np.ndarray, k: int, target: float) -> tuple[int, int]:
    """Lists to probe and candidates to keep, so that each loses at most half of the neighbours that may be lost."""
    rows = _best_of(vectors, queries, k).collect()
    if not rows:
        return 1, k
    near = {q: [r for r in rows if r.q == q] for q in range(len(queries))}
    lists, marks = [], []
    for q, found in near.items():
        x = np.stack([np.frombuffer(r.vec, "<f4") for r in found]) if found else np.zeros((0, queries.shape[1]), np.float32)
        own = book.probes(queries[q : q + 1], book.lists)[0]
        place = np.empty(book.lists, np.int64)
        place[own] = np.arange(1, len(own) + 1)
        lists += place[book.list_of(x)].tolist() if len(x) else []
        marks.append(np.sort(queries[q] @ book.decode(book.encode(x)).T) if len(x) else np.zeros(0, np.float32))
    kept = _better(vectors, book, queries, marks) + 1
    share = 1 - (1 - target) / 2
    need = lambda n: int(np.sort(n)[min(len(n) - 1, math.ceil(share * len(n)) - 1)])
    return need(np.array(lists)), max(k, need(kept) + 2)


# ---- search ---------------------------------------------------------------------------


def _probed(x: np.ndarray, book: Codebook, probes: int, keep: int, shown: np.ndarray):
    """``row, list, low`` of the lists that each row probes and of its keep-th best guide, as flat arrays for some rows at a time.

    Rows are taken by as many as keep the matrices of lists and of guides small, whatever
    the number of lists: of a larger table there are more lists and fewer rows at a time.
    """
    width = max(len(shown), book.pairs(min(probes, book.lists)), 1)
    step = max(1, TOGETHER // width)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        lists = book.probes(part, probes)
        low = np.full(len(part), -2.0) if len(shown) < keep else np.partition(part @ shown.T, len(shown) - keep, 1)[:, len(shown) - keep]
        row = np.repeat(np.arange(len(part)), lists.shape[1])
        lists = lists.ravel()
        for k in range(0, len(row), 65_536):
            r = row[k : k + 65_536]
            yield r + at, lists[k : k + 65_536].astype(np.int64), low[r].astype(np.float64)


def _place(x: np.ndarray, node: np.ndarray, book: Codebook) -> np.ndarray:
    """By which queries are dealt in chunks: the nearest list, and within it a hash."""
    return book.list_of(x) + (((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) / 2.0**31)


class _Best:
    """The ``keep`` best candidates of each query of a chunk."""

    def __init__(self, q: np.ndarray, x: np.ndarray, low: np.ndarray, reach: np.ndarray, book: Codebook, keep: int):
        self.q, self.x, self.reach, self.book, self.keep = q, x, reach, book, keep
        # Products of matrices of other shapes are rounded otherwise.
        self.low = (low - 1e-6).astype(np.float32)
        cut = book.halves[0].shape[1]
        self.sides = [np.ascontiguousarray(x[:, :cut]), np.ascontiguousarray(x[:, cut:])]
        self.at, self.gap = [-1, -1], [None, None]
        self.held, self.n = [], 0

    def probing(self, which: int) -> np.ndarray:
        """The rows that probe a list; only what is within their reach, whatever the rounding."""
        for side, c in enumerate(divmod(which, len(self.book.halves[1]))):
            if self.at[side] != c:
                centre = self.book.halves[side][c]
                self.at[side], self.gap[side] = c, (centre * centre).sum() - 2 * (self.sides[side] @ centre)
        return np.flatnonzero(self.gap[0] + self.gap[1] <= self.reach + 1e-5)

    def meet(self, which: int, nodes: np.ndarray, codes: np.ndarray) -> None:
        own, block = self.probing(which), self.book.decode(codes).T
        step = max(1, TOGETHER // len(nodes))
        for at in range(0, len(own), step):
            rows = own[at : at + step]
            s = (self.x if len(rows) == len(self.x) else self.x[rows]) @ block
            hit = np.flatnonzero(s >= self.low[rows][:, None])
            self.held.append((rows[hit // len(nodes)].astype(np.int32), nodes[hit % len(nodes)], s.ravel()[hit]))
            self.n += len(hit)
            if self.n > 3 * KEPT:
                self.settle()

    def settle(self) -> None:
        """Only the best stay, and what is worse than the last of them is not held any more."""
        row, node, near = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((node, -near, row))
        row, node, near = row[order], node[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        own, last = place < self.keep, place == self.keep - 1
        self.low[row[last]] = np.maximum(self.low[row[last]], near[last])
        self.held = [(row[own], node[own], near[own])]
        self.n = int(own.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.settle()
            row, node, near = self.held[0]
            for k in range(0, len(row), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(self.q[row[k : k + 65_536]]), pa.array(node[k : k + 65_536]), pa.array(near[k : k + 65_536].astype(np.float64))], ["q", "node", "near"])


def _candidates(index: DataFrame, queries: DataFrame, book: Codebook, probes: int, keep: int, guides: np.ndarray, work: Workspace) -> DataFrame:
    """``q, node``: for each query the ``keep`` items with the best codes in the lists it probes.

    Queries are in chunks of near ones. A chunk is sent once, to one task, and each block of
    a list that any of its queries probes passes there, so what is written is a row for each
    query and the codes times the chunks, of which there are CHUNKS until they hold QUERIES
    or KEPT candidates each. Of few queries the blocks are parted in slices besides. guides:
    vectors of the index; a candidate that is worse than the keep-th of these is not held.
    """
    shown = book.decode(book.encode(guides))
    n, blocks = queries.count(), index.count()
    chunks = max(math.ceil(n / min(QUERIES, max(1, KEPT // keep))), min(CHUNKS, math.ceil(n / FEW_QUERIES)), 1)
    slices = max(1, min(math.ceil(CHUNKS / chunks), math.ceil(blocks / FEW_BLOCKS)))

    def placed(batches):
        for b in batches:
            x = _matrix(b.column("vec"))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(_place(x, b.column("node").to_numpy(), book))], ["place"])

    shares = [k / chunks for k in range(1, chunks)]
    bounds = np.array(queries.select("node", "vec").mapInArrow(placed, "place double").agg(F.percentile_approx("place", shares, 10_000)).first()[0] if shares else [])

    def probed(batches):
        seen = np.zeros((chunks, book.lists), bool)
        names = ["chunk", "list", "q", "vec", "low", "reach"]
        for b in batches:
            x = _matrix(b.column("vec"))
            if not len(x):
                continue
            chunk = np.searchsorted(bounds, _place(x, b.column("node").to_numpy(), book), side="right")
            low, reach = np.empty(len(x)), np.empty(len(x))
            for row, lists, least in _probed(x, book, probes, keep, shown):
                seen[chunk[row], lists] = True
                # The last list of a row is its farthest.
                last = np.flatnonzero(np.diff(row, append=-1))
                low[row[last]], reach[row[last]] = least[last], book.gap(x[row[last]], lists[last])
            if probes >= book.lists:
                reach[:] = np.inf
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.nulls(len(x), pa.int64()), b.column("node"), b.column("vec"), pa.array(low), pa.array(reach)], names)
        chunk, lists = np.nonzero(seen)
        for k in range(0, len(chunk), 65_536):
            part = [pa.array(v[k : k + 65_536]) for v in (chunk, lists)]
            yield pa.RecordBatch.from_arrays([*part, *(pa.nulls(len(part[0]), kind) for kind in (pa.int64(), pa.binary(), pa.float64(), pa.float64()))], names)

    def compared(batches):
        best, waiting, group = None, [], None
        for b in batches:
            groups, is_query = b.column("group").to_numpy(), b.column("q").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(groups) != 0) | (np.diff(is_query) != 0) | ~is_query[1:]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo and groups[lo] != group:
                    if best:
                        yield from best.rows()
                    best, waiting, group = None, [], groups[lo]
                part = b.slice(lo, hi - lo)
                if hi > lo and is_query[lo]:
                    waiting.append([*(part.column(c).to_numpy() for c in ("q", "low", "reach")), _matrix(part.column("vec"))])
                elif hi > lo and waiting:
                    if best is None:
                        q, low, reach, x = (np.concatenate(c) for c in zip(*waiting, strict=True))
                        best = _Best(q, x, low, reach, book, keep)
                    own = part.column("items").flatten()
                    best.meet(part.column("list")[0].as_py(), own.field("node").to_numpy(), np.frombuffer(b"".join(own.field("code").to_pylist()), np.uint8).reshape(len(own), -1))
        if best:
            yield from best.rows()

    asked = work.save(queries.select("node", "vec").mapInArrow(probed, "chunk bigint, list bigint, q bigint, vec binary, low double, reach double"), "probes")
    wanted = asked.where("q is null").select("chunk", "list").distinct()
    group = lambda part: (F.col("chunk") * slices + part).cast("int").alias("group")
    held = index.join(wanted, "list").select(group(F.pmod(F.xxhash64("list", "block"), F.lit(slices))), "list", "block", "items")
    sent = asked.where("q is not null").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(group(F.col("slice")), "q", "vec", "low", "reach")
    both = held.unionByName(sent, allowMissingColumns=True).repartitionById(chunks * slices, F.col("group"))
    both = both.sortWithinPartitions("group", F.col("q").isNull(), "list", "block").select("group", "list", "items", "q", "vec", "low", "reach")
    found = both.mapInArrow(compared, "q bigint, node bigint, near double")
    if slices > 1:
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("near"), "node"))).where(F.col("rank") <= keep)
    return found.select("q", "node")


def _rescored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``q, node, sim``: the pairs' cosines of the full vectors, in double precision."""

    def run(batches):
        for b in batches:
            x, y = (_matrix(b.column(c)).astype(np.float64) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array((x * y).sum(1))], ["q", "node", "sim"])

    j = pairs.join(vectors.select("node", F.col("vec").alias("y")), "node").join(queries.select(F.col("node").alias("q"), F.col("vec").alias("x")), "q")
    return j.select("q", "node", "x", "y").mapInArrow(run, "q bigint, node bigint, sim double")


def nearest(items: DataFrame, k: int, *, id_col: str, vector_col: str, queries: DataFrame | None = None, target_recall: float = 0.98) -> DataFrame:
    """``id, neighbour, similarity, rank``: for each query the k nearest other items by cosine.

    queries is a table like items, whose rows are found by their ids; items themselves if not
    given. Rank 1 is the most similar, ties go by the neighbour's id. An item is no neighbour
    of its own id, an exact copy with another id is one.

    Equal vectors are one node of the index with the k + 1 least of their ids, which is all
    that an answer can name. Centres and codes are trained on SAMPLE vectors, every vector
    is indexed. The numbers of lists probed and of candidates rescored are the least that
    lose no more than the target allows of the exact neighbours of MEASURED queries;
    vectors without any clusters take most lists.

    Rows with a null id or vector, null, infinite or NaN numbers or only zeros are no items
    and have no neighbours. Repeated rows count once; an id with several vectors
    has the neighbours of all. All vectors have one length, else
    numpy raises. An empty table gives no rows.
    """
    work = Workspace(items.sparkSession)
    known = work.save(unit_vectors(items, id_col, vector_col).distinct(), "vectors")
    asked = known if queries is None else work.save(unit_vectors(queries, id_col, vector_col).distinct(), "queries")
    # Written once, so that the numbers stay.
    nodes = work.save(known.select("vec").union(asked.select("vec")).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = lambda df: df.join(nodes, "vec").select("id", "node")
    members = work.save(named(known), "members")
    indexed = work.save(nodes.join(members.select("node").distinct(), "node", "left_semi"), "indexed") if queries is not None else nodes
    searched = nodes if queries is None else nodes.join(asked.select("vec").distinct(), "vec", "left_semi")
    rows = indexed.count()
    empty = items.sparkSession.createDataFrame([], f"id {known.schema['id'].dataType.simpleString()}, neighbour {known.schema['id'].dataType.simpleString()}, similarity double, rank int")
    if not rows:
        return empty
    guides = _first(indexed, SAMPLE, 1)
    book = train(guides, rows)
    probes, keep = settings(indexed, book, _first(searched, MEASURED, 2), k, target_recall)
    index = work.save(build_lists(indexed, book), "lists")
    pairs = work.save(_candidates(index, searched, book, probes, keep, guides[:8192], work), "candidates")
    # A node is near itself, whatever its code says: copies of a query are neighbours.
    own = nodes.select(F.col("node").alias("q"), "node")
    near = work.save(_rescored(pairs.where("q <> node").union(own), nodes, indexed), "near")

    best = W.partitionBy("q").orderBy(F.desc("sim"), "node")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    few = members.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("id"))).where(F.col("place") <= k + 1).select("node", F.col("id").alias("neighbour"))
    answers = near.join(few, "node").select("q", "neighbour", F.col("sim").alias("similarity"))
    asking = (members if queries is None else named(asked)).withColumnRenamed("node", "q")
    out = asking.join(answers, "q").where("id <> neighbour").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return out.select("id", "neighbour", "similarity", rank.alias("rank")).where(F.col("rank") <= k)

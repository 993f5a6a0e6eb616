"""SimHash near-duplicates with tables of distances to reference fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, mix64, utf8
from .common import Scratch, small_batches
from .graph import connected_components

#: Words in a shingle, the seed of its hash, and bits in which linked fingerprints may differ.
SHINGLE, SEED, NEAR = 3, 42, 3
#: Reference fingerprints (pivots); the distance to the first orders a bucket.
PIVOTS = 16
#: Members from which a bucket is split by more bits, and how often; what is larger then is dealt in tiles.
BUCKET, SPLITS = 1024, 2
#: Bytes of a text that are split into words at a time, and rows compared at a time in a task.
PIECE, ROWS = 1 << 20, 1 << 16
_U = np.uint64
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

# ---- fingerprints ---------------------------------------------------------------------


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes that end at white space."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def fingerprint(text: bytes) -> int:
    """64 bits of a text whose A-Z are lower-cased: each is set if it is in over half of the shingles' hashes."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for piece in _pieces(text):
        w = held + piece.split()
        if len(w) >= SHINGLE:
            h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)), repeat(SEED)), _U, len(w) - SHINGLE + 1)
            for k in range(0, len(h), 1 << 14):
                ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        held = w[1 - SHINGLE :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, fp``: fp has the fingerprint's bits as a signed number."""

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text"):
                data, off = utf8(b.column("text"))
                low, off = data.tobytes().lower(), off.tolist()
                fp = np.array([fingerprint(low[a:z]) for a, z in zip(off, off[1:], strict=False)], _U)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


# ---- pivots ---------------------------------------------------------------------------


def pivots() -> np.ndarray:
    """The reference fingerprints: fixed numbers with random bits."""
    return mix64(np.arange(1, PIVOTS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def distances(fp: np.ndarray) -> np.ndarray:
    """Differing bits of each fingerprint (rows) and each pivot (columns)."""
    return np.bitwise_count(fp.view(_U)[:, None] ^ pivots())


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp, first, near`` of distinct fingerprints: the distance to the first pivot, and those to all as bytes."""

    def run(batches):
        for b in batches:
            table = distances(b.column("fp").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(table[:, 0].astype(np.int32)), pa.array([row.tobytes() for row in table], pa.binary())], ["fp", "first", "near"])

    return fps.select("fp").mapInArrow(run, "fp bigint, first int, near binary")


# ---- buckets --------------------------------------------------------------------------


def masks(splits: int) -> list[int]:
    """The bits that the members of a bucket agree in, after so many splits.

    Fingerprints that differ in NEAR bits agree in one of NEAR + 1 parts of the bits, and so
    again in one of as many parts of those that are left: every pair of near ones shares a
    bucket of each split.
    """
    out = [0]
    for _ in range(splits + 1):
        below = []
        for mask in out:
            left = [k for k in range(64) if not mask >> k & 1]
            cut = [len(left) * j // (NEAR + 1) for j in range(NEAR + 2)]
            below += [mask | sum(1 << k for k in left[a:z]) for a, z in zip(cut, cut[1:], strict=False)]
        out = below
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(table: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows ``mask, key, p, q, first, near, fp``: fingerprints of one (mask, key, p, q) are to be compared.

    Buckets of one are left out, those of more than BUCKET are split by more bits. Members
    of one that is as large after SPLITS splits are dealt to tiles, of which every two meet
    in one place (p, q); tiles grow with the root of the bucket.
    """
    ready, rows = [], table.withColumn("mask", F.lit(0))
    for split in range(SPLITS + 1):
        below = F.array(*(F.lit(_signed(m)) for m in masks(split)))
        rows = rows.withColumn("mask", F.explode(F.sequence(F.col("mask") * (NEAR + 1), F.col("mask") * (NEAR + 1) + NEAR)))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.element_at(below, F.col("mask") + 1)))
        sizes = scratch.save(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        rows = scratch.save(rows.join(sizes.hint("merge"), ["mask", "key"]).withColumn("split", F.lit(split)), "members")
        ready.append(rows if split == SPLITS else rows.where(F.col("size") <= BUCKET))
        rows = rows.where(F.col("size") > BUCKET).select(*table.columns, "mask")
        if not rows.limit(1).count():
            break
    tiles = F.ceil(F.sqrt(F.greatest(F.col("size") / BUCKET, F.lit(1.0)))).cast("int")
    out = ready[0]
    for more in ready[1:]:
        out = out.union(more)
    out = out.withColumn("tiles", F.when(F.col("split") == SPLITS, tiles).otherwise(1)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return out.select("split", "mask", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "first", "near", "fp")


def near_pairs(group: np.ndarray, table: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of one group at most NEAR bits apart; rows ascend by group, then by the distance to the first pivot.

    A row meets those after it until their distances to the first pivot are over NEAR apart.
    A pair goes when those to another pivot are; by the triangle inequality no near pair
    does. What is left is verified.
    """
    alive, step = np.arange(len(group) - 1), 0
    first = table[:, 0].astype(np.int64)
    while len(alive):
        step += 1
        alive = alive[alive + step < len(group)]
        alive = alive[(group[alive + step] == group[alive]) & (first[alive + step] - first[alive] <= NEAR)]
        i = alive
        for k in range(1, table.shape[1]):
            a, b = table[i, k], table[i + step, k]
            i = i[np.maximum(a, b) - np.minimum(a, b) <= NEAR]
            if not len(i):
                break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= NEAR]
        if len(i):
            yield i, i + step


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The first row that each of n rows is joined with by pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def links(rows: DataFrame) -> DataFrame:
    """``u, v``: a forest of each place's fingerprints that are near, or joined by near ones."""
    keys = ["split", "mask", "key", "p", "q"]

    def work(t: pa.Table) -> pa.RecordBatch:
        new = np.zeros(len(t), np.int64)
        for c in keys:
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        fp = t.column("fp").to_numpy()
        table = np.frombuffer(b"".join(t.column("near").to_pylist()), np.uint8).reshape(-1, PIVOTS)
        root = forest(near_pairs(np.cumsum(new), table, fp.view(_U)), len(fp))
        far = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[root[far]]), pa.array(fp[far])], ["u", "v"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                # The last place's rows may go on in the next batch.
                last = np.ones(len(t), bool)
                for c in keys:
                    x = t.column(c).to_numpy()
                    last &= x == x[-1]
                cut = int(np.argmax(last))
                if cut:
                    yield work(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = len(t) - cut if cut else 0
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield work(t.combine_chunks())

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "first")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def simhash_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, component_id`` for every document.

    1. One pass makes fingerprints; equal ones are one node from here on.
    2. Each gets its distances to the pivots, once. Fingerprints that agree in one of four
       parts of their bits share a bucket; within it pairs are discarded by the largest
       difference of their distances, and survivors are verified.
    3. Linked fingerprints make components, named by the least id in them.

    Null and wordless texts have fingerprint zero, linked like any other. Null ids name a
    component only where it has no other id, by null; rows that repeat an id each stay.
    Other columns do not matter; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.save(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = scratch.save(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    table = scratch.save(pivot_table(fps), "pivots")
    edges = scratch.save(links(buckets(table, scratch)).distinct(), "links")
    comps = connected_components(edges, scratch).select(F.col("node").alias("fp"), "label")
    joined = scratch.save(comps.join(fps.hint("merge"), "fp"), "joined")
    # Written, so that the join has two plain sides and a component with most of the nodes can be split.
    least = scratch.save(joined.groupBy("label").agg(F.min("least").alias("name")), "least")
    names = scratch.save(joined.join(least.hint("merge"), "label").select("fp", "name"), "names")
    names = scratch.save(fps.join(names.hint("merge"), "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")), "named")
    return own.join(names.hint("merge"), "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

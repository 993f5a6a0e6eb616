"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof for each row.

Blocks of BLOCK leaves are reduced on the executors, round after round, until few nodes are
left. The driver builds the top of the tree from these and sends each node's path to the root
back; executors finish the rows' proofs within their blocks.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, lower_ascii, maybe_broadcast, small_batches

#: Consecutive nodes with one parent, and levels of the tree in a block.
RUN, LEVELS = 16, 2
BLOCK = RUN**LEVELS
#: Nodes of which the driver builds the top of the tree, at most; more are reduced in blocks once more.
MOST_TOP = 4096

_PATH = "array<struct<before:string,after:string>>"

# ---- trees of at most a block or a top ------------------------------------------------


def levels_of(total: int, most: int) -> int:
    """Levels from so many nodes to one, ``most`` at most."""
    levels = 0
    while total > 1 and levels < most:
        total, levels = -(-total // RUN), levels + 1
    return levels


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes, then those of each level above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([sha256("".join(out[-1][k : k + RUN]).encode()).hexdigest() for k in range(0, len(out[-1]), RUN)])
    return out


def path(tree: list[list[str]], k: int) -> list[tuple[str, str]]:
    """Siblings of the k-th node on each level below the last: those before and those after it, joined."""
    out = []
    for nodes in tree[:-1]:
        first = k - k % RUN
        out.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + RUN])))
        k //= RUN
    return out


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for before, after in steps:
        node = sha256((before + node + after).encode()).hexdigest()
    return node


def proof_digest(steps: list[tuple[str, str]]) -> str:
    return sha256("".join(before + after for before, after in steps).encode()).hexdigest()


# ---- leaves and their places ----------------------------------------------------------


def digest(*fields: Column) -> Column:
    """sha256 of the fields, each as its bytes' number, a colon and its text, or ``-`` if null."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.encode(F.concat(*map(text, fields)), "UTF-8"), 256))


def ranked(nodes: DataFrame, tree: Column, order: list[Column], scratch: Scratch) -> DataFrame:
    """nodes with ``tree``, ``pos`` (place among the tree's nodes, from 0) and ``total`` (their number).

    Rows are dealt out by ranges, so that a tree with most of the rows has many tasks; a
    task's part of a tree begins after what the tasks before it hold. ``order`` tells all
    rows of a tree apart.
    """
    by = [F.col("tree").asc_nulls_first(), *order]
    placed = nodes.withColumn("tree", tree).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = scratch.save(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("at", 33).alias("task")
    parts = placed.groupBy("tree", task).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from"))
    whole = W.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.save(parts.select(F.col("tree").alias("t"), "task", (before - F.col("from")).alias("shift"), F.sum("n").over(whole).alias("total")), "parts")
    j = placed.join(maybe_broadcast(parts), F.col("tree").eqNullSafe(F.col("t")) & (F.shiftright("at", 33) == F.col("task")))
    return j.drop("t", "task").withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift")


def blocked(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``tree, block, total, nodes``: BLOCK nodes in order in a row; ``nodes`` has pos, digest and keys."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "digest", *keys))).alias("nodes")
    return nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("total").alias("total"), rows)


def _hexes(column: pa.Array, name: str) -> list[list[str | None]]:
    """For each row of a list of structs the field's binaries as hex text."""
    flat = [None if x is None else x.hex() for x in column.flatten().field(name).to_pylist()]
    at = [0, *column.value_lengths().to_pylist()]
    for k in range(1, len(at)):
        at[k] += at[k - 1]
    return [flat[a:z] for a, z in zip(at, at[1:], strict=False)]


def reduced(blocks: DataFrame) -> DataFrame:
    """The node above each block: ``tree, pos, total, digest``."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out, total = [], b.column("total").to_pylist()
            for nodes, n in zip(_hexes(b.column("nodes"), "digest"), total, strict=True):
                out.append(bytes.fromhex(climb(nodes, levels_of(n, LEVELS))[-1][0]))
            total = [-(-n // RUN ** levels_of(n, LEVELS)) for n in total]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), pa.array(total, pa.int64()), pa.array(out, pa.binary())], ["tree", "pos", "total", "digest"])

    kind = blocks.schema["tree"].dataType.simpleString()
    return small_batches(blocks).select("tree", "block", "total", "nodes").mapInArrow(run, f"tree {kind}, pos bigint, total bigint, digest binary")


# ---- the top and the way down ---------------------------------------------------------


def top(nodes: list[tuple], over_sources: bool) -> list[tuple]:
    """``tree, pos, subroot, root, path`` of the nodes ``(tree, pos, digest)``, which lie in order of tree and pos.

    If over_sources they are nodes of the one tree over all sources; then subroot is not known here.
    """
    if over_sources:
        tree = climb([d for *_, d in nodes], levels_of(len(nodes), 99))
        return [(t, pos, None, tree[-1][0], path(tree, k)) for k, (t, pos, _) in enumerate(nodes)]
    own: dict = {}
    for t, pos, d in nodes:
        own.setdefault(t, []).append((pos, d))
    trees = [climb([d for _, d in rows], levels_of(len(rows), 99)) for rows in own.values()]
    upper = climb([t[-1][0] for t in trees], levels_of(len(trees), 99))
    return [(t, pos, tree[-1][0], upper[-1][0], path(tree, k) + path(upper, i)) for i, (t, rows) in enumerate(own.items()) for tree in [trees[i]] for k, (pos, _) in enumerate(rows)]


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    p = paths.withColumnsRenamed({"tree": "t", "pos": "p"})
    return blocks.join(p, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("p"))).drop("t", "p")


def _steps(b: pa.RecordBatch) -> list[list[tuple[str, str]]]:
    return [[(s["before"], s["after"]) for s in steps] for steps in b.column("path").to_pylist()]


def child_paths(blocks: DataFrame, paths: DataFrame, source_kind: str) -> DataFrame:
    """Paths of the nodes in blocks that have keys ``child_tree, child_pos``, from those of the blocks."""

    def run(batches):
        for b in batches:
            flat = b.column("nodes").flatten() if b.num_rows else None
            at = 0
            rows = zip(_hexes(b.column("nodes"), "digest"), b.column("total").to_pylist(), b.column("subroot").to_pylist(), b.column("root").to_pylist(), _steps(b), strict=True) if b.num_rows else ()
            for nodes, total, subroot, root, above in rows:
                tree = climb(nodes, levels_of(total, LEVELS))
                own = flat.slice(at, len(nodes))
                at += len(nodes)
                yield pa.RecordBatch.from_arrays([
                    own.field("child_tree"), own.field("child_pos"), pa.array([subroot or d for d in nodes], pa.string()), pa.array([root] * len(nodes), pa.string()),
                    pa.array([[{"before": x, "after": y} for x, y in path(tree, k) + above] for k in range(len(nodes))], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                ], ["tree", "pos", "subroot", "root", "path"])

    rows = _with_paths(blocks, paths).select("nodes", "total", "subroot", "root", "path")
    return rows.mapInArrow(run, f"tree {source_kind}, pos bigint, subroot string, root string, path {_PATH}")


def proven(blocks: DataFrame, paths: DataFrame, id_kind: str) -> DataFrame:
    """A row for each leaf: its proof, and the root that its tampered digest, or its own, gives with the siblings."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            nodes, at = b.column("nodes"), 0
            ids = nodes.flatten().field("id")
            rows = zip(_hexes(nodes, "digest"), _hexes(nodes, "tampered"), b.column("total").to_pylist(), b.column("subroot").to_pylist(), b.column("root").to_pylist(), _steps(b), strict=True)
            for leaves, tampered, total, subroot, root, above in rows:
                tree, n = climb(leaves, levels_of(total, LEVELS)), len(leaves)
                paths = [path(tree, k) + above for k in range(n)]
                folded = [fold(t or leaf, p) for leaf, t, p in zip(leaves, tampered, paths, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, n), pa.array(leaves), pa.array([subroot] * n), pa.array([root] * n), pa.array([proof_digest(p) for p in paths]), pa.array(folded), pa.array([x == root for x in folded]),
                ], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
                at += n

    rows = _with_paths(blocks, paths).select("nodes", "total", "subroot", "root", "path")
    return rows.mapInArrow(run, f"id {id_kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, tampered: DataFrame | None = None, *, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tamper: Column | None = None, tampered_text: Column | None = None, text_col: str = "text") -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of docs.

    A leaf is the digest of ``columns``. A source's leaves ascend by id (nulls first; rows
    that repeat an id by digest) and every RUN consecutive nodes become one, level by level,
    until one is left, the subroot; subroots, by source with null first, become the root
    likewise. ``proof_sha256`` is the digest of a leaf's siblings from the bottom up. Where
    ``tamper`` holds, the row is folded with ``tampered_text`` in place of its text, so that
    ``verified`` shows whether the change is found.

    Nulls in any column are part of a leaf, a null source is a source of its own, repeated
    rows are leaves each, an empty table has no rows. Other columns do not matter. Only
    digests and ids are shuffled; a task holds BLOCK leaves and their paths at a time, the
    driver MOST_TOP nodes.
    """
    scratch = Scratch(docs.sparkSession)
    leaf = digest(*(F.col(c) for c in columns))
    changed = digest(*(tampered_text if c == text_col and tampered_text is not None else F.col(c) for c in columns))
    changed = F.when(tamper, changed) if tamper is not None else F.lit(None).cast("binary")
    # The row number lets ranges split rows that are equal in all else.
    leaves = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf.alias("digest"), changed.alias("tampered"), F.monotonically_increasing_id().alias("row"))
    leaves = scratch.save(leaves, "leaves")
    id_kind, source_kind = (leaves.schema[c].dataType.simpleString() for c in ("id", "source"))
    nodes = ranked(leaves, F.col("source"), [F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")], scratch)
    rounds = [scratch.save(blocked(nodes, ["id", "tampered"]), "blocks")]
    nodes = scratch.save(reduced(rounds[0]), "nodes")
    over_sources = False
    while nodes.count() > MOST_TOP:
        keys = nodes.withColumns({"child_tree": F.col("tree"), "child_pos": F.col("pos")})
        if not over_sources and not nodes.where("total > 1").limit(1).count():
            # Each source has one node, so what is left is the tree over them.
            keys, over_sources = ranked(keys.drop("pos", "total"), F.lit(0), [F.col("child_tree").asc_nulls_first()], scratch), True
        rounds.append(scratch.save(blocked(keys, ["child_tree", "child_pos"]), "blocks"))
        nodes = scratch.save(reduced(rounds[-1]), "nodes")
    last = nodes.orderBy(F.col("tree").asc_nulls_first(), "pos").select("tree", "pos", "digest").collect()
    kind = nodes.schema["tree"].dataType.simpleString()
    paths = docs.sparkSession.createDataFrame(top([(t, pos, bytes(d).hex()) for t, pos, d in last], over_sources), f"tree {kind}, pos bigint, subroot string, root string, path {_PATH}")
    paths = F.broadcast(paths)
    for blocks in rounds[:0:-1]:
        paths = maybe_broadcast(scratch.save(child_paths(blocks, paths, source_kind), "paths"))
    return proven(rounds[0], paths, id_kind)


def tamper_fifth(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, folded with lower-cased texts where crc32 of the id as text is divisible by five."""
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    return manifest(docs, tamper=hit, tampered_text=lower_ascii(F.col("text")))

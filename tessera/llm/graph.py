"""Connected components as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label every node of undirected ``edges (u, v)`` with the least node it can reach.

    Each round sends labels along edges to both the neighbour and the neighbour's
    current root, takes minima (combined before the shuffle), then replaces each label
    by its label's label; paths therefore shrink geometrically. Labels are written to
    the shared folder between rounds. A star's centre is a hot join key, which adaptive
    execution splits because both sides of each join are plain shuffled scans.

    Null ends, self-loops and repeated edges add nothing. Returns ``(node, label)``,
    without rows for an empty input.
    """
    both = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    both = scratch.save(both.union(both.select("v", "u")).distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), "labels")
    while True:
        at_v = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        at_u = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        told = both.join(at_v.hint("merge"), "v").join(at_u.hint("merge"), "u").where("lv < lu")
        told = told.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("lv").alias("label")), F.struct(F.col("lu").alias("node"), F.col("lv").alias("label")))).alias("m")).select("m.*")
        told = scratch.save(told.groupBy("node").agg(F.min("label").alias("label")), "told")
        # Where no edge joins two labels, every component has the one of its least node.
        if not told.limit(1).count():
            scratch.drop(both, told)
            return labels
        hooked = scratch.save(labels.union(told).groupBy("node").agg(F.min("label").alias("label")), "labels")
        root = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = scratch.save(hooked.join(root.hint("merge"), "label").select("node", F.col("root").alias("label")), "labels")
        scratch.drop(labels, hooked, told)
        labels = new

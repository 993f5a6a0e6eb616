"""Chat formatting: collapse cumulative snapshots, then render what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

#: Turns or rows in a block of the two-level running sums, and rows in a part of a rendered conversation.
BLOCK = 1024
_LANES = ("l0", "l1", "l2", "l3")


def _lanes(digest: Column) -> list[Column]:
    """A 128-bit digest as four numbers below 2^32, whose sums can't overflow."""
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(_LANES)]


def _digest() -> Column:
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.md5(F.concat_ws("|", F.col("turn").cast("string"), part(F.col("role")), part(F.col("text"))))


def _same(a: DataFrame, b: DataFrame, *more: str) -> Column:
    """A join condition on conv, null equal to null, and other columns."""
    on = a["conv"].eqNullSafe(b["conv"])
    for c in more:
        on = on & (a[c] == b[c])
    return on


def running(rows: DataFrame, by: tuple[str, ...], values: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """Rows in the order of turn, role and text, with values replaced by their sums up to the row within ``by``.

    Rows are range-partitioned and numbered; sums are taken within blocks of these numbers
    and then over block totals, so one conversation or turn may hold a large share of all rows.
    """
    order = (F.col("conv").asc_nulls_first(), F.col("turn").asc(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    s = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    s = scratch.save(s.withColumn("block", F.floor(F.col("at") / BLOCK)), "ordered")
    before = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = s.groupBy(*by, "block").agg(*(F.sum(x).alias(x) for x in values))
    blocks = blocks.select(*by, "block", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in values))
    within = W.partitionBy(*(s[c] for c in by), s["block"]).orderBy("at")
    sums = {x: F.col(f"{x}_before") + F.sum(x).over(within) for x in values}
    return s.join(blocks, _same(s, blocks, *by[1:], "block")).select(*(sums[c].alias(c) if c in values else s[c] for c in rows.columns))


def prefix_hashes(conv: DataFrame, scratch: Scratch) -> DataFrame:
    """Rolling hash after every row: ``conv, n, l0..l3, final``, rows of a turn in the order of role and text.

    Each row's digest covers its turn's number, role and text; the rolling hash adds the digests
    so far, so it is a prefix sum. Turns are summed first; their prefix sums are taken within
    blocks of turn numbers and then over block totals. Rows that share a turn are then summed
    within it: only their texts are shuffled.
    """
    turns = conv.select("conv", "turn", _digest().alias("digest")).distinct().select("conv", "turn", *_lanes(F.col("digest")))
    turns = turns.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(x) for x in _LANES))
    turns = scratch.save(turns.withColumn("block", F.floor(F.col("turn") / BLOCK)), "turns")
    sums = ("n", *_LANES)
    blocks = turns.groupBy("conv", "block").agg(*(F.sum(x).alias(x) for x in sums))
    by = W.partitionBy("conv").orderBy("block")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in sums), F.lead("block").over(by).isNull().alias("last"))
    within = W.partitionBy(turns["conv"], turns["block"]).orderBy("turn")
    run = {x: F.col(f"{x}_before") + F.sum(x).over(within) for x in sums}
    ends = turns.join(blocks, _same(turns, blocks, "block")).select(turns["conv"], "turn", *(c.alias(x) for x, c in run.items()), *(F.col(x).alias(f"{x}_own") for x in sums), (F.col("last") & F.lead("turn").over(within).isNull()).alias("final"))
    ends = scratch.save(ends, "ends")
    out = ends.select("conv", *sums, "final")
    shared = ends.where("n_own > 1").select("conv", "turn", *(F.col(x).alias(f"{x}_end") for x in sums), *(f"{x}_own" for x in sums))
    if not shared.limit(1).count():
        return out
    rows = conv.join(shared.select("conv", "turn"), _same(conv, shared, "turn"), "left_semi").distinct()
    rows = running(rows.select("*", F.lit(1).cast("long").alias("n"), *_lanes(_digest())), ("conv", "turn"), sums, scratch)
    inner = rows.join(shared, _same(rows, shared, "turn")).where("n < n_own")
    return out.unionByName(inner.select(rows["conv"], *((F.col(f"{x}_end") - F.col(f"{x}_own") + F.col(x)).alias(x) for x in sums), F.lit(False).alias("final")))


def maximal_conversations(conv: DataFrame, scratch: Scratch) -> DataFrame:
    """Ids of conversations that are no proper prefix of another; of equal ones the least id."""
    runs = scratch.save(prefix_hashes(conv, scratch), "prefixes")
    key = ["n", *_LANES]
    whole = runs.where("final").groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    whole = scratch.save(whole, "whole")
    longer = runs.where("not final").select(*key).distinct()
    return whole.join(longer, key, "left_anti").select("conv", F.col("n").alias("n_turns"), "copies")


def format_chats(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render maximal conversations: ``conv_id, part, n_turns, copies, n_chars, text``.

    A logged conversation whose rows are the first rows of a longer one, by rolling hash, is
    dropped (anti-join); equal conversations leave the least id with the number of copies.
    Rows are in the order of turn, role and text (nulls last), so a snapshot may end between
    two rows of one turn. The rest is rendered in parts of ``BLOCK`` rows: no row or task
    holds an unbounded conversation, and only conversations with more rows are sorted for it.

    Repeated rows count once. A null turn is turn -1, a null role is ``user`` and a null text
    empty when rendered, but they differ from these when compared. Rows with a null
    conversation id form one conversation. An empty table gives no rows.
    """
    scratch = Scratch(conversations.sparkSession)
    rows = conversations.select(F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col), F.lit(-1)).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kept = scratch.save(maximal_conversations(rows, scratch).withColumnRenamed("conv", "k"), "kept")
    live = lambda k: rows.join(k, F.col("conv").eqNullSafe(F.col("k"))).drop("k")
    parts = live(kept.where(f"n_turns <= {BLOCK}")).withColumn("part", F.lit(0).cast("long"))
    long = kept.where(f"n_turns > {BLOCK}")
    if long.limit(1).count():
        long = running(live(long).distinct().withColumn("at_row", F.lit(1).cast("long")), ("conv",), ("at_row",), scratch)
        parts = parts.unionByName(long.withColumn("part", F.floor((F.col("at_row") - 1) / BLOCK)).drop("at_row"))
    ordered = F.array_sort(F.collect_set(F.struct("turn", F.col("role").isNull().alias("no_role"), "role", F.col("text").isNull().alias("no_text"), "text")))
    one = lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("user")), F.lit("|>\n"), F.coalesce(m["text"], F.lit("")), F.lit("<|end|>\n"))
    out = parts.groupBy("conv", "part").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.array_join(F.transform(ordered, one), "").alias("text"))
    return out.select(F.col("conv").alias(conv_col), "part", "n_turns", "copies", F.length("text").cast("long").alias("n_chars"), "text")

"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, maybe_broadcast, word_count

#: Parts of the order statistic's range for each unit of its natural logarithm. They are counted level by level, each inside the one part of the level before in which a source's target falls.
LEVELS = (16, 1024, 65_536)
#: Expected copies grow with a text's length class up to this class.
TOP_CLASS = 6
#: Rows of a table within which equal rows are numbered before their blocks meet.
BLOCK = 1 << 16
_HALF = 2.0**-53


def length_weight(size: Column) -> Column:
    """Relative number of copies, 1 to TOP_CLASS: the bit length of size / 8."""
    return F.least(F.lit(TOP_CLASS), F.length(F.bin(F.floor(size / 8).cast("long")))).cast("int")


def _part(q: Column, parts: int = LEVELS[-1]) -> Column:
    """The part that a place in the order falls in; null without a place.

    The logarithm of random odds has a logistic distribution, which inclusion odds only shift:
    however small or large a probability is, no part gets more than about 1 / (4 * parts) of its rows.
    """
    return F.floor(F.log(q) * parts).cast("int")


def _drawn(rows: DataFrame, seed: str) -> DataFrame:
    """Add ``weight``, the hash ``draw`` of a row's id, text and number, and the random number ``u`` that it makes."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.col("digest"), F.col("number").cast("string")))
    u = F.conv(F.substring("draw", 1, 13), 16, 10).cast("double") * F.lit(2 * _HALF) + F.lit(_HALF)
    return rows.withColumns({"weight": length_weight(F.col("size")), "draw": draw}).withColumn("u", u)


def _identified(id_: Column, source: Column, text: Column) -> dict[str, Column]:
    """What names a row: a hash of its text, and a key that equal rows share."""
    return {"digest": F.md5(F.coalesce(text, F.lit(""))), "key": F.xxhash64(id_, source, text)}


def _numbered(rows: DataFrame, repeated: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Add ``number``: 1, or for rows whose key repeats the place among its rows, whichever comes first.

    Rows of a key are numbered in blocks of the table and then over counts of blocks, so
    that a key which very many rows share is not one task's work.
    """
    if repeated is None:
        return rows.withColumn("number", F.lit(1).cast("long"))
    keys = maybe_broadcast(repeated)
    own = scratch.save(rows.join(keys, "key", "left_semi").withColumn("at", F.monotonically_increasing_id()), "repeats").withColumn("block", F.floor(F.col("at") / BLOCK))
    blocks = own.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = scratch.save(blocks.select("key", "block", before.alias("before")), "blocks")
    own = own.join(blocks, ["key", "block"]).withColumn("number", F.col("before") + F.row_number().over(W.partitionBy("key", "block").orderBy("at")))
    return rows.join(keys, "key", "left_anti").withColumn("number", F.lit(1).cast("long")).unionByName(own.select(*rows.columns, "number"))


def ranked_sources(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Number sources from 0 by code point, null last, without a task that sees them all.

    Range partitions are sorted each on its own; only their counts are added up in order.
    """
    split = sizes.repartitionByRange(F.col("source").asc_nulls_last())
    split = scratch.save(split.withColumn("part", F.spark_partition_id()), "ranges")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = split.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ranked = split.withColumn("n", F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())))
    return ranked.join(parts, "part").select("source", "source_size", (F.col("n") - 1 + F.col("before")).alias("rank"))


def source_targets(sources: DataFrame, share: tuple[int, int], weights: tuple[int, ...], most: int) -> DataFrame:
    """Words to take from each source: ``share`` (a fraction) of all words by weight.

    No target passes ``most`` times its source; the excess goes to the others by weight.
    One pass of sums per round of capping; only three numbers reach the driver.
    """
    num, den = share
    weighted = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    rate, capped = None, -1
    while True:
        over = F.lit(False) if rate is None else F.lit(rate) * F.col("w") > F.col("source_size") * most
        row = weighted.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(~over, F.col("w")).otherwise(0)).alias("rest"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not row.rest or row.n == capped:
            break
        rate, capped = (num * row.total - den * most * row.held) / (den * row.rest), row.n
    rate = 0.0 if rate is None else rate
    return weighted.withColumn("target", F.least(F.lit(rate) * F.col("w"), (F.col("source_size") * most).cast("double")))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = (3, 1, 2), most: int = 2, seed: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Decide how often the mix takes each document.

    Returns ``(sized, sources, repeated)``: the documents' ``id, source, size, weight, draw,
    u``; for each source, its target and the thresholds that settle every document's
    copies; and the keys of rows that repeat id, source and text, None if there are none.

    Within a source a document's expected copies are proportional to the weight of its
    length class, at most ``most``. Whole copies are certain; the fraction is an inclusion
    probability p. Documents are ranked by ``u / (1 - u)`` over ``p / (1 - p)`` and taken
    from the least until the words come nearest to what the source still lacks. The rank is
    found by counting words in parts of its range and in finer parts of the one in which the
    target falls, then ordering only the last of these: neither the parts nor the rows of a
    source that has most of the rows are many in one task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    named = _identified(F.col(id_col), F.col(source_col), F.col(text_col))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *(c.alias(k) for k, c in named.items()))
    sized = scratch.save(sized, "rows")
    repeated = scratch.save(sized.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    repeated = repeated if repeated.limit(1).count() else None
    numbered = _numbered(sized, repeated, scratch)
    sized = _drawn(numbered, seed).select("id", "source", "size", "weight", "draw", "u")
    sized = sized if repeated is None else scratch.save(sized, "sized")
    classes = scratch.save(sized.groupBy("source", "weight").agg(F.sum("size").alias("words")), "classes")
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(scratch.save(ranked_sources(sources, scratch), "sources"), share, weights, most)
    targets = scratch.save(targets, "targets")

    # The scale c at which sum(min(most, c * weight) * words) is the target; classes reach the cap by falling weight.
    by = W.partitionBy("source").orderBy(F.desc("weight"))
    cls = classes.join(maybe_broadcast(targets.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "inner")
    cls = cls.withColumns({
        "held": F.coalesce(F.sum("words").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum(F.col("weight") * F.col("words")).over(by.rowsBetween(0, W.unboundedFollowing)),
    })
    scale = F.try_divide(F.col("target") - F.col("held") * most, F.col("rest"))
    cls = cls.withColumn("c", F.when(scale * F.col("weight") <= most, scale))
    solved = cls.groupBy("source").agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.col("weight"))).alias("c"))
    solved = scratch.save(targets.join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "solved")

    placed = with_copies(sized, solved, most).select("source", "draw", "size", "whole", "q", "target")
    placed = placed.withColumn("part", _part(F.col("q"), LEVELS[0]))
    parts = placed.groupBy("source", "part").agg(
        F.sum(F.when(F.col("q").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target")
    )
    parts = scratch.save(parts, "parts")
    all_of, up_to = W.partitionBy("source"), W.partitionBy("source").orderBy("part")
    parts = parts.withColumn("lack", F.col("target") - F.sum("certain").over(all_of))
    parts = parts.withColumn("before", F.sum("words").over(up_to) - F.col("words"))
    cut = parts.where("words > 0 and before < lack and before + words >= lack").select("source", "part", "before", "lack")
    full = parts.where("words > 0").groupBy("source").agg(F.max("lack").alias("lack"), F.sum("words").alias("all_words"))
    cut = scratch.save(cut, "cut")

    def inside(cut: DataFrame) -> DataFrame:
        c = maybe_broadcast(cut.withColumnsRenamed({"source": "s", "part": "p"}))
        return placed.where("part is not null").join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")), "inner").drop("s", "p")

    for level in LEVELS[1:]:
        finer = inside(cut).withColumn("part", _part(F.col("q"), level)).groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("lack").alias("lack"))
        finer = finer.withColumn("before", F.col("before") + F.sum("words").over(up_to) - F.col("words"))
        cut = scratch.save(finer.where("words > 0 and before < lack and before + words >= lack").select("source", "part", "before", "lack"), "cut")
        placed = placed.withColumn("part", _part(F.col("q"), level))
    near = inside(cut)
    ranked = near.withColumn("upto", F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("q", "draw").rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.withColumn("start", F.col("upto") - F.col("size"))
    taken = ranked.where("start < lack and (upto <= lack or upto - lack < lack - start)")
    last = taken.groupBy("source").agg(F.max(F.struct("q", "draw")).alias("last"))
    # A source whose cut part yields no row takes all parts before it.
    cuts = cut.select("source", F.col("part").alias("cut_part")).join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    short = full.where("lack > all_words").select(F.col("source").alias("s3"), F.lit(True).alias("take_all"))
    ends = solved.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    ends = ends.join(short, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    return sized, scratch.save(ends, "ends"), repeated


def with_copies(sized: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """Whole copies of each document, and its place q in the Pareto order (null if it has no fraction)."""
    j = sized.join(maybe_broadcast(solved.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "inner").drop("s")
    expected = F.col("c") * F.col("weight")
    # Rounding must not leave a fraction just below the cap, for which every place in the order is about 0.
    expected = F.when(expected < most - 1e-9, expected).otherwise(float(most))
    j = j.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long"))
    j = j.withColumn("p", F.col("expected") - F.col("whole"))
    return j.withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))


def copies(sized: DataFrame, ends: DataFrame, most: int = 2) -> DataFrame:
    """Add ``copies``, ``source_size`` and ``target`` to sized documents."""
    j = with_copies(sized, ends, most)
    part = _part(F.col("q"))
    below = F.col("q").isNotNull() & (
        F.coalesce(F.col("take_all"), F.lit(False))
        | F.coalesce(part < F.col("cut_part"), F.lit(False))
        | F.coalesce((part == F.col("cut_part")) & (F.struct("q", "draw") <= F.col("last")), F.lit(False))
    )
    return j.withColumn("copies", F.col("whole") + F.when(below, 1).otherwise(0))


def mix_counts(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies.

    Null texts have no words; null sources are a source of their own, the last. What is drawn
    follows from id and text, so rows without an id or with a repeated one are drawn each by
    its text; rows that repeat both are numbered and drawn by number, and any of them may get
    the copies of any other. Other columns do not matter; an empty table gives no rows.
    """
    sized, ends, _ = plan_mix(docs, **kw)
    return copies(sized, ends, kw.get("most", 2)).select("id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: each document's row as many times as it is taken, columns as they were.

    Texts are read twice but not shuffled: a row's copies follow from its own columns and
    its source's thresholds. Only rows that repeat id, source and text are written once more
    with a number. Nulls, ties and empty tables are as in ``mix_counts``.
    """
    _, ends, repeated = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **kw)
    row = docs.select(F.struct("*").alias("row"))
    text = F.col("row")[text_col]
    row = row.withColumns({"id": F.col("row")[id_col], "source": F.col("row")[source_col], "size": word_count(text)})
    row = row.withColumns(_identified(F.col("id"), F.col("source"), text))
    row = _drawn(_numbered(row, repeated, Scratch(docs.sparkSession)), kw.get("seed", "mix"))
    out = copies(row, ends, kw.get("most", 2)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")

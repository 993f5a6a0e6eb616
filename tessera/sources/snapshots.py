"""Snapshots of a table with digests of their parts, and the difference of two that reads only parts that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a snapshot by a hash of the key, and parts that a filter lists at most.
PARTS, MOST_LISTED = 256, 1000


def _row_hash(df: DataFrame, seed: int) -> Column:
    # A null leaves a hash as it is, so it is told apart by a flag.
    return F.xxhash64(F.lit(seed), *(x for c in sorted(df.columns) for x in (F.col(f"`{c}`"), F.isnull(F.col(f"`{c}`")))))


def write_snapshot(df: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Write df to a new folder by ``parts`` hashes of its keys, with a digest of each: rows, and sums of two hashes of every row.

    Digests do not depend on the order of rows; both snapshots of a difference need the same
    number of parts.
    """
    placed = df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    placed.repartition("part").write.partitionBy("part").parquet(f"{path}/data")
    placed.limit(0).write.parquet(f"{path}/schema")
    data = _data(df.sparkSession, path)
    sums = [F.sum(_row_hash(df, k).cast("decimal(38,0)")).alias(f"sum{k}") for k in (1, 2)]
    data.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), *sums).coalesce(1).write.parquet(f"{path}/digests")


def _data(spark: SparkSession, path: str) -> DataFrame:
    """All parts; an empty snapshot has no file that tells its columns."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/data")


def parts_that_differ(spark: SparkSession, old: str, new: str) -> list[int]:
    """Parts whose digests are not equal, or that one snapshot alone has."""
    a, b = (spark.read.parquet(f"{p}/digests") for p in (old, new))
    same = a.join(b, ["part", "rows", "sum1", "sum2"]).select("part")
    return sorted(r.part for r in a.select("part").union(b.select("part")).distinct().join(same, "part", "left_anti").collect())


def read_parts(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    """The rows of some parts of a snapshot; folders of others are not opened."""
    rows = _data(spark, path)
    if len(parts) <= MOST_LISTED:
        return rows.where(F.col("part").isin(parts)).drop("part")
    listed = F.broadcast(spark.createDataFrame([(p,) for p in parts], "part int"))
    return rows.join(listed, "part", "left_semi").drop("part")


def difference(spark: SparkSession, old: str, new: str, keys: list[str]) -> DataFrame:
    """``keys..., change``: ``insert``, ``delete`` or ``change`` of each key whose rows are not the same in both snapshots.

    Rows of a key count as often as they are repeated; a key of which rows only came is an
    insert, one of which rows only went a delete. Nulls are values, in keys too. A hash of
    a part that is equal by chance is one in 2^128 or so.
    """
    parts = parts_that_differ(spark, old, new)
    side = lambda p, n: read_parts(spark, p, parts).withColumn("__n", F.lit(n))
    both = side(old, -1).unionByName(side(new, 1))
    columns = [c for c in both.columns if c != "__n"]
    net = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where(F.col("__n") != 0)
    came, went = F.bool_or(F.col("__n") > 0), F.bool_or(F.col("__n") < 0)
    return net.groupBy(*keys).agg(F.when(came & went, "change").when(came, "insert").otherwise("delete").alias("change"))

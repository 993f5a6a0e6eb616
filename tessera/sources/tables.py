"""Tables as Parquet folders or files below one root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below root; any path that Spark's readers can open."""
    return spark.read.parquet(f"{root}/{name}.parquet")

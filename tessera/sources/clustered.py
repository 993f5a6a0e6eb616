"""Tables whose files hold near values of several columns, and readers that skip the other files."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.band import cell_of, depth_edges

#: Bits of a column in the order of the files: cells hold about as many rows each.
BITS = 8


def on_curve(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with ``__curve``, where a row lies on a curve that fills the space of the columns' cells: their bits in turn, the highest first. A null lies in the first cell."""
    names = {f"__cell{k}": F.coalesce(cell_of(F.col(c), depth_edges(df.select(c), 1 << BITS), df.schema[c].dataType.simpleString()), F.lit(0)) for k, c in enumerate(columns)}
    out = F.lit(0).cast("bigint")
    for bit in range(BITS - 1, -1, -1):
        for name in names:
            out = out * 2 + F.shiftright(name, bit).bitwiseAND(F.lit(1))
    return df.withColumns(names).withColumn("__curve", out).drop(*names)


def write_clustered(df: DataFrame, path: str, columns: list[str], rows_per_file: int = 1_000_000) -> None:
    """Write df to a new folder in files of about so many rows, near in all of the columns, and the bounds of each file.

    Columns are numbers or dates. Rows are dealt out by ranges of the curve and then of the
    columns, so values that many rows share fill several files. An empty table has no files.
    """
    files = max(1, math.ceil(df.count() / rows_per_file))
    placed = on_curve(df, columns)
    order = ["__curve", *columns]
    placed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("__curve").write.parquet(f"{path}/data")
    data = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    bounds = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))]
    data.groupBy(F.col("_metadata.file_path").alias("file")).agg(*bounds, F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{path}/bounds")


def files_within(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> list[str]:
    """Files of a clustered table that may hold rows within the ranges, by their bounds."""
    bounds = spark.read.parquet(f"{path}/bounds")
    keep = [F.col(f"most_{c}") >= F.lit(lo) for c, (lo, _) in ranges.items() if lo is not None] + [F.col(f"least_{c}") <= F.lit(hi) for c, (_, hi) in ranges.items() if hi is not None]
    return sorted(r.file for r in reduce(DataFrame.where, keep, bounds).select("file").collect())


def read_clustered(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie within ``{column: (least, most)}``, bounds included; None leaves a side open.

    Only files whose bounds meet all ranges are opened; what of them is read, Parquet's own
    statistics narrow further. Rows with a null in such a column are in no range. Columns
    are those that the table was written by.
    """
    whole = spark.read.parquet(f"{path}/data")
    files = files_within(spark, path, ranges)
    rows = spark.read.schema(whole.schema).parquet(*files) if files else spark.createDataFrame([], whole.schema)
    for c, (lo, hi) in ranges.items():
        rows = rows.where(F.col(c).isNotNull())
        rows = rows if lo is None else rows.where(F.col(c) >= F.lit(lo))
        rows = rows if hi is None else rows.where(F.col(c) <= F.lit(hi))
    return rows

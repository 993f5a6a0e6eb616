"""Windowed counts over a stream with event time."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import delete


def tumbling_counts(stream: DataFrame, *, on: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``window_start, key, n``: rows of each window.

    Works on a streaming or a batch table. In append mode, rows later than ``late`` are left
    out and state is one row for each key and open window; in complete mode every row counts
    and every window stays in the state. Rows with a null time are in no window, a null key
    is a key; repeated rows count each.
    """
    rows = stream.select(F.col(on).cast("timestamp").alias("ts"), F.col(by).alias("key")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "key").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "key", "n")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run what is available of a stream into a new Parquet table below folder, and read it.

    ``append`` writes windows as they close, ``complete`` all windows after each batch, each
    time into a folder of its own; what is read is the last, and those before it are deleted.
    The rest goes when the driver ends, with the state.
    """
    path = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    spark: SparkSession = stream.sparkSession
    atexit.register(delete, spark, path)
    out, last = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True), ["out"]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        if last[0] != str(number):
            delete(spark, f"{path}/{last[0]}")
        last[0] = str(number)

    query = (out.format("parquet").option("path", f"{path}/out") if mode == "append" else out.foreachBatch(put)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}") if mode == "append" or last[0] != "out" else spark.createDataFrame([], stream.schema)

"""Intermediate tables of an operator in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shared import shared_dir


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system of the session, if it is there and the session lives."""
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables that cut lineage: written below spark.checkpoint.dir, they outlive lost executors.

    ``drop`` deletes those that nothing reads any more, the others go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(delete, spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self._paths)}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if found := self._paths.pop(id(df), None):
                delete(self.spark, found[1])

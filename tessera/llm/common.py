"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: A word is a run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows with whole texts in an Arrow batch, at most.
BATCH_ROWS = 1000
#: Bytes of a table, as JSON, up to which it is broadcast.
MOST_BROADCAST = 64 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    They outlive a lost executor. ``drop`` deletes those that nothing reads any more;
    the others go when the driver ends, because the caller's result may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        atexit.register(_delete, spark, self.root)

    def path(self, name: str = "t") -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str = "t", arrow_rows: int | None = None) -> DataFrame:
        """Write df and read it back. arrow_rows: rows in an Arrow batch meanwhile, where rows are large."""
        path, conf = self.path(name), "spark.sql.execution.arrow.maxRecordsPerBatch"
        usual = self.spark.conf.get(conf)
        try:
            if arrow_rows:
                self.spark.conf.set(conf, arrow_rows)
            df.write.parquet(path)
        finally:
            self.spark.conf.set(conf, usual)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._keep = getattr(self, "_keep", []) + [out]
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := self._paths.pop(id(df), None):
                _delete(self.spark, path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after a session with the usual 10,000 rows in an Arrow batch has been set to BATCH_ROWS.

    A batch is whole in the memory of the executor and of its Python worker, and rows hold
    whole texts. A session that asks for fewer rows keeps its number.
    """
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(conf)) <= BATCH_ROWS:
        df.sparkSession.conf.set(conf, BATCH_ROWS)
    return df


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def word_count(c: Column) -> Column:
    """Words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def small(df: DataFrame, most: int, most_bytes: int = MOST_BROADCAST) -> bool:
    """Whether df has at most so many rows, which written as JSON have at most so many bytes. One distributed pass; df is a written table or derived from one."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return size.rows <= most and size.bytes <= most_bytes


def maybe_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it is small; else Spark shuffles both sides."""
    return F.broadcast(df) if small(df, most) else df

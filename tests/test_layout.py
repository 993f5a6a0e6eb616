"""Clustered tables and differences of snapshots: what is returned, and which files are opened."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.sources.clustered import files_within, read_clustered, write_clustered
from tessera.sources.snapshots import difference, parts_that_differ, read_parts, write_snapshot

D = date(2024, 1, 1)


def test_few_files_are_read_on_two_columns(spark, tmp_path):
    """A third of the rows share a value; nulls lie in no range."""
    r = random.Random(1)
    rows = [(k, 500 if r.random() < 0.33 else r.randrange(1000), D + timedelta(days=r.randrange(1000)), None) for k in range(6000)] + [(-1, None, D, None), (-2, 5, None, None)]
    df = spark.createDataFrame(rows, "k int, a int, d date, __x int")
    path = f"file://{tmp_path}/t"
    write_clustered(df, path, ["a", "d"], rows_per_file=100)
    every = files_within(spark, path, {})
    assert 50 <= len(every) <= 61 and spark.read.parquet(f"{path}/data").count() == len(rows)
    for ranges, most in [({"a": (100, 200), "d": (D, D + timedelta(days=100))}, 8), ({"a": (100, 150)}, 20), ({"d": (D + timedelta(days=990), None)}, 20), ({"a": (500, 500), "d": (D, D + timedelta(days=50))}, 12), ({"a": (2000, None)}, 0), ({}, 61)]:
        got = read_clustered(spark, path, ranges)
        inside = lambda v, b: v is not None and (b[0] is None or v >= b[0]) and (b[1] is None or v <= b[1])
        assert sorted(x.k for x in got.collect()) == sorted(k for k, a, d, _ in rows if all(inside({"a": a, "d": d}[c], b) for c, b in ranges.items()))
        files = files_within(spark, path, ranges)
        assert len(files) <= most and {x.f for x in got.select(F.col("_metadata.file_path").alias("f")).distinct().collect()} <= set(files) if files else not most


def test_clustered_edges(spark, tmp_path):
    df = spark.createDataFrame([(None, None)] * 3, "a int, b double")
    write_clustered(df, f"file://{tmp_path}/nulls", ["a", "b"])
    assert read_clustered(spark, f"file://{tmp_path}/nulls", {}).count() == 3
    assert read_clustered(spark, f"file://{tmp_path}/nulls", {"a": (None, 5)}).count() == 0
    write_clustered(df.limit(0), f"file://{tmp_path}/none", ["a", "b"])
    assert read_clustered(spark, f"file://{tmp_path}/none", {"a": (1, 2)}).count() == 0


KIND = "k int, g string, v double, part_ int"


def plain_difference(old, new):
    a, b = Counter(old), Counter(new)
    came, went = {r[:2] for r in b - a}, {r[:2] for r in a - b}
    return sorted(((*k, "change" if k in came and k in went else "insert" if k in came else "delete") for k in came | went), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_differences_equal_counted_rows(spark, tmp_path, seed):
    r = random.Random(seed)
    old = [(r.choice([None, *range(60)]), r.choice(["a", None]), r.choice([None, 1.0, 2.0]), r.choice([None, 7])) for _ in range(200)]
    new = [x for x in old if r.random() < 0.95] + [(r.choice([None, *range(80)]), "a", 1.0, None) for _ in range(6)] + [(3, None, None, 7), (3, None, 7.0, None)]
    for name, rows in (("old", old), ("new", new)):
        write_snapshot(spark.createDataFrame(rows, KIND).repartition(3), f"file://{tmp_path}/{name}", ["k", "g"], parts=16)
    got = difference(spark, f"file://{tmp_path}/old", f"file://{tmp_path}/new", ["k", "g"])
    assert sorted(map(tuple, got.collect()), key=str) == plain_difference(old, new)


def test_only_parts_that_differ_are_read(spark, tmp_path):
    rows = [(k, "g", float(k), k % 9) for k in range(4000)]
    changed = [(k, g, v + (k in (5, 77)), p) for k, g, v, p in rows if k != 1234]
    for name, x in (("old", rows), ("new", changed), ("same", rows[::-1])):
        write_snapshot(spark.createDataFrame(x, KIND), f"file://{tmp_path}/{name}", ["k"], parts=64)
    old, new, same = (f"file://{tmp_path}/{name}" for name in ("old", "new", "same"))
    parts = parts_that_differ(spark, old, new)
    assert 1 <= len(parts) <= 3 and parts_that_differ(spark, old, same) == []
    size = lambda df: df.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    assert size(read_parts(spark, new, parts)) * 10 < size(spark.read.parquet(f"{new}/data"))
    assert sorted(map(tuple, difference(spark, old, new, ["k"]).collect())) == [(5, "change"), (77, "change"), (1234, "delete")]
    assert difference(spark, old, same, ["k"]).count() == 0
    write_snapshot(spark.createDataFrame([], KIND), f"file://{tmp_path}/none", ["k"], parts=64)
    assert difference(spark, f"file://{tmp_path}/none", old, ["k"]).where("change = 'insert'").count() == 4000

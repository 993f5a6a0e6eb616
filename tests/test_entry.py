"""The entry point, and the general queries against DuckDB."""

import shutil
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera.operators.temporal import asof_join, interval_join, micros, sessions
from tessera.plans import analytics, relational
from tessera.streaming.windows import run_to_table, tumbling_counts

QUERIES, ORACLE = relational.QUERIES | analytics.QUERIES, relational.ORACLE | analytics.ORACLE
SF, REPO = "/root/testdata/sf0.001", Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(ORACLE[name])
    cols = sorted(d[0] for d in want.description)
    want = sorted(str([r[[d[0] for d in want.description].index(c)] for c in cols]) for r in want.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert want and sorted(str(list(r)) for r in got.select(*cols).collect()) == want


def test_stream_leaves_out_late_rows_and_open_windows(spark, tmp_path):
    """Append mode: a row that comes later than allowed is in no window; complete mode counts it, and the open window."""
    day = lambda d, h, kind: (datetime(2024, 1, d, h), kind)
    for k, rows in enumerate([[day(1, 1, "a"), day(1, 23, None)], [day(3, 5, "a")], [day(3, 6, "a"), (None, "a")], [day(1, 2, "a")], [day(5, 0, "b")]]):
        spark.createDataFrame(rows, "ts timestamp_ntz, kind string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run(mode):
        rows = spark.readStream.schema("ts timestamp_ntz, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return {(r.window_start.day, r.key): r.n for r in run_to_table(tumbling_counts(rows, on="ts", by="kind"), f"file://{tmp_path}", mode).collect()}

    assert run("append") == {(1, "a"): 1, (1, None): 1, (3, "a"): 2}
    assert run("complete") == {(1, "a"): 2, (1, None): 1, (3, "a"): 2, (5, "b"): 1}


def test_times_without_zone_do_not_depend_on_the_session(spark):
    rows = spark.createDataFrame([(datetime(2024, 3, 31, h, 30, 0, 7),) for h in range(6)] + [(datetime(1969, 12, 31, 23, 59, 59, 999_999),)], "ts timestamp_ntz")
    want = [1_711_845_000_000_007 + h * 3_600_000_000 for h in range(6)] + [-1]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert [r[0] for r in rows.select(micros(rows, "ts")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


T = datetime(2024, 1, 1)


def _timed(spark, rows, value):
    return spark.createDataFrame([(k, None if h is None else T + timedelta(hours=h), v) for k, h, v in rows], f"k string, ts timestamp_ntz, {value} int")


def test_asof_edges(spark):
    left = _timed(spark, [("a", 1, 0), ("a", 50, 1), ("a", 50, 1), ("b", 3, 2), (None, 5, 3), ("a", None, 4), ("c", 1, 5)], "row")
    right = _timed(spark, [("a", 1, 7), ("a", 1, 9), ("a", 2, None), ("b", 4, 1), (None, 1, 1), ("a", None, 1)], "hit")
    got = sorted(((r.row, r.hit) for r in asof_join(left, right, by="k", on="ts", values=["hit"]).collect()), key=str)
    assert got == [(0, 9), (1, None), (1, None), (2, None), (3, None), (4, None), (5, None)]
    right = _timed(spark, [("a", 1, 7)], "hit")
    assert sorted(r.hit for r in asof_join(left, right, by="k", on="ts", values=["hit"]).where("k = 'a' and ts is not null").collect()) == [7, 7, 7]
    assert asof_join(left, right.limit(0), by="k", on="ts", values=["hit"]).where("hit is not null").count() == 0
    assert asof_join(left.limit(0), right, by="k", on="ts", values=["hit"]).count() == 0


def test_session_edges(spark):
    rows = _timed(spark, [("a", h, 0) for h in (0, 5, 11, 11, 23, 25, 60)] + [(None, 1, 0), ("b", None, 0)], "n")
    got = sorted((r.key, r.session, r.n) for r in sessions(rows, by="k", on="ts", gap_seconds=6 * 3600).collect())
    assert got == [("a", 0, 4), ("a", 1, 2), ("a", 2, 1)]
    assert sessions(rows.limit(0), by="k", on="ts", gap_seconds=1).count() == 0


def test_intervals_of_very_different_lengths(spark):
    spans = spark.createDataFrame([("a", T + timedelta(hours=h), T + timedelta(hours=h, seconds=n), i) for i, (h, n) in enumerate([(0, 1), (1, 64), (2, 65), (3, 4096), (-9, 10**6), (-10**5, 10**9)])], "k string, a timestamp_ntz, z timestamp_ntz, s int")
    points = spark.createDataFrame([("a", T + timedelta(minutes=m), m) for m in range(0, 300, 7)], "k string, ts timestamp_ntz, p int")
    got = sorted((r.point.p, r.span.s) for r in interval_join(points, spans, by="k", on="ts", start="a", end="z", width_seconds=1).collect())
    rows = spans.collect()
    assert got == sorted((r.p, x.s) for r in points.collect() for x in rows if x.a <= r.ts < x.z)


def test_interval_edges(spark):
    spans = spark.createDataFrame([("a", T, T + timedelta(hours=50), 1), ("a", T, T, 2), ("a", None, T, 3), (None, T, T + timedelta(hours=9), 4)], "k string, a timestamp_ntz, z timestamp_ntz, s int")
    points = _timed(spark, [("a", 0, 1), ("a", 49, 2), ("a", 50, 3), (None, 1, 4), ("a", None, 5)], "p")
    got = interval_join(points, spans, by="k", on="ts", start="a", end="z", width_seconds=3600)
    assert sorted((r.point.p, r.span.s) for r in got.collect()) == [(1, 1), (2, 1)]


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_runs_without_the_subpackage(tmp_path):
    """With the subpackage and its tests gone and the pipeline's file left, as with all of them gone."""
    for name, gone in (("left", ("llm",)), ("gone", ("llm", "corpus_pipeline.py"))):
        shutil.copytree(REPO, tmp_path / name, ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / name, capture_output=True, text=True, timeout=120)
        assert run.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))], run.stderr
    tests = [sys.executable, "-m", "pytest", "tests", "-q", "-x", "-k", "asof or entry_runs"]
    run = subprocess.run(tests, cwd=tmp_path / "left", capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "2 passed" in run.stdout, run.stdout

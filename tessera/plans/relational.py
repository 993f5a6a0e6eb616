"""Registered queries over the star schema and the events, and the same in DuckDB's SQL.

They stand for the general categories of a query engine (filters, joins, aggregates,
windows, set operations, time); they claim no counterpart elsewhere. Nulls, ties and
repeated rows are as in SQL: a null meets no join key, is a group of its own and is left
out of sums; repeated rows count each; ties are ordered by a key or, in ranks, all kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.money import fraction, money, total
from ..operators.temporal import asof_join, interval_join, sessions
from ..sources.shared import shared_dir
from ..sources.tables import table
from ..streaming.windows import run_to_table, tumbling_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
_revenue = lambda: money("l_extendedprice") * (1 - fraction("l_discount"))


@_query(f"""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS sum_qty, CAST(sum({_REVENUE}) AS DECIMAL(18,4)) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY l_returnflag, l_linestatus""")
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(total(money("l_quantity")).alias("sum_qty"), total(_revenue(), 4).alias("revenue"), F.count(F.lit(1)).alias("n"))


@_query(f"""
SELECT n_name, CAST(sum({_REVENUE}) AS DECIMAL(18,4)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "n_name")
    lines = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return joined.groupBy("n_name").agg(total(_revenue(), 4).alias("revenue"))


@_query("SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-100 report."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", money("o_totalprice").alias("price"))


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def idle_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@_query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def status_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("g"), F.count(F.lit(1)).alias("n"))


@_query("""
SELECT * FROM (SELECT c_mktsegment, c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY CAST(c_acctbal AS DECIMAL(12,2)) DESC) AS INTEGER) AS rk FROM customer) WHERE rk <= 10""")
def segment_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest balances of each segment, ties included; Spark keeps ten ranks of a task before the shuffle."""
    rank = F.rank().over(W.partitionBy("c_mktsegment").orderBy(money("c_acctbal").desc()))
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", rank.alias("rk")).where("rk <= 10")


@_query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def nations_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
    return a.subtract(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_nationkey"))


@_query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total FROM events GROUP BY ALL")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return table(spark, sf_dir, "events").groupBy("event_type", k).agg(F.count(F.lit(1)).alias("n"), total(money("value")).alias("total"))


@_query("""
WITH f AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM s GROUP BY user_id, session""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), by="user_id", on="ts", gap_seconds=6 * 3600).withColumnRenamed("key", "user_id")


@_query("""
SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof_join(bought, seen, by="user_id", on="ts", values=["view_id"]).drop("ts")


@_query("""
SELECT s.event_id AS signup_id, e.event_id FROM events s JOIN events e ON s.user_id = e.user_id AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 1 DAY WHERE s.event_type = 'signup'""")
def after_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    spans = events.where("event_type = 'signup'").select("user_id", "event_id", "ts", (F.col("ts") + F.expr("interval 1 day")).alias("until"))
    pairs = interval_join(events, spans, by="user_id", on="ts", start="ts", end="until", width_seconds=86_400)
    return pairs.select(F.col("span.event_id").alias("signup_id"), F.col("point.event_id").alias("event_id"))


@_query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type AS key, count(*) AS n FROM events GROUP BY ALL")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the events as a stream, in complete mode: the last, open window too."""
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).format("parquet").load(f"{sf_dir}/events*.parquet")
    counts = run_to_table(tumbling_counts(rows, on="ts", by="event_type"), shared_dir(spark), "complete")
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "key", "n")

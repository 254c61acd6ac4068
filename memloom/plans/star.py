"""Relational coverage over the star schema and the event stream as a batch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_SQL = {
    "star_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "star_rollup_cube": """SELECT coalesce(r_name, 'all') AS region, coalesce(c_mktsegment, 'all') AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)""",
    "star_rank_window": """SELECT * FROM (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS d,
        ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS quarter FROM customer) AS t WHERE r <= 3""",
    "star_semi_anti": """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    "star_set_ops": """SELECT n_nationkey, 'customers only' AS side FROM (SELECT c_nationkey AS n_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) AS a
        UNION ALL SELECT n_nationkey, 'both' FROM (SELECT c_nationkey AS n_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) AS b""",
    "star_correlated_subquery": """SELECT p_brand, count(*) AS dear FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand) GROUP BY p_brand""",
    "star_join_chain": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE c_nationkey = s_nationkey GROUP BY n_name""",
    "star_running_frame": """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders""",
    "star_pivot": """SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY o_orderpriority""",
}


def _query(sql: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The tables by name, without views that would outlive the query.
        args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if t in sql}
        text = sql
        for t in args:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return spark.sql(text, **args)

    return query


def event_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def event_asof_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the latest click of the user before it: an as-of join by one sorted window per user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type in ('click', 'purchase')")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return e.filter("event_type = 'purchase'").select("event_id", "click")


QUERIES = {**{n: _query(s) for n, s in _SQL.items()}, "event_tumbling_window": event_tumbling_window, "event_session_window": event_session_window, "event_asof_previous": event_asof_previous}
ORACLES = {
    **_SQL,
    "event_tumbling_window": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "event_session_window": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "event_asof_previous": """WITH e AS (SELECT *, max(CASE WHEN event_type = 'click' THEN (ts, event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events)
        SELECT event_id, c[2] AS click FROM e WHERE event_type = 'purchase'""",
}

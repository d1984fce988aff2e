"""Reconciliation, audit, freshness and run-time budgets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import quality
from tidewell.operators.merge import dedup_latest
from tidewell.plans.queries.book import query, table
from tidewell.plans.queries.loading import ITEM_KEY, ITEM_ORDER


@query("""
    SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows,
        (SELECT count(*) FROM orders) AS target_rows, true AS ok
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer),
        (SELECT count(DISTINCT user_id) FROM events), 
        (SELECT count(*) FROM customer) = (SELECT count(DISTINCT user_id) FROM events)
    UNION ALL SELECT 'lineitem', n, d, n = d FROM (SELECT count(*) AS n,
        count(DISTINCT (l_orderkey, l_linenumber)) AS d FROM lineitem)
    UNION ALL SELECT 'part', count(*), NULL, false FROM part
""")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders match, line items lost their repeated keys, parts never arrived."""
    source = {t: table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "part")}
    target = {
        "orders": source["orders"],
        "customer": table(spark, sf_dir, "events").select("user_id").distinct(),
        "lineitem": source["lineitem"].select(*ITEM_KEY).distinct(),
    }
    return quality.reconcile_counts(source, target)


@query("""
    SELECT (SELECT count(*) FROM lineitem)
        = (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS ok
""")
def reconcile_same_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return quality.reconcile_same_engine(spark, items, dedup_latest(items, ITEM_KEY, ITEM_ORDER))


@query("""
    SELECT event_type, CAST(ts AS DATE) AS load_date, count(*) AS n_rows,
        count(*) FILTER (user_id IS NULL) AS null_keys, count(*) FILTER (ts IS NULL) AS null_cursors,
        CAST(min(ts) AS VARCHAR) AS min_cursor, CAST(max(ts) AS VARCHAR) AS max_cursor
    FROM events GROUP BY ALL
""")
def load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's events of a type as one load."""
    events = table(spark, sf_dir, "events").withColumn("load_date", F.col("ts").cast("date"))
    return quality.load_audit(events, ["event_type", "load_date"], "ts", ["user_id"])


@query("""
    SELECT c_custkey AS component, coalesce(CAST(max(ts) AS VARCHAR), 'never') AS last_seen
    FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey
    HAVING max(ts) IS NULL OR TIMESTAMP '2024-01-31' - max(ts) > INTERVAL 12 HOUR
""")
def heartbeat_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an event for 12 hours, or without any."""
    components = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("component"))
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("component"), "ts")
    return quality.stale_components(components, beats, datetime(2024, 1, 31), 12 * 3600)


@query("""
    SELECT user_id AS pipeline, string_agg(event_type, ', ' ORDER BY event_type) AS tasks
    FROM (SELECT DISTINCT user_id, event_type FROM events
          WHERE to_microseconds(CAST(round(value * 60000000) AS BIGINT)) > INTERVAL 60 MINUTE)
    GROUP BY 1
""")
def sla_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as task runs of ``value`` minutes; an hour is allowed."""
    micros = F.round(F.col("value") * 60_000_000).cast("bigint")
    finished = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + micros)
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pipeline"), F.col("event_type").alias("task"),
        F.col("ts").alias("started_at"), finished.alias("finished_at"),
    )
    return quality.sla_misses(runs, 60)

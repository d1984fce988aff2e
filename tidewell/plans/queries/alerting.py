"""Alert routing, rows and suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalars import route
from tidewell.operators.alerts import alert_rows, suppress_alerts
from tidewell.plans.queries.book import query, table
from tidewell.session import ROCKSDB_PROVIDER, new_scratch
from tidewell.streaming.alert_stream import suppress_stream

CHANNELS = {"P1": "#oncall", "P2": "#data"}


def _walk(keys: str, minutes: int) -> str:
    """The suppression rule as a recursive walk from one sent alert to the next."""
    on = " AND ".join(f"e.{k} = w.{k}" for k in keys.split(", "))
    return f"""
        WITH RECURSIVE walk AS (
            SELECT {keys}, min(ts) AS ts FROM events GROUP BY ALL
            UNION ALL
            SELECT {", ".join(f"w.{k}" for k in keys.split(", "))}, min(e.ts)
            FROM walk w JOIN events e ON {on} AND e.ts >= w.ts + INTERVAL {minutes} MINUTE
            GROUP BY ALL),
        sent AS (
            SELECT min(e.event_id) AS event_id FROM walk w
            JOIN events e ON {on} AND e.ts = w.ts GROUP BY {", ".join(f"w.{k}" for k in keys.split(", "))}, w.ts)
        SELECT event_id, ts, {keys}, event_id NOT IN (SELECT event_id FROM sent) AS deduped FROM events
    """


@query(_walk("user_id, event_type", 15))
def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type"]
    alerts = table(spark, sf_dir, "events").select("event_id", "ts", *keys)
    return suppress_alerts(alerts, keys, "ts", "event_id", 15)


@query(_walk("event_type", 180))
def alert_dedup_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keys share all alerts, so every key is cut into several ranges."""
    alerts = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return suppress_alerts(alerts, ["event_type"], "ts", "event_id", 180, parts=32)


@query(_walk("event_type", 4320))
def alert_dedup_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keys in ranges that are shorter than the window, so that a range's table holds an entry
    for many of its alerts; more ranges than one block takes."""
    alerts = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return suppress_alerts(alerts, ["event_type"], "ts", "event_id", 4320, parts=96)


@query(_walk("user_id, event_type", 15))
def alert_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule with keyed state, over alerts that come in three parts in time order. A part is
    written by as many tasks as read it, and is one micro-batch: the stream goes on from its
    checkpoint with what came since."""
    scratch = new_scratch(spark, "alert-stream")
    keys = ["user_id", "event_type"]
    events = table(spark, sf_dir, "events").select("event_id", "ts", *keys)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    bounds = [None, "2024-01-11", "2024-01-21", None]
    for lower, upper in zip(bounds, bounds[1:]):
        part = events
        if lower:
            part = part.filter(F.col("ts") >= F.lit(lower).cast("timestamp_ntz"))
        if upper:
            part = part.filter(F.col("ts") < F.lit(upper).cast("timestamp_ntz"))
        part.write.mode("append").parquet(f"{scratch}/alerts")
        stream = spark.readStream.schema(events.schema).parquet(f"{scratch}/alerts")
        flagged = suppress_stream(stream, keys, "ts", "event_id", 15)
        (
            flagged.writeStream.format("parquet").option("path", f"{scratch}/out")
            .option("checkpointLocation", f"{scratch}/checkpoint").trigger(availableNow=True)
            .start().awaitTermination()
        )
    return spark.read.schema(flagged.schema).parquet(f"{scratch}/out")


def _severity() -> Column:
    return (
        F.when(F.col("event_type") == "error", "P1").when(F.col("event_type") == "view", "info")
        .otherwise("P2")
    )


_ROUTED = """
    SELECT *, CASE event_type WHEN 'error' THEN 'P1' WHEN 'view' THEN 'info' ELSE 'P2' END AS severity,
        CASE WHEN value > 400 THEN '#team' || user_id WHEN value > 300 THEN '' END AS override
    FROM events
"""


@query(f"""
    SELECT event_id, severity, coalesce(nullif(override, ''),
        CASE severity WHEN 'P1' THEN '#oncall' WHEN 'P2' THEN '#data' END) AS channel
    FROM ({_ROUTED})
""")  # fmt: skip
def alert_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", _severity().alias("severity"), route(_override(), _severity(), CHANNELS).alias("channel")
    )


def _override() -> Column:
    return (
        F.when(F.col("value") > 400, F.concat(F.lit("#team"), "user_id"))
        .when(F.col("value") > 300, F.lit(""))
    )


_KIND = "CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'schema' WHEN 'view' THEN 'heartbeat' ELSE 'sla' END"


@query(f"""
    SELECT *, '{{' || coalesce('"channel":"' || channel || '",', '') || '"text":"' || text || '"}}'
        AS payload
    FROM (
        SELECT ts, event_id, pipeline, kind, severity, coalesce(nullif(override, ''),
                CASE severity WHEN 'P1' THEN '#oncall' WHEN 'P2' THEN '#data' END) AS channel,
            CASE kind WHEN 'failure' THEN '[' || severity || '] pipeline `' || pipeline || '` failed'
                WHEN 'schema' THEN '[info] schema evolution in `' || pipeline || '`'
                WHEN 'sla' THEN '[' || severity || '] SLA miss in `' || pipeline || '`'
                ELSE '[' || severity || '] `' || pipeline || '` heartbeat stale' END AS text
        FROM (SELECT ts, event_id, 'p' || user_id AS pipeline, {_KIND} AS kind, override,
                CASE WHEN event_type = 'signup' THEN 'info' ELSE severity END AS severity
              FROM ({_ROUTED})))
""", name="alert_rows")  # fmt: skip
def alert_rows_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "error", "failure")
        .when(F.col("event_type") == "signup", "schema")
        .when(F.col("event_type") == "view", "heartbeat")
        .otherwise("sla")
    )
    events = table(spark, sf_dir, "events").select(
        "ts", "event_id", F.concat(F.lit("p"), "user_id").alias("pipeline"), kind.alias("kind"),
        _severity().alias("severity"), _override().alias("channel_override"),
    )
    return alert_rows(events, CHANNELS)

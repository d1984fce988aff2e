"""Schema contracts and schema-change reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import contracts
from tidewell.plans.queries.book import query, table
from tidewell.session import new_scratch
from tidewell.sinks.dataset import Dataset


def _recent():
    return F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
        CASE WHEN o_orderdate >= DATE '1998-01-01' THEN o_orderpriority END AS o_orderpriority,
        CASE WHEN o_orderdate >= DATE '1998-01-01' THEN o_orderstatus END AS o_orderstatus
    FROM orders
""")
def contract_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows had a narrower customer key and no status or priority."""
    orders = table(spark, sf_dir, "orders")
    old = orders.filter(~_recent()).select(
        "o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_totalprice", "o_orderdate"
    )
    return contracts.contract_evolve(old, orders.filter(_recent()))


@query("""
    SELECT o_orderkey, '[' || o_custkey || ',' || (o_custkey + 1) || ']' AS keys,
        CASE WHEN o_orderdate >= DATE '1998-01-01' THEN o_orderstatus END AS status,
        CAST(CAST(o_custkey / CASE WHEN o_orderdate >= DATE '1998-01-01' THEN 4 ELSE 1 END
             AS DECIMAL(21, 2)) AS VARCHAR) AS amount,
        CASE WHEN o_orderdate >= DATE '1998-01-01' THEN CAST(o_orderkey AS VARCHAR)
             ELSE CAST(9007199254740993 + o_orderkey AS VARCHAR) END AS big
    FROM orders
""")
def contract_evolve_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs gain fields, array elements and decimals widen, and a bigint beside a text keeps
    all its digits."""
    orders = table(spark, sf_dir, "orders")
    old = orders.filter(~_recent()).select(
        "o_orderkey",
        F.struct(
            F.array(F.col("o_custkey").cast("int"), (F.col("o_custkey") + 1).cast("int")).alias("keys"),
            F.col("o_custkey").alias("amount"),
        ).alias("doc"),
        (F.lit(9007199254740993) + F.col("o_orderkey")).alias("big"),
    )
    new = orders.filter(_recent()).select(
        "o_orderkey",
        F.struct(
            F.array("o_custkey", F.col("o_custkey") + 1).alias("keys"),
            (F.col("o_custkey") / 4).cast("decimal(12,2)").alias("amount"),
            F.col("o_orderstatus").alias("status"),
        ).alias("doc"),
        F.col("o_orderkey").cast("string").alias("big"),
    )
    both = contracts.contract_evolve(old, new)
    return both.select(
        "o_orderkey", F.to_json("doc.keys").alias("keys"), "doc.status",
        F.col("doc.amount").cast("string").alias("amount"), "big",
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1998-01-01' THEN o_orderdate + INTERVAL 90 MINUTE
        ELSE date_trunc('day', o_orderdate) END AS moment FROM orders
""")
def contract_evolve_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in old rows, timestamps without a zone in some new ones and with a zone in others."""
    orders = table(spark, sf_dir, "orders")
    later = F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES")
    old = orders.filter(~_recent()).select("o_orderkey", F.col("o_orderdate").cast("date").alias("moment"))
    plain = orders.filter(_recent() & (F.col("o_orderkey") % 2 == 0)).select("o_orderkey", later.alias("moment"))
    zoned = orders.filter(_recent() & (F.col("o_orderkey") % 2 == 1)).select(
        "o_orderkey", F.convert_timezone(F.lit("UTC"), F.current_timezone(), later).cast("timestamp").alias("moment")
    )
    both = contracts.contract_evolve(contracts.contract_evolve(old, plain), zoned)
    return both.withColumn("moment", F.col("moment").cast("timestamp_ntz"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, CAST(NULL AS VARCHAR) AS o_clerk FROM orders")
def contract_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that fits a frozen schema, in that schema's shape; the tests cover refusals."""
    orders = table(spark, sf_dir, "orders")
    frozen = T._parse_datatype_string(
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_clerk string"
    )
    batch = orders.select(
        "o_orderdate", F.col("o_custkey").cast("int").alias("o_custkey"), "o_totalprice", "o_orderkey"
    )
    return contracts.contract_freeze(frozen, batch)


_RANKED = """
    SELECT o_orderkey, o_orderdate, o_orderpriority AS note,
        CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE left(o_orderpriority, 1) END AS rank
    FROM orders
"""


@query(f"""
    SELECT o_orderkey, o_orderdate, CAST(rank AS INTEGER) AS rank FROM (
        SELECT o_orderkey, o_orderdate, TRY_CAST(rank AS INTEGER) AS rank,
            CASE WHEN note = '5-LOW' THEN note END AS unknown FROM ({_RANKED}))
    WHERE rank IS NOT NULL AND unknown IS NULL
""")  # fmt: skip
def contract_discard_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target knows a numeric rank and no note; rows that break either are left out."""
    orders = table(spark, sf_dir, "orders")
    known = T._parse_datatype_string("o_orderkey bigint, o_orderdate timestamp_ntz, rank int")
    priority = F.col("o_orderpriority")
    batch = orders.select(
        "o_orderkey", "o_orderdate",
        F.when(F.col("o_orderstatus") == "P", priority).otherwise(F.left(priority, F.lit(1))).alias("rank"),
        F.when(priority == "5-LOW", priority).alias("note"),
    )
    accepted, _ = contracts.contract_discard_row(known, batch)
    return accepted


@query("""
    SELECT disposition, n_rows, n_rejected FROM (
        SELECT 1 AS i, 'append' AS disposition, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_rejected
        FROM orders UNION ALL
        SELECT 2, 'append', count(*) FILTER (o_orderpriority <> '5-LOW'),
            count(*) FILTER (o_orderpriority = '5-LOW') FROM orders)
""")
def contract_discard_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the target table: the audit row counts what was left out."""
    orders = table(spark, sf_dir, "orders")
    target = Dataset(spark, new_scratch(spark, "discard"), "raw")
    target.load("orders", orders, "append")
    noted = orders.withColumn("note", F.when(F.col("o_orderpriority") == "5-LOW", F.lit("slow")))
    target.load("orders", noted, "append", contract="discard_row")
    return target.loads().select("disposition", "n_rows", "n_rejected")


@query("""
    SELECT DISTINCT event_type AS table_name, 'k' || json_extract_string(props, '$.k') AS column_name
    FROM events e WHERE ts >= TIMESTAMP '2024-01-15' AND NOT EXISTS (
        SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-15' AND o.event_type = e.event_type
            AND json_extract_string(o.props, '$.k') = json_extract_string(e.props, '$.k'))
""")
def schema_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns per table that only the second half of the month brought."""
    columns = table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("table_name"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("column_name"),
    )
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    known = columns.filter(~late).select("table_name", "column_name").distinct()
    batch = columns.filter(late).select("table_name", "column_name").distinct()
    return contracts.schema_new_columns(known, batch)


@query("""
    SELECT DISTINCT event_type AS table_name,
        'u' || user_id || '_' || json_extract_string(props, '$.k') AS column_name
    FROM events e WHERE ts >= TIMESTAMP '2024-01-15' AND NOT EXISTS (
        SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-15' AND o.event_type = e.event_type
            AND o.user_id = e.user_id
            AND json_extract_string(o.props, '$.k') = json_extract_string(e.props, '$.k'))
""")
def schema_new_columns_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a column per user and k, many of which only the second half brought."""
    columns = table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("table_name"),
        F.concat(F.lit("u"), "user_id", F.lit("_"), F.get_json_object("props", "$.k")).alias("column_name"),
    )
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    known = columns.filter(~late).select("table_name", "column_name").distinct()
    batch = columns.filter(late).select("table_name", "column_name").distinct()
    return contracts.schema_new_columns(known, batch)


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a reported schema change; columns come in either order."""
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    value = F.lit("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pipeline"), F.col("event_id").alias("step_no"),
        F.concat(F.lit("step_"), F.dayofmonth("ts").cast("string")).alias("step"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table_name"),
        F.when(F.col("value") > 50, F.array(k, value)).otherwise(F.array(value, k)).alias("new_columns"),
    )


_DEDUPED = """
    SELECT event_type AS pipeline, 't' || (user_id % 3) AS table_name,
        'k' || json_extract_string(props, '$.k') AS k, min(event_id) AS step_no,
        'step_' || day(arg_min(ts, event_id)) AS step
    FROM events GROUP BY 1, 2, 3
"""


@query(f"SELECT pipeline, table_name, k || ',value' AS new_columns, step_no, step FROM ({_DEDUPED})")
def schema_update_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = contracts.schema_update_dedup(_updates(spark, sf_dir))
    return deduped.withColumn("new_columns", F.array_join("new_columns", ","))


@query(f"""
    WITH lines AS (
        SELECT pipeline, row_number() OVER (PARTITION BY pipeline ORDER BY step_no) AS rank,
            count(*) OVER (PARTITION BY pipeline) AS n_updates,
            '{{"new_columns": ["' || k || '", "value"], "step": "' || step || '", "table": "'
                || table_name || '"}}' AS line
        FROM ({_DEDUPED}))
    SELECT pipeline, max(n_updates) AS n_updates,
        string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 20)
            || CASE WHEN max(n_updates) > 20
               THEN chr(10) || '… (+' || (max(n_updates) - 20) || ' more)' ELSE '' END AS summary
    FROM lines GROUP BY pipeline
""")  # fmt: skip
def schema_update_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.schema_update_report(contracts.schema_update_dedup(_updates(spark, sf_dir)))

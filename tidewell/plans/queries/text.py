"""Masking, checks and renderings of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import durations, scalars, scrub
from tidewell.plans.queries.book import query, table

_SPACE = scrub.SPACE
_KEY_VALUE = scrub.KEY_VALUE.removeprefix("(?i)").replace("'", "''")
_URI = scrub.URI_USERINFO.removeprefix("(?i)").replace("'", "''")


@query(rf"SELECT doc_id, regexp_replace(text, '{_KEY_VALUE}', '\1=***', 'gi') AS text FROM documents")
def scrub_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", scrub.scrub_key_values(F.col("text")).alias("text"))


_CONNECTIONS = """
    SELECT c_custkey, 'dial ' || CASE c_nationkey % 5 WHEN 0 THEN 'postgresql+psycopg2'
        WHEN 1 THEN 'MySQL+pymysql' WHEN 2 THEN 'snowflake' WHEN 3 THEN 'https' ELSE 'mssql' END
        || '://' || c_mktsegment || ':pw' || c_custkey || '@db' || c_nationkey
        || '.example.com/x?password = ' || c_custkey || '&user=' || c_name AS message
    FROM customer
"""


@query(rf"""
    SELECT c_custkey, regexp_replace(message, '{_URI}', '\1://\2:***@', 'gi') AS uris,
        regexp_replace(regexp_replace(message, '{_KEY_VALUE}', '\1=***', 'gi'),
            '{_URI}', '\1://\2:***@', 'gi') AS scrubbed
    FROM ({_CONNECTIONS})
""")  # fmt: skip
def scrub_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection strings built from customers; web addresses stay as they are."""
    scheme = F.element_at(
        F.array(*[F.lit(s) for s in ("postgresql+psycopg2", "MySQL+pymysql", "snowflake", "https", "mssql")]),
        F.col("c_nationkey") % 5 + 1,
    )
    message = F.concat(
        F.lit("dial "), scheme, F.lit("://"), "c_mktsegment", F.lit(":pw"), "c_custkey",
        F.lit("@db"), "c_nationkey", F.lit(".example.com/x?password = "), "c_custkey",
        F.lit("&user="), "c_name",
    )
    messages = table(spark, sf_dir, "customer").select("c_custkey", message.alias("message"))
    return messages.select(
        "c_custkey", scrub.scrub_uris(F.col("message")).alias("uris"),
        scrub.scrub(F.col("message")).alias("scrubbed"),
    )


@query("""
    SELECT c_custkey, c_name, regexp_matches(c_name, '^[a-z][a-z0-9_]*$') AS name_ok,
        regexp_matches(lower(c_mktsegment), '^[a-z][a-z0-9_]*$') AS segment_ok,
        regexp_replace(lower(c_name), '[^a-z0-9_]+', '_', 'g') AS normalized,
        c_custkey % 5 = 0 AS proposal_ok
    FROM customer
""")
def identifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are, and proposals of which every fifth is an identifier."""
    key = F.col("c_custkey").cast("string")
    proposal = F.element_at(
        F.array(
            F.concat(F.lit("c_"), key), F.concat(key, F.lit("_c")), F.concat(F.lit("c-"), key),
            F.concat(F.lit("c"), key, F.lit("\n")), F.concat(F.lit("_"), key),
        ),
        (F.col("c_custkey") % 5 + 1).cast("int"),
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", scalars.is_identifier(F.col("c_name")).alias("name_ok"),
        scalars.is_identifier(F.lower("c_mktsegment")).alias("segment_ok"),
        scalars.normalize_identifier(F.col("c_name")).alias("normalized"),
        scalars.is_identifier(proposal).alias("proposal_ok"),
    )


@query("""
    SELECT o_orderkey, duration, CAST(month(o_orderdate) AS BIGINT) AS months,
        CAST(day(o_orderdate) * 86400 + o_custkey * 60 AS DOUBLE) AS seconds
    FROM (SELECT *, 'P' || month(o_orderdate) || 'M' || day(o_orderdate) || 'DT' || o_custkey || 'M'
        AS duration FROM orders)
    UNION ALL SELECT o_orderkey, o_orderpriority, NULL, NULL FROM orders
""")
def iso_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations built from orders, and priorities, which are none."""
    orders = table(spark, sf_dir, "orders")
    built = F.concat(
        F.lit("P"), F.month("o_orderdate"), F.lit("M"), F.dayofmonth("o_orderdate"), F.lit("DT"),
        "o_custkey", F.lit("M"),
    )
    texts = orders.select("o_orderkey", F.explode(F.array(built, "o_orderpriority")).alias("duration"))
    return texts.select(
        "o_orderkey", "duration", durations.duration_months(F.col("duration")).alias("months"),
        durations.duration_seconds(F.col("duration")).alias("seconds"),
    )


@query("""
    SELECT event_id, CASE WHEN user_id % 2 = 0 THEN ts - INTERVAL 2 HOUR END AS instant
    FROM events
""")
def ts_tz_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps of even users name a zone and are taken as instants; naive ones are refused."""
    text = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zoned = F.when(F.col("user_id") % 2 == 0, F.concat(text, F.lit("+02:00"))).otherwise(text)
    instant = scalars.zoned_timestamp(zoned)
    return table(spark, sf_dir, "events").select(
        "event_id", F.convert_timezone(F.lit("UTC"), F.lit("UTC"), instant.cast("timestamp_ntz")).alias("instant")
    )


@query("""
    SELECT event_id, '{"event_type": "' || event_type || '", "tags": ["' || event_type || '", "u'
        || user_id || '"], "user_id": ' || user_id || '}' AS payload FROM events
""")
def event_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array("event_type", F.concat(F.lit("u"), "user_id"))
    payload = scalars.sorted_json(
        {
            "user_id": (F.col("user_id"), T.LongType()),
            "tags": (tags, T.ArrayType(T.StringType())),
            "event_type": (F.col("event_type"), T.StringType()),
        }
    )
    return table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))


@query("SELECT doc_id, left(text, 500) AS summary FROM documents")
def truncate_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", scalars.truncate_summary(F.col("text")).alias("summary"))

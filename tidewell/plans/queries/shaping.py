"""Nested and paged JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import normalize
from tidewell.plans.queries.book import query, table
from tidewell.session import new_scratch
from tidewell.sinks.dataset import Dataset
from tidewell.sources import registry
from tidewell.spec import Source

PAGE_SIZE = 20
RECORD = "results ARRAY<STRUCT<o_orderkey: BIGINT, o_custkey: BIGINT, o_totalprice: DOUBLE, o_orderpriority: STRING>>"
_FIELDS = "o_orderkey, o_custkey, o_totalprice, o_orderpriority"


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order status as an endpoint whose pages cover 20 order keys each."""
    record = F.struct("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("endpoint"),
                 F.expr(f"o_orderkey div {PAGE_SIZE}").alias("page_no"))
        .agg(F.array_sort(F.collect_list(record)).alias("results"))
        .select("endpoint", "page_no",
                F.to_json(F.struct(F.size("results").alias("count"), "results")).alias("payload"))
    )


@query(f"SELECT o_orderstatus AS endpoint, o_orderkey // {PAGE_SIZE} AS page_no, {_FIELDS} FROM orders")
def json_pages_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.records_of_pages(order_pages(spark, sf_dir), RECORD)


@query(f"""
    SELECT o_orderstatus AS endpoint, o_orderkey // {PAGE_SIZE} AS page_no, {_FIELDS} FROM orders
    WHERE o_orderkey // {PAGE_SIZE} < 5
""")  # fmt: skip
def limit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = normalize.limit_pages(order_pages(spark, sf_dir), 5)
    return normalize.records_of_pages(pages, RECORD)


@query(f"""
    SELECT o_orderstatus AS endpoint, o_orderkey // {PAGE_SIZE} AS page_no,
        CAST(row_number() OVER (PARTITION BY o_orderstatus, o_orderkey // {PAGE_SIZE}
            ORDER BY o_orderkey) - 1 AS INTEGER) AS _pos, {_FIELDS}
    FROM orders
""")  # fmt: skip
def child_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = order_pages(spark, sf_dir)
    parsed = pages.withColumn("results", F.from_json("payload", RECORD).getField("results"))
    return normalize.child_table(parsed, ["endpoint", "page_no"], "results")


@query("""
    SELECT event_id, user_id AS actor__id, event_type AS actor__last__kind,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS props__k FROM events
""")
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(
            F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("kind")).alias("last")
        ).alias("actor"),
        F.from_json("props", "k bigint").alias("props"),
    )
    return normalize.flatten_struct(nested)


@query("""
    SELECT event_type, 'OBJECT<' || string_agg(k || ': ' || t, ', ' ORDER BY k) || '>' AS json_schema
    FROM (SELECT DISTINCT event_type, unnest(json_keys(props)) AS k,
            CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' ELSE 'OTHER' END AS t
          FROM events)
    GROUP BY event_type
""")
def json_schema_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.json_schema(table(spark, sf_dir, "events"), "props", ["event_type"])


@query(f"""
    SELECT o_orderstatus AS endpoint, o_orderkey // {PAGE_SIZE} AS page_no,
        CAST(row_number() OVER (PARTITION BY o_orderstatus, o_orderkey // {PAGE_SIZE}
            ORDER BY o_orderkey) - 1 AS INTEGER) AS _pos, {_FIELDS}
    FROM orders
    WHERE o_orderkey // {PAGE_SIZE} <= (SELECT max(o_orderkey) // {PAGE_SIZE} // 2 FROM orders)
        OR o_orderpriority = '1-URGENT'
""")  # fmt: skip
def child_table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a nested table, loaded and then merged: the later half comes again with urgent
    orders only, so its other orders, and whole pages without any, lose their child rows."""
    pages = order_pages(spark, sf_dir)
    parsed = pages.select("endpoint", "page_no", F.from_json("payload", RECORD).results.alias("results"))
    half = F.lit(pages.agg(F.max("page_no")).first()[0] // 2)
    urgent = F.filter("results", lambda r: r["o_orderpriority"] == "1-URGENT")
    again = parsed.filter(F.col("page_no") > half).withColumn("results", urgent)
    target = Dataset(spark, new_scratch(spark, "children"), "raw")
    for part in (parsed, again):
        key = ["endpoint", "page_no"]
        _, children = normalize.split_nested("pages", part, key, keep_empty=True)
        target.load_children("pages__results", children["pages__results"])
    return target.read("pages__results")


@query(f"""
    WITH p AS (
        SELECT o_orderstatus AS endpoint, o_orderkey // {PAGE_SIZE} AS page_no, count(*) AS n
        FROM orders GROUP BY ALL)
    SELECT endpoint, count(*) AS n_pages, count(*) FILTER (page_no % 7 = 3) AS n_unreadable,
        count(*) FILTER (page_no % 7 = 4) AS n_without_records,
        CAST(coalesce(sum(n) FILTER (page_no % 7 NOT IN (3, 4)), 0) AS BIGINT) AS n_records
    FROM p GROUP BY endpoint
""")  # fmt: skip
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every seventh is cut off and every seventh has no records."""
    kind = F.col("page_no") % 7
    payload = (
        F.when(kind == 3, F.expr("left(payload, length(payload) - 2)"))
        .when(kind == 4, F.lit('{"results": []}')).otherwise(F.col("payload"))
    )
    return normalize.page_report(order_pages(spark, sf_dir).withColumn("payload", payload), RECORD)


@query(f"SELECT {_FIELDS} FROM orders")
def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages through the source builder: one table per endpoint, types inferred."""
    folder = new_scratch(spark, "pages")
    order_pages(spark, sf_dir).write.parquet(folder)
    config = {"base_url": "https://api.example.com", "endpoints": ["O", "F", "P"]}
    source = Source("rest_api", "shop", config)
    tables = registry.build(spark, source, {"shop": {"pages_path": folder}})
    return reduce(DataFrame.unionByName, tables.values())

"""Scans, cursors, merges, backfills and write dispositions."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import backfill
from tidewell.operators.incremental import (
    bounded_range,
    cursor_state,
    incremental_filter,
    lag_seconds,
    limit_rows,
)
from tidewell.operators.merge import dedup_latest, merge_upsert
from tidewell.plans import runner
from tidewell.plans.queries.book import query, table
from tidewell.session import new_scratch
from tidewell.sinks.dataset import Dataset
from tidewell.sources import files, registry
from tidewell.spec import PipelineSpec, Source

ITEM_KEY = ["l_orderkey", "l_linenumber"]
ITEM_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]

LATEST_ITEMS = """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (
            PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
        FROM {source}) WHERE rn = 1
"""


def _filesystem(url: str, glob: str, name: str, **config) -> Source:
    return Source("filesystem", name, {"bucket_url": url, "file_glob": glob, **config})


@query("SELECT * FROM orders")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.build(spark, _filesystem(sf_dir, "orders.parquet", "orders"), {})["orders"]


@query("SELECT * FROM orders")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table written as CSV and read back by header name, without type inference."""
    orders = table(spark, sf_dir, "orders")
    folder = new_scratch(spark, "orders-csv")
    shuffled = orders.select(*reversed(orders.columns))
    shuffled.write.option("header", True).csv(folder)
    return files.scan_files(spark, folder, "csv", "*.csv", schema=orders.schema)


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ', "as said"' || chr(10) || o_orderstatus END AS note,
        CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS o_orderstatus
    FROM orders
""")
def scan_csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of CSV files in one folder: other orders of columns, other columns, and texts
    with quotes, commas and line breaks."""
    orders, folder = table(spark, sf_dir, "orders"), new_scratch(spark, "orders-headers")
    note = F.concat("o_orderpriority", F.lit(', "as said"\n'), "o_orderstatus").alias("note")
    kinds = (
        ["o_orderkey", note, "o_custkey", "o_totalprice"],
        ["o_totalprice", "o_custkey", "o_orderkey"],
        ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"],
    )
    for k, columns in enumerate(kinds):
        rows = orders.filter(F.col("o_orderkey") % 3 == k).select(*columns)
        rows.write.option("header", True).option("escape", '"').csv(f"{folder}/kind{k}")
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, note string, o_orderstatus string"
    return files.scan_files(spark, folder, "csv", "*.csv", options={"multiLine": True}, schema=schema)


@query("SELECT * FROM orders")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table written as JSON lines and read back with inferred types."""
    folder = new_scratch(spark, "orders-jsonl")
    table(spark, sf_dir, "orders").write.json(folder)
    source = _filesystem(folder, "*.json", "orders", format="jsonl")
    read = registry.build(spark, source, {})["orders"]
    return read.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", name="limit_rows")
def limit_rows_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return limit_rows(orders, 100, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query(LATEST_ITEMS.format(source="lineitem"), name="dedup_latest")
def dedup_latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_latest(table(spark, sf_dir, "lineitem"), ITEM_KEY, ITEM_ORDER)


_MERGED = f"""
    WITH base AS ({LATEST_ITEMS.format(source="(SELECT * FROM lineitem WHERE l_returnflag <> 'R')")}),
    delta AS ({LATEST_ITEMS.format(source="(SELECT * FROM lineitem WHERE l_returnflag = 'R')")})
    SELECT * FROM delta UNION ALL
    SELECT * FROM base WHERE NOT EXISTS (
        SELECT 1 FROM delta WHERE delta.l_orderkey = base.l_orderkey
            AND delta.l_linenumber = base.l_linenumber)
"""


@query(_MERGED, name="merge_upsert")
def merge_upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items arrive as a delta over all others; the delta wins by key."""
    items = table(spark, sf_dir, "lineitem")
    base = dedup_latest(items.filter("l_returnflag <> 'R'"), ITEM_KEY, ITEM_ORDER)
    delta = dedup_latest(items.filter("l_returnflag = 'R'"), ITEM_KEY, ITEM_ORDER)
    return merge_upsert(base, delta, ITEM_KEY)


@query(_MERGED)
def merge_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the target table: first load, merge by bucket, read back."""
    items = table(spark, sf_dir, "lineitem")
    target = Dataset(spark, new_scratch(spark, "merge"), "raw")
    for rows in (items.filter("l_returnflag <> 'R'"), items.filter("l_returnflag = 'R'")):
        target.load("lineitem", rows, "merge", key=ITEM_KEY, cursor="l_shipdate")
    return target.read("lineitem")


@query("SELECT * FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < DATE '1998-01-01')",
       name="incremental_filter")
def incremental_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before 1998 were loaded; the stored cursor selects the rest and its own day."""
    orders = table(spark, sf_dir, "orders")
    loaded = orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    last = cursor_state({"orders": (loaded, "o_orderdate")}).first()["cursor_value"]
    return incremental_filter(orders, "o_orderdate", last)


@query("""
    SELECT * FROM orders WHERE o_orderdate >= (
        SELECT max(o_orderdate) FROM orders WHERE o_orderdate < DATE '1998-01-01')
        - INTERVAL 30 DAY - INTERVAL 3600 SECOND
""")
def incremental_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    loaded = orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    last = cursor_state({"orders": (loaded, "o_orderdate")}).first()["cursor_value"]
    return incremental_filter(orders, "o_orderdate", last, lag_seconds(3600, "P30D"))


@query("""
    SELECT 'orders' AS table_name, CAST(max(o_orderdate) AS VARCHAR) AS cursor_value,
        count(*) AS "rows", count(*) FILTER (o_orderdate IS NULL) AS null_cursors FROM orders
    UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS VARCHAR), count(*),
        count(*) FILTER (l_shipdate IS NULL) FROM lineitem
    UNION ALL SELECT 'events', CAST(max(ts) AS VARCHAR), count(*),
        count(*) FILTER (ts IS NULL) FROM events
""", name="cursor_state")  # fmt: skip
def cursor_state_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    return cursor_state({t: (table(spark, sf_dir, t), c) for t, c in cursors.items()})


def _orders_spec(url: str, **sync) -> PipelineSpec:
    return PipelineSpec.from_dict(
        {
            "name": "orders_sync",
            "source": {
                "type": "filesystem", "connection": "orders",
                "config": {"bucket_url": url, "file_glob": "*.parquet"},
            },
            "sync": {
                "mode": "incremental", "cursor_field": "o_orderdate", "primary_key": "o_orderkey",
                **sync,
            },
            "destination": {"type": "duckdb", "connection": "local", "dataset": "raw_orders"},
            "options": {"write_disposition": "merge"},
        }
    )


@query("""
    WITH early AS (SELECT * FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) / 2 FROM orders)
        AND o_orderdate < DATE '2000-01-01')
    SELECT * FROM early UNION
    SELECT * FROM orders
    WHERE o_orderdate >= (SELECT max(o_orderdate) FROM early) - INTERVAL 200 DAY
""")
def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a spec: early orders first, then all of them have arrived. The lookback
    picks up late rows inside its window, and later ones stay missing, as they should."""
    orders = table(spark, sf_dir, "orders")
    folder = new_scratch(spark, "orders-in")
    root = new_scratch(spark, "orders-out")
    half = orders.agg((F.max("o_orderkey") / 2).alias("half")).first()["half"]
    early = orders.filter(
        (F.col("o_orderkey") <= half)
        & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    )
    early.write.parquet(f"{folder}/early")
    spec = _orders_spec(folder, lookback="P200D")
    runner.run(spark, spec, root)
    orders.join(early.select("o_orderkey"), "o_orderkey", "left_anti").write.parquet(f"{folder}/late")
    runner.run(spark, spec, root)
    return Dataset(spark, root, "raw_orders").read("orders")


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'",
       name="bounded_range")
def bounded_range_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (8, 15))
    return bounded_range(table(spark, sf_dir, "events"), "ts", start, end)


_WEEKS = """
    SELECT CAST(i AS BIGINT) AS chunk_id, TIMESTAMP '2024-01-01' + i * INTERVAL 7 DAY AS chunk_start,
        least(TIMESTAMP '2024-01-01' + (i + 1) * INTERVAL 7 DAY, TIMESTAMP '2024-01-31') AS chunk_end
    FROM generate_series(0, 4) AS g(i)
"""


@query(f"""
    SELECT c.*, count(e.event_id) AS n_rows FROM ({_WEEKS}) c
    LEFT JOIN events e ON e.ts >= c.chunk_start AND e.ts < c.chunk_end GROUP BY ALL
""")  # fmt: skip
def backfill_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return backfill.backfill_counts(events, "ts", datetime(2024, 1, 1), datetime(2024, 1, 31), "P7D")


@query("""
    SELECT i AS chunk_id, TIMESTAMP '1995-01-01' + i * INTERVAL 1 MONTH AS chunk_start,
        TIMESTAMP '1995-01-01' + (i + 1) * INTERVAL 1 MONTH AS chunk_end,
        (SELECT count(*) FROM orders
         WHERE o_orderdate >= TIMESTAMP '1995-01-01' + i * INTERVAL 1 MONTH
           AND o_orderdate < TIMESTAMP '1995-01-01' + (i + 1) * INTERVAL 1 MONTH) AS n_rows
    FROM generate_series(0, 83) AS g(i)
""")
def backfill_calendar_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    start, end = datetime(1995, 1, 1), datetime(2002, 1, 1)
    return backfill.backfill_counts(orders, "o_orderdate", start, end, "P1M")


@query(f"""
    WITH counts AS (
        SELECT c.*, count(e.event_id) AS n FROM ({_WEEKS}) c
        LEFT JOIN events e ON e.ts >= c.chunk_start AND e.ts < c.chunk_end GROUP BY ALL)
    SELECT chunk_start, chunk_end, chunk_id FROM counts WHERE n <= (SELECT avg(n) FROM counts)
""")  # fmt: skip
def backfill_pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with more rows than the average count as done; the others are pending."""
    counts = backfill_chunks(spark, sf_dir)
    mean = counts.agg(F.avg("n_rows").alias("mean")).first()["mean"]
    done = counts.filter(F.col("n_rows") > mean)
    return backfill.pending_chunks(counts.drop("n_rows"), done)


@query("""
    SELECT TIMESTAMP '1995-01-01' + i * INTERVAL 1 YEAR AS chunk_start,
        TIMESTAMP '1995-01-01' + (i + 1) * INTERVAL 1 YEAR AS chunk_end,
        (SELECT count(*) FROM orders
         WHERE o_orderdate >= TIMESTAMP '1995-01-01' + i * INTERVAL 1 YEAR
           AND o_orderdate < TIMESTAMP '1995-01-01' + (i + 1) * INTERVAL 1 YEAR) AS n_rows,
        true AS is_complete
    FROM generate_series(3, 6) AS g(i)
""")
def backfill_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill over three years, then over seven: the second loads the four new chunks, and
    the target holds every order once."""
    folder, root = new_scratch(spark, "backfill-in"), new_scratch(spark, "backfill-out")
    orders = table(spark, sf_dir, "orders")
    orders.write.parquet(folder)
    spec = _orders_spec(folder, backfill={"chunk_size": "P1Y"})
    years = [datetime(y, 1, 1, tzinfo=timezone.utc) for y in (1995, 1998, 2002)]
    runner.run_backfill(spark, spec, years[0], years[1], root)
    second = runner.run_backfill(spark, spec, years[0], years[2], root)
    landed = Dataset(spark, root, "raw_orders").read("orders")
    complete = landed.exceptAll(orders).isEmpty() and orders.exceptAll(landed).isEmpty()
    return second.select("chunk_start", "chunk_end", "n_rows", F.lit(complete).alias("is_complete"))


@query("""
    SELECT * FROM orders
    WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2001-03-01'
""")
def backfill_overlap_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending backfills whose bounds and chunk sizes cross, the last one over a gap: every
    order lands once."""
    folder, root = new_scratch(spark, "overlap-in"), new_scratch(spark, "overlap-out")
    table(spark, sf_dir, "orders").write.parquet(folder)
    for size, start, end in (
        ("P1Y", (1995, 1), (1997, 1)), ("P1Y", (1998, 1), (1999, 1)), ("P7M", (1996, 6), (2001, 3)),
    ):
        spec = _orders_spec(folder, backfill={"chunk_size": size})
        spec = replace(spec, options=replace(spec.options, write_disposition="append"))
        bounds = (datetime(*month, 1, tzinfo=timezone.utc) for month in (start, end))
        runner.run_backfill(spark, spec, *bounds, root)
    return Dataset(spark, root, "raw_orders").read("orders")


@query("""
    SELECT TIMESTAMP '1995-01-01' + i * INTERVAL 1 MONTH AS chunk_start,
        TIMESTAMP '1995-01-01' + (i + 1) * INTERVAL 1 MONTH AS chunk_end,
        (SELECT count(*) FROM orders
         WHERE o_orderdate >= TIMESTAMP '1995-01-01' + i * INTERVAL 1 MONTH
           AND o_orderdate < TIMESTAMP '1995-01-01' + (i + 1) * INTERVAL 1 MONTH) AS n_rows,
        CAST(1 AS BIGINT) AS n_loads
    FROM generate_series(0, 83) AS g(i)
""")
def backfill_single_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """84 months in one load of one scan, into a table partitioned by month."""
    folder, root = new_scratch(spark, "single-in"), new_scratch(spark, "single-out")
    table(spark, sf_dir, "orders").write.parquet(folder)
    spec = _orders_spec(folder, backfill={"chunk_size": "P1M"})
    spec = replace(spec, options=replace(spec.options, partition_field="o_orderdate"))
    years = (datetime(y, 1, 1, tzinfo=timezone.utc) for y in (1995, 2002))
    done = runner.run_backfill(spark, spec, *years, root)
    loads = Dataset(spark, root, "raw_orders").loads().agg(F.count("*").alias("n_loads"))
    return done.select("chunk_start", "chunk_end", "n_rows").crossJoin(F.broadcast(loads))


@query("""
    WITH late AS (
        SELECT o_orderkey, o_custkey, 'M' AS o_orderstatus, o_totalprice + 1 AS o_totalprice,
            CASE WHEN o_custkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 45 DAY END AS o_orderdate,
            o_orderpriority
        FROM orders WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-05-01')
    SELECT *, CAST(strftime(o_orderdate, '%Y-%m') IN (SELECT strftime(o_orderdate, '%Y-%m') FROM late
        UNION SELECT '1997-03' UNION SELECT '1997-04') AS BOOLEAN) AS is_rewritten
    FROM (SELECT * FROM late UNION ALL
          SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM late))
""")
def merge_partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month; a second run brings two months' orders anew, half of them with a later
    date. Moved rows leave their old month, and months that the run does not touch keep their
    files."""
    folder, root = new_scratch(spark, "parts-in"), new_scratch(spark, "parts-out")
    orders = table(spark, sf_dir, "orders")
    orders.write.parquet(f"{folder}/first")
    spec = _orders_spec(f"{folder}/first")
    spec = replace(spec, options=replace(spec.options, partition_field="o_orderdate"))
    runner.run(spark, spec, root)
    target = runner.target_of(spark, spec, root, {})
    before = target.read("orders").select(F.input_file_name().alias("file")).distinct()
    before.write.parquet(f"{folder}/files")
    month = F.col("o_orderdate").cast("date")
    some = orders.filter((month >= F.lit("1997-03-01")) & (month < F.lit("1997-05-01")))
    moved = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate")).otherwise(
        F.col("o_orderdate") + F.expr("INTERVAL 45 DAYS")
    )
    late = some.withColumn("o_orderdate", moved).withColumn("o_orderstatus", F.lit("M"))
    late = late.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    target.load("orders", late, "merge", key="o_orderkey", cursor="o_orderdate")
    old = spark.read.parquet(f"{folder}/files").withColumnRenamed("file", "old")
    landed = target.read("orders").withColumn("file", F.input_file_name())
    return landed.join(old, F.col("file") == F.col("old"), "left").select(
        *orders.columns, F.col("old").isNull().alias("is_rewritten")
    )


@query("""
    SELECT o_custkey, count(*) AS n_rows, max(o_orderdate) AS latest FROM orders GROUP BY 1
""")
def limit_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs limited to a fifth of the table each, the cursor being a customer key that many
    orders share: each gets further, and after enough of them every order is there once."""
    folder, root = new_scratch(spark, "limit-in"), new_scratch(spark, "limit-out")
    orders = table(spark, sf_dir, "orders")
    orders.write.parquet(folder)
    spec = _orders_spec(folder)
    spec = replace(
        spec, sync=replace(spec.sync, cursor_field="o_custkey"),
        options=replace(spec.options, write_disposition="append"),
    )
    limit = max(1, orders.count() // 5)
    for _ in range(6):
        runner.run(spark, spec, root, limit=limit)
    landed = Dataset(spark, root, "raw_orders").read("orders")
    return landed.groupBy("o_custkey").agg(F.count("*").alias("n_rows"), F.max("o_orderdate").alias("latest"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS o_orderdate FROM orders
""")
def incremental_null_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appending runs over rows of which some have no cursor value: all land once."""
    folder, root = new_scratch(spark, "null-in"), new_scratch(spark, "null-out")
    orders = table(spark, sf_dir, "orders")
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    rows = orders.select("o_orderkey", known.alias("o_orderdate"))
    spec = _orders_spec(folder)
    spec = replace(spec, options=replace(spec.options, write_disposition="append"))
    rows.filter("o_orderkey % 2 = 0").write.parquet(f"{folder}/even")
    runner.run(spark, spec, root)
    newest = rows.agg(F.max("o_orderdate").alias("d")).first()["d"]
    rows.filter("o_orderkey % 2 = 1").write.parquet(f"{folder}/odd")
    wide = replace(spec, sync=replace(spec.sync, lookback="P9999D")) if newest else spec
    for _ in range(2):
        runner.run(spark, wide, root)
    return Dataset(spark, root, "raw_orders").read("orders")


@query("""
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
        CASE WHEN o_orderdate >= DATE '1998-01-01' THEN o_orderpriority END AS o_orderpriority
    FROM orders
""")
def append_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appending loads; the second brings a column that older rows lack."""
    orders = table(spark, sf_dir, "orders")
    recent = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    target = Dataset(spark, new_scratch(spark, "append"), "raw")
    target.load("orders", orders.filter(~recent).drop("o_orderpriority"), "append")
    target.load("orders", orders.filter(recent), "append")
    return target.read("orders")


@query("SELECT * REPLACE (lower(o_orderpriority) AS o_orderpriority) FROM orders")
def replace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full refresh twice: only the second version is left, even though it was read from
    the first."""
    target = Dataset(spark, new_scratch(spark, "replace"), "raw")
    target.load("orders", table(spark, sf_dir, "orders"), "replace")
    again = target.read("orders").withColumn("o_orderpriority", F.lower("o_orderpriority"))
    target.load("orders", again, "replace")
    return target.read("orders")


@query("""
    SELECT 'orders' AS table_name, count(*) AS n_rows, 'o_orderkey bigint, o_custkey bigint, '
        || 'o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, '
        || 'o_orderpriority string' AS columns FROM orders
""")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = {
        "name": "orders_dry",
        "source": {
            "type": "filesystem", "connection": "orders",
            "config": {"bucket_url": sf_dir, "file_glob": "orders.parquet"},
        },
        "sync": {"mode": "full_refresh"},
        "destination": {"type": "duckdb", "connection": "local", "dataset": "raw"},
    }
    return runner.dry_run(spark, PipelineSpec.from_dict(raw))


@query("SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS size_in_bytes FROM documents GROUP BY 1")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files per source; the listing adds up their sizes."""
    folder = new_scratch(spark, "documents-txt")
    documents = table(spark, sf_dir, "documents").select("source", "text")
    documents.write.partitionBy("source").text(folder)
    listed = files.list_files(spark, folder, "*.txt")
    source = F.regexp_extract("file_url", "/source=([^/]+)/", 1)
    return listed.groupBy(source.alias("source")).agg(F.sum("size_in_bytes").alias("size_in_bytes"))


@query("SELECT * FROM orders")
def file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six files as a stream of three pages of two files each."""
    scratch = new_scratch(spark, "orders-stream")
    orders = table(spark, sf_dir, "orders")
    orders.repartition(6).write.parquet(f"{scratch}/in")
    stream = files.stream_files(
        spark, f"{scratch}/in", "parquet", orders.schema, "*.parquet", files_per_page=2
    )
    query = (
        stream.writeStream.format("parquet").option("path", f"{scratch}/out")
        .option("checkpointLocation", f"{scratch}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(orders.schema).parquet(f"{scratch}/out")


@query("""
    SELECT 'load_customer' AS pipeline, 'ok' AS status, count(*) AS n_rows FROM customer
    UNION ALL SELECT 'load_orders', 'ok', count(*) FROM orders
    UNION ALL SELECT 'load_part', 'ok', count(*) FROM part
    UNION ALL SELECT 'load_absent', 'failed', 0
""")
def fleet_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four full refreshes, one of a table that does not exist."""
    specs = [
        {
            "name": f"load_{name}",
            "source": {"type": "filesystem", "connection": name,
                       "config": {"bucket_url": sf_dir, "file_glob": f"{name}.parquet"}},
            "sync": {"mode": "full_refresh"},
            "destination": {"type": "duckdb", "connection": "local", "dataset": f"raw_{name}"},
        }
        for name in ("customer", "orders", "part", "absent")
    ]
    return runner.run_fleet(spark, specs, new_scratch(spark, "fleet")).drop("error")

"""Change data capture over the event table as a change log.

The position is the event id, the key the user; sign-ups insert, errors delete and every
other event updates. Customers are the initial copy.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalars import lsn_diff
from tidewell.operators import changes
from tidewell.plans import runner
from tidewell.plans.queries.book import query, table
from tidewell.session import new_scratch
from tidewell.sinks.dataset import Dataset
from tidewell.sources.changelog import LogConfig
from tidewell.spec import PipelineSpec
from tidewell.streaming.change_stream import apply_stream, pending_changes, read_log, sync_changes
from tidewell.streaming.transactions import drain_transactions, sync_transactions

KEY = ["user_id"]


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = (
        F.when(F.col("event_type") == "signup", changes.INSERT)
        .when(F.col("event_type") == "error", changes.DELETE)
        .otherwise(changes.UPDATE)
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("lsn"), F.expr("event_id div 7").alias("tx_id"), op.alias("op"),
        F.col("ts").alias("commit_ts"), "user_id", "event_type", "value", "props",
    )


def initial_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return changes.snapshot(
        customers.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    )


_OP = "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END"
_LATEST = """
    SELECT user_id, event_type, value, props, event_id AS _lsn,
        CASE WHEN event_type = 'error' THEN ts END AS _deleted_at
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
          FROM events) WHERE rn = 1
"""
_APPLIED = f"""
    WITH latest AS ({_LATEST})
    SELECT user_id, value, event_type, props, _lsn, _deleted_at FROM latest UNION ALL
    SELECT c_custkey, c_acctbal, NULL, NULL, 0, NULL FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM latest)
"""


@query("""
    SELECT CAST(0 AS BIGINT) AS lsn, 'S' AS op, CAST(NULL AS TIMESTAMP) AS commit_ts,
        c_custkey AS user_id, c_acctbal AS value FROM customer
""")
def cdc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return initial_copy(spark, sf_dir)


@query(_LATEST)
def cdc_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest_changes(change_log(spark, sf_dir), KEY)


@query(_APPLIED)
def cdc_snapshot_plus_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial copy and log as one stream of changes."""
    log = changes.snapshot_plus_stream(initial_copy(spark, sf_dir), change_log(spark, sf_dir))
    return changes.latest_changes(log, KEY)


@query(_APPLIED)
def cdc_apply_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes onto stored rows; deleted rows stay, flagged."""
    base = changes.latest_changes(initial_copy(spark, sf_dir), KEY)
    latest = changes.latest_changes(change_log(spark, sf_dir), KEY)
    return changes.apply_changes(base, latest, KEY)


@query(f"SELECT user_id, value, event_type, props, _lsn FROM ({_APPLIED}) WHERE _deleted_at IS NULL")
def cdc_apply_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes onto stored rows; the content of deleted rows is erased and they are hidden."""
    base = changes.latest_changes(initial_copy(spark, sf_dir), KEY)
    latest = changes.latest_changes(change_log(spark, sf_dir), KEY)
    applied = changes.apply_changes(base, changes.erase_deleted(latest, KEY), KEY)
    return changes.live_rows(applied).drop(changes.DELETED_AT)


@query(f"SELECT * FROM ({_APPLIED}) WHERE _deleted_at IS NULL", name="live_rows")
def live_rows_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.live_rows(cdc_apply_soft(spark, sf_dir))


def _with_columns(df: DataFrame) -> DataFrame:
    return df.select("user_id", "value", "event_type", "props", "_lsn", "_deleted_at")


@query(_APPLIED)
def cdc_apply_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial copy, then the later and the earlier part of the log, then all of it again:
    out-of-order and repeated changes lead to the same table."""
    target = Dataset(spark, new_scratch(spark, "changes"), "raw")
    log = change_log(spark, sf_dir)
    late = F.col("commit_ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (initial_copy(spark, sf_dir), log.filter(late), log.filter(~late), log):
        target.apply("accounts", part, KEY)
    return _with_columns(target.read("accounts"))


@query(_APPLIED)
def cdc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as files, drained by a stream in three micro-batches; draining it again finds
    nothing."""
    scratch = new_scratch(spark, "change-stream")
    log = change_log(spark, sf_dir).withColumn("table_name", F.lit("accounts"))
    log.repartitionByRange(6, "lsn").write.parquet(f"{scratch}/log")
    target = Dataset(spark, scratch, "raw")
    target.apply("accounts", initial_copy(spark, sf_dir), KEY)
    for _ in range(2):
        stream = read_log(spark, f"{scratch}/log", log.schema, files_per_batch=2)
        query = apply_stream(stream, target, ["accounts"], KEY, f"{scratch}/checkpoint")
        query.awaitTermination()
    return _with_columns(target.read("accounts"))


@query(f"SELECT user_id, value, event_type, _lsn, _deleted_at FROM ({_APPLIED})")
def cdc_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec over a stored copy and a growing log: copy and early changes first, then the late
    ones, then a run that finds nothing new. Only chosen columns are carried."""
    scratch = new_scratch(spark, "cdc-run")
    customers = table(spark, sf_dir, "customer")
    customers.select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"),
        F.lit(None).cast("string").alias("event_type"),
    ).write.parquet(f"{scratch}/copy/accounts")
    log = change_log(spark, sf_dir).withColumn("table_name", F.lit("accounts"))
    late = F.col("commit_ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    spec = PipelineSpec.from_dict(
        {
            "name": "accounts_cdc",
            "source": {
                "type": "pg_cdc", "connection": "pg",
                "config": {
                    "slot_name": "s", "publication_name": "p", "tables": ["accounts"],
                    "include_columns": {"accounts": ["value", "event_type"]},
                },
            },
            "sync": {"mode": "cdc", "primary_key": "user_id"},
            "destination": {"type": "duckdb", "connection": "local", "dataset": "raw"},
        }
    )
    place = {"pg": {"log_path": f"{scratch}/log", "snapshot_path": f"{scratch}/copy"}}
    for part in (log.filter(~late), log.filter(late), None):
        if part is not None:
            part.write.mode("append").parquet(f"{scratch}/log")
        runner.run(spark, spec, scratch, place)
    return Dataset(spark, scratch, "raw").read("accounts")


def _stored(spark: SparkSession, sf_dir: str, scratch: str) -> tuple[DataFrame, LogConfig]:
    """The initial copy as a stored folder; the log that is to be stored beside it."""
    customers = table(spark, sf_dir, "customer")
    customers.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value")).write.parquet(
        f"{scratch}/copy/accounts"
    )
    config = LogConfig(
        slot="s", tables=["accounts"], log_path=f"{scratch}/log", snapshot_path=f"{scratch}/copy",
        publish=changes.DEFAULT_PUBLISH, reset=False, include={}, hints={}, batch_size=1000, flush=True,
    )
    return change_log(spark, sf_dir).withColumn("table_name", F.lit("accounts")), config


@query(_APPLIED)
def cdc_stream_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that a drained stream and then changes from nowhere went into, with positions
    beyond the log; a reset brings it back to the copy and the log."""
    scratch = new_scratch(spark, "stream-reset")
    log, config = _stored(spark, sf_dir, scratch)
    log.write.parquet(config.log_path)
    target = Dataset(spark, scratch, "raw")

    def drain(reset: bool) -> None:
        sync_changes(
            spark, config.log_path, log.schema, target, replace(config, reset=reset), KEY,
            f"{scratch}/checkpoint",
        )

    drain(False)
    stray = change_log(spark, sf_dir).withColumns({"lsn": F.col("lsn") + 10**12, "value": F.lit(-1.0)})
    target.apply("accounts", stray, KEY)
    drain(True)
    return _with_columns(target.read("accounts"))


@query(f"SELECT user_id, value, event_type, props, _lsn, _deleted_at FROM ({_APPLIED})")
def cdc_replace_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change data with ``replace``, run before and after the log grew and once more: every run
    leaves the copy and the whole log, not only what came since the last one."""
    scratch = new_scratch(spark, "cdc-replace")
    log, config = _stored(spark, sf_dir, scratch)
    spec = PipelineSpec.from_dict(
        {
            "name": "accounts_anew",
            "source": {
                "type": "pg_cdc", "connection": "pg",
                "config": {"slot_name": "s", "publication_name": "p", "tables": ["accounts"]},
            },
            "sync": {"mode": "cdc", "primary_key": "user_id"},
            "destination": {"type": "duckdb", "connection": "local", "dataset": "raw"},
            "options": {"write_disposition": "replace"},
        }
    )
    place = {"pg": {"log_path": config.log_path, "snapshot_path": config.snapshot_path}}
    late = F.col("commit_ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (log.filter(~late), log.filter(late), None):
        if part is not None:
            part.write.mode("append").parquet(config.log_path)
        runner.run(spark, spec, scratch, place)
    return _with_columns(Dataset(spark, scratch, "raw").read("accounts"))


@query(f"""
    SELECT event_id AS lsn, event_id // 7 AS tx_id, {_OP} AS op, ts AS commit_ts, user_id, event_type,
        value, props, 'accounts' AS table_name
    FROM events WHERE ts >= TIMESTAMP '2024-01-15'
""")  # fmt: skip
def cdc_shadow_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream that has drained the first half of the month would read next, asked twice:
    the first answer moved nothing."""
    scratch = new_scratch(spark, "shadow-read")
    log, config = _stored(spark, sf_dir, scratch)
    late = F.col("commit_ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    log.filter(~late).write.parquet(config.log_path)
    checkpoint = f"{scratch}/checkpoint"
    sync_changes(spark, config.log_path, log.schema, Dataset(spark, scratch, "raw"), config, KEY, checkpoint)
    log.filter(late).write.mode("append").parquet(config.log_path)
    pending_changes(spark, config.log_path, log.schema, checkpoint)
    return pending_changes(spark, config.log_path, log.schema, checkpoint)


def _interleaved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, int]:
    """The log with transactions of seven changes, three of them under way at any time; which
    changes come late; and a sixth of its rows."""
    log = change_log(spark, sf_dir).withColumn("tx_id", F.expr("lsn div 21 * 3 + lsn % 3"))
    facts = log.agg(F.max("lsn").alias("newest"), F.count(F.lit(1)).alias("n")).first()
    return log, F.col("lsn") >= facts["newest"] // 42 * 21, max(1, facts["n"] // 6)


@query("""
    WITH log AS (SELECT event_id, event_id // 21 * 3 + event_id % 3 AS tx_id,
            event_id >= (SELECT max(event_id) // 42 * 21 FROM events) AS late FROM events),
        tx AS (SELECT late, tx_id, count(*) AS n_rows, min(event_id) AS lo, max(event_id) AS hi
            FROM log GROUP BY ALL),
        seen AS (SELECT *, max(hi) OVER earlier AS reach, coalesce(sum(n_rows) OVER earlier, 0) AS before
            FROM tx WINDOW earlier AS (PARTITION BY late ORDER BY lo
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        grouped AS (SELECT *, count(*) FILTER (reach IS NULL OR lo > reach)
                OVER (PARTITION BY late ORDER BY lo) AS together FROM seen),
        batched AS (SELECT *, min(before) OVER (PARTITION BY late, together)
                // (SELECT greatest(1, count(*) // 6) FROM events) AS batch FROM grouped)
    SELECT tx_id, hi AS commit_lsn, n_rows, max(hi) OVER (PARTITION BY late, batch) AS end_lsn
    FROM batched
""")
def cdc_stream_whole_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved transactions, drained in batches before and after the log grew: the batch of
    each, counted where it was handed over, so that one that is split shows twice."""
    scratch = new_scratch(spark, "whole-tx")
    log, late, size = _interleaved(spark, sf_dir)

    def count(part: DataFrame, after: int, end: int) -> None:
        part.groupBy("tx_id").agg(
            F.max("lsn").alias("commit_lsn"), F.count(F.lit(1)).alias("n_rows")
        ).withColumn("end_lsn", F.lit(end).cast("bigint")).write.mode("overwrite").parquet(
            f"{scratch}/batches/batch={end}"
        )

    for part in (log.filter(~late), log.filter(late)):
        part.write.mode("append").parquet(f"{scratch}/log")
        stored = spark.read.schema(log.schema).parquet(f"{scratch}/log")
        drain_transactions(spark, stored, f"{scratch}/checkpoint", count, size)
    return spark.read.parquet(f"{scratch}/batches").drop("batch")


@query(f"""
    SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS table_name, user_id, value, event_type,
        props, _lsn, _deleted_at FROM ({_LATEST})
""")  # fmt: skip
def cdc_sync_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one log, kept up to date in batches of whole transactions; the last call finds
    nothing new."""
    scratch = new_scratch(spark, "sync-tx")
    log, late, size = _interleaved(spark, sf_dir)
    odd = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    log = log.withColumn("table_name", odd)
    config = LogConfig(
        slot="s", tables=["even", "odd"], log_path=f"{scratch}/log", snapshot_path=None,
        publish=changes.DEFAULT_PUBLISH, reset=False, include={}, hints={}, batch_size=3 * size,
        flush=True,
    )
    target = Dataset(spark, scratch, "raw")
    for part in (log.filter(~late), log.filter(late), None):
        if part is not None:
            part.write.mode("append").parquet(config.log_path)
        sync_transactions(
            spark, config.log_path, log.schema, target, config, KEY, f"{scratch}/checkpoint"
        )
    even, other = (
        _with_columns(target.read(t)).withColumn("table_name", F.lit(t)) for t in config.tables
    )
    return even.unionByName(other)


@query(f"""
    SELECT event_id AS lsn, event_id // 7 AS tx_id, {_OP} AS op, ts AS commit_ts, user_id,
        event_type, value, props FROM events WHERE {_OP} IN ('I', 'U')
""")  # fmt: skip
def cdc_publish_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.publish_filter(change_log(spark, sf_dir), "insert, update")


@query(f"SELECT event_id AS lsn, {_OP} AS op, ts AS commit_ts, event_id // 7 AS tx_id, user_id, value FROM events")
def cdc_include_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.include_columns(change_log(spark, sf_dir), KEY, ["value"])


@query("""
    SELECT event_id AS lsn, user_id, CAST(user_id AS VARCHAR) AS user_text,
        CAST(value AS DECIMAL(12, 2)) AS value, CAST(ts AS DATE) AS commit_ts,
        TRY_CAST(event_type AS BIGINT) AS event_type FROM events
""")
def column_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).select(
        "lsn", "user_id", F.col("user_id").alias("user_text"), "value", "commit_ts", "event_type"
    )
    hints = {"user_text": "string", "value": "decimal(12,2)", "commit_ts": "date", "event_type": "bigint"}
    return changes.column_hints(log, {c: {"data_type": t} for c, t in hints.items()})


@query("""
    SELECT event_type AS table_name, user_id, max(event_id) AS last_lsn, count(*) AS n_changes
    FROM events GROUP BY ALL
""")
def cdc_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shared log, one table per event type; each is summed up on its own."""
    log = change_log(spark, sf_dir).withColumn("table_name", F.col("event_type"))
    tables = changes.demux(log, ["click", "error", "purchase", "signup", "view"])
    result = None
    for name, part in tables.items():
        summed = part.groupBy("user_id").agg(
            F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("n_changes")
        )
        summed = summed.withColumn("table_name", F.lit(name))
        result = summed if result is None else result.unionByName(summed)
    return result


@query("""
    WITH tx AS (SELECT event_id // 7 AS tx_id, max(event_id) AS commit_lsn, count(*) AS n_rows
        FROM events GROUP BY 1)
    SELECT tx_id, commit_lsn, n_rows,
        CAST((sum(n_rows) OVER (ORDER BY commit_lsn) - n_rows) // 1000 AS BIGINT) AS batch_id
    FROM tx
""")
def tx_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.tx_batches(change_log(spark, sf_dir), 1000, slice_width=1 << 12)


@query("""
    WITH p AS (SELECT event_type AS slot_name, max(event_id) AS confirmed_lsn FROM events GROUP BY 1)
    SELECT slot_name, true AS found, (SELECT max(event_id) FROM events) - confirmed_lsn AS lag,
        (SELECT max(event_id) FROM events) - confirmed_lsn <= 2 AS ok FROM p
    UNION ALL SELECT 'standby', false, NULL, false
""")
def replication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type is a slot that confirmed its own last event; one slot is missing."""
    log = change_log(spark, sf_dir)
    confirmed = log.groupBy(F.col("event_type").alias("slot_name")).agg(
        F.max("lsn").alias("confirmed_lsn")
    )
    newest = log.agg(F.max("lsn").alias("newest")).first()["newest"]
    positions = confirmed.withColumn("current_lsn", F.lit(newest))
    missing = spark.createDataFrame([("standby",)], "slot_name string")
    slots = confirmed.select("slot_name").unionByName(missing)
    return changes.replication_lag(slots, positions, max_lag=2)


@query("""
    SELECT event_id, printf('%X/%X', user_id, event_id * 4096) AS newer,
        printf('%X/%X', user_id // 2, event_id) AS older,
        CAST((user_id - user_id // 2) * 4294967296 + event_id * 4095 AS BIGINT) AS distance
    FROM events
""", name="lsn_diff")  # fmt: skip
def lsn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    def position(high: str, low: str):
        return F.concat(F.hex(F.expr(high)), F.lit("/"), F.hex(F.expr(low)))

    positions = table(spark, sf_dir, "events").select(
        "event_id", position("user_id", "event_id * 4096").alias("newer"),
        position("user_id div 2", "event_id").alias("older"),
    )
    return positions.withColumn("distance", lsn_diff(F.col("newer"), F.col("older")))

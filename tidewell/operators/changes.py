"""Change data capture: snapshot, change log, latest change per key, apply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.merge import as_key, dedup_latest

# Operation codes of the change log and the publishable kinds.
SNAPSHOT, INSERT, UPDATE, DELETE = "S", "I", "U", "D"
PUBLISH_CODES = {"insert": INSERT, "update": UPDATE, "delete": DELETE}
DEFAULT_PUBLISH = "insert, update, delete"

LSN = "_lsn"
DELETED_AT = "_deleted_at"


def snapshot(df: DataFrame, commit_ts: Column | None = None) -> DataFrame:
    """The initial copy of a table, as changes that any logged change outranks."""
    ts = commit_ts if commit_ts is not None else F.lit(None).cast("timestamp_ntz")
    return df.select(
        F.lit(0).cast("bigint").alias("lsn"), F.lit(SNAPSHOT).alias("op"), ts.alias("commit_ts"),
        *df.columns,
    )


def published_codes(publish: str = DEFAULT_PUBLISH) -> list[str]:
    names = [part.strip().lower() for part in publish.split(",") if part.strip()]
    unknown = sorted(set(names) - set(PUBLISH_CODES))
    if unknown or not names:
        raise ValueError(f"publish must name some of {sorted(PUBLISH_CODES)}, got {publish!r}")
    return [PUBLISH_CODES[name] for name in names]


def publish_filter(log: DataFrame, publish: str = DEFAULT_PUBLISH) -> DataFrame:
    """Only the published kinds of change; snapshot rows always pass."""
    return log.filter(F.col("op").isin(*published_codes(publish), SNAPSHOT))


def include_columns(df: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Key, change metadata and the chosen columns; the rest is pruned from the scan."""
    meta = [c for c in ("lsn", "op", "commit_ts", "tx_id", LSN, DELETED_AT) if c in df.columns]
    wanted = [*meta, *as_key(key), *columns]
    return df.select(*dict.fromkeys(wanted))


def column_hints(df: DataFrame, hints: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Override column types, ``{column: {"data_type": type}}``; bad values become NULL."""
    return df.withColumns(
        {name: F.col(name).try_cast(hint["data_type"]) for name, hint in hints.items()}
    )


def demux(log: DataFrame, tables: Sequence[str]) -> dict[str, DataFrame]:
    """One frame per table of a shared change log."""
    return {table: log.filter(F.col("table_name") == table) for table in tables}


def snapshot_plus_stream(initial: DataFrame, log: DataFrame) -> DataFrame:
    """The initial copy followed by the logged changes, columns matched by name."""
    return initial.unionByName(log, allowMissingColumns=True)


def latest_changes(log: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The last change per key as a target row: ``_lsn`` is its position, and a delete
    carries its commit time in ``_deleted_at``."""
    latest = dedup_latest(log, key, ["lsn"])
    deleted = F.when(F.col("op") == DELETE, F.col("commit_ts"))
    drop = [c for c in ("lsn", "op", "commit_ts", "tx_id", "table_name") if c in log.columns]
    return latest.withColumns({LSN: F.col("lsn"), DELETED_AT: deleted}).drop(*drop)


def apply_changes(
    base: DataFrame, latest: DataFrame, key: str | Sequence[str], small_changes: bool = False
) -> DataFrame:
    """Target rows after the changes; both sides hold one row per key. A change that is not
    newer than the stored row is ignored, so replays and late duplicates change nothing.

    With ``small_changes`` (size checked by the caller) the changes' keys are broadcast and
    the base is not shuffled. Otherwise each side is read once and they meet in one join.
    """
    columns = as_key(key)
    if not small_changes:
        new = {c: F.col(f"__new_{c}") for c in latest.columns}
        renamed = latest.select(*[F.col(c).alias(f"__new_{c}") for c in latest.columns])
        same = [F.col(k) == new[k] for k in columns]
        newer = new[LSN].isNotNull() & (F.col(LSN).isNull() | (new[LSN] > F.col(LSN)))
        names = list(dict.fromkeys([*base.columns, *latest.columns]))
        absent = F.lit(None)
        return base.join(renamed, same, "full").select(
            *[
                F.when(newer, new.get(c, absent))
                .otherwise(F.col(c) if c in base.columns else absent).alias(c)
                for c in names
            ]
        )
    keys = F.broadcast(latest.select(*columns, F.col(LSN).alias("__incoming")))
    kept = (
        base.join(keys, columns, "left")
        .filter(F.col("__incoming").isNull() | (F.col("__incoming") > F.col(LSN)).eqNullSafe(False))
        .drop("__incoming")
    )
    stale = (
        base.select(*columns, LSN).join(keys, columns)
        .filter(F.col("__incoming") <= F.col(LSN)).select(*columns)
    )
    fresh = latest.join(F.broadcast(stale), columns, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def live_rows(df: DataFrame) -> DataFrame:
    """Rows that are not flagged as deleted."""
    return df.filter(F.col(DELETED_AT).isNull())


def erase_deleted(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Hard delete: only key, position and time of a deleted row are kept, as the guard that
    stops an older change from bringing it back. ``live_rows`` hides these rows."""
    keep = {*as_key(key), LSN, DELETED_AT}
    gone = F.col(DELETED_AT).isNotNull()
    return df.select(
        *[c if c in keep else F.when(~gone, F.col(c)).alias(c) for c in df.columns]
    )


def target_rows(log: DataFrame, key: str | Sequence[str], delete_mode: str = "soft") -> DataFrame:
    """What a batch of changes asks of the target: flagged deletes, or erased ones."""
    if delete_mode not in ("soft", "hard"):
        raise ValueError(f"delete_mode must be 'soft' or 'hard', got {delete_mode!r}")
    latest = latest_changes(log, key)
    return erase_deleted(latest, key) if delete_mode == "hard" else latest


def tx_batches(
    log: DataFrame, target_batch_size: int = 1000, slice_width: int = 1 << 24
) -> DataFrame:
    """One row per transaction with its batch: batches close once they hold the target size,
    and a transaction is never split, so a batch may exceed the size by its last transaction.

    Transactions follow their commit position (highest ``lsn``). Counting per transaction
    combines on the map side; the running total then runs per slice of the log. Positions are
    unique, so a slice holds at most ``slice_width`` transactions, and only the slice totals
    are summed up in one place.
    """
    txs = (
        log.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("lsn").alias("commit_lsn"))
        .withColumn("__slice", F.expr(f"commit_lsn div {int(slice_width)}"))
    )
    running = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        txs.groupBy("__slice").agg(F.sum("n_rows").alias("__n"))
        .select("__slice", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__offset"))
    )
    within = Window.partitionBy("__slice").orderBy("commit_lsn")
    before = F.sum("n_rows").over(within) - F.col("n_rows") + F.col("__offset")
    return txs.join(offsets, "__slice").select(
        "tx_id", "commit_lsn", "n_rows",
        F.floor(before / F.lit(target_batch_size)).cast("bigint").alias("batch_id"),
    )


def transaction_cuts(
    log: DataFrame, target_batch_size: int = 1000, slice_width: int = 1 << 24
) -> DataFrame:
    """Positions (``end_lsn``) after which a log may be cut without splitting a transaction.

    Transactions whose positions overlap stay together; a batch takes those that begin within its
    share of ``target_batch_size`` rows, so it exceeds the size by its last such group at most. A
    change without a transaction is one of its own. The last cut is the end of the log.

    Counting per transaction combines on the map side; running totals and the furthest position
    so far then run per slice of the log, as in ``tx_batches``.
    """
    alone = F.when(F.col("tx_id").isNull(), F.col("lsn"))
    txs = (
        log.groupBy("tx_id", alone.alias("__alone"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("lsn").alias("lo"), F.max("lsn").alias("hi"))
        .withColumn("__slice", F.expr(f"lo div {int(slice_width)}"))
    )
    ahead = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        txs.groupBy("__slice").agg(F.sum("n_rows").alias("__n"), F.max("hi").alias("__hi"))
        .select(
            "__slice", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__rows"),
            F.max("__hi").over(ahead).alias("__reach"),
        )
    )
    within = Window.partitionBy("__slice").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max("hi").over(within), F.col("__reach"))  # skips nulls
    before = F.coalesce(F.sum("n_rows").over(within), F.lit(0)) + F.col("__rows")
    starts = (
        txs.join(earlier, "__slice").select("lo", reach.alias("reach"), before.alias("before"))
        .filter(F.col("reach").isNull() | (F.col("lo") > F.col("reach")))
    )
    # What lies before the first group of a batch ends the batch before it.
    inner = starts.groupBy(F.floor(F.col("before") / target_batch_size).alias("batch")).agg(
        F.min("reach").alias("end_lsn"), F.count_if(F.col("reach").isNull()).alias("first")
    )
    last = txs.agg(F.max("hi").alias("end_lsn"))
    cuts = inner.filter(F.col("first") == 0).select("end_lsn").unionByName(last)
    return cuts.filter(F.col("end_lsn").isNotNull())


def replication_lag(
    slots: DataFrame, positions: DataFrame, max_lag: int = 64 * 1024 * 1024
) -> DataFrame:
    """Distance of every slot's confirmed position from the end of its log.

    ``slots(slot_name)`` are the expected ones and ``positions(slot_name, current_lsn,
    confirmed_lsn)`` what the source reports; a slot without a position stays in the result
    with ``found = false``. A lag equal to the budget is still fine.
    """
    lag = F.col("current_lsn") - F.col("confirmed_lsn")
    return slots.join(positions, "slot_name", "left").select(
        "slot_name",
        F.col("confirmed_lsn").isNotNull().alias("found"),
        lag.alias("lag"),
        F.coalesce(lag <= max_lag, F.lit(False)).alias("ok"),
    )


def check_slots(lags: DataFrame) -> None:
    """A missing slot cannot heal by waiting, so it is an error rather than a failed check."""
    missing = [r.slot_name for r in lags.filter(~F.col("found")).select("slot_name").take(20)]
    if missing:
        raise LookupError(f"replication slot not found: {', '.join(sorted(missing))}")

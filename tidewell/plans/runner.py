"""Run a spec: source tables through the sync mode into the target, with audit and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import backfill, changes, normalize
from tidewell.operators.incremental import (
    limit_by_cursor,
    check_cursor,
    drop_loaded,
    incremental_filter,
    lag_seconds,
    limit_rows,
)
from tidewell.operators.merge import dedup_latest
from tidewell.operators.quality import (
    check_counts,
    live_only,
    reconcile_counts,
    reconcile_same_engine,
)
from tidewell.session import use_utc
from tidewell.sinks import storage
from tidewell.sinks.dataset import Dataset, masked_error, total_order
from tidewell.sinks.jdbc import JdbcTarget
from tidewell.sinks.partitions import PartitionTarget
from tidewell.sources import changelog, registry
from tidewell.sources.registry import Connections
from tidewell.spec import PipelineSpec

# Which destination types are written how.
PARQUET_DESTINATIONS = ("duckdb",)
JDBC_DESTINATIONS = ("postgres", "snowflake")

Target = Dataset | JdbcTarget | PartitionTarget


def target_of(
    spark: SparkSession, spec: PipelineSpec, root: str, connections: Connections
) -> Target:
    destination = spec.destination
    if destination.type in PARQUET_DESTINATIONS:
        audit = Dataset(spark, root, destination.dataset)
        options = spec.options
        if options.partition_field is None:
            return audit
        return PartitionTarget(
            spark, f"{root.rstrip('/')}/{destination.dataset}", audit, field=options.partition_field,
            unit=options.partition_unit, fixed=options.partition_fixed,
        )
    if destination.type in JDBC_DESTINATIONS:
        if destination.connection not in connections:
            raise ValueError(f"pass connections entry {destination.connection!r} with its JDBC url")
        return JdbcTarget(
            spark, connections[destination.connection], destination.dataset,
            audit=Dataset(spark, root, destination.dataset),
        )
    raise NotImplementedError(
        f"destination type {destination.type!r} is not in use; "
        "write to a catalog table with merge_into_catalog or writeTo"
    )


def _order(df: DataFrame, spec: PipelineSpec) -> list[str]:
    return spec.sync.key or df.columns


def _incremental(
    df: DataFrame, spec: PipelineSpec, target: Target, table: str, last: str | None
) -> DataFrame:
    """New rows since the stored cursor; an appending load leaves out what it already has."""
    sync = spec.sync
    lag = lag_seconds(sync.tolerance_seconds, sync.lookback)
    fresh = incremental_filter(df, sync.cursor_field, last, lag, keep_null=True)
    if last is None or spec.disposition != "append":
        return fresh
    again = incremental_filter(target.read(table), sync.cursor_field, last, lag, keep_null=True)
    flat = [c for c in df.columns if c not in normalize.arrays_of(df) and c in again.columns]
    columns = [*sync.key, sync.cursor_field] if sync.key else flat
    return drop_loaded(fresh, again, list(dict.fromkeys(columns)))


def _load_changes(
    spark: SparkSession, spec: PipelineSpec, target: Target,
    connections: Connections, tables: Mapping[str, DataFrame],
) -> list[dict[str, Any]]:
    """Snapshot on the first run or after a reset, then the changes behind the last position."""
    config = changelog.LogConfig.of(spec.source, connections)
    copies = changelog.snapshots(spark, config)
    # What replaces a table must hold all of it: the copy and the whole log.
    anew = config.reset or spec.disposition == "replace"
    done = []
    for table, log in tables.items():
        last = None if anew else target.cursor(table)
        log = changelog.shape(log, table, spec.sync.key, config)
        if last is not None:
            log = log.filter(F.col("lsn") > F.lit(int(last)))
        elif table in copies:
            log = changes.snapshot_plus_stream(
                changelog.shape(copies[table], table, spec.sync.key, config), log
            )
        done.append(
            target.apply(
                table, log, spec.sync.key, contract=spec.options.schema_contract,
                delete_mode=spec.options.delete_mode, pipeline=spec.name, reset=anew,
                move_cursor=config.flush,
            )
        )
    return done


def _load_tables(
    spec: PipelineSpec, target: Target, tables: Mapping[str, DataFrame],
    limit: int | None, parallel: int,
) -> list[dict[str, Any]]:
    sync = spec.sync
    tables = {table: normalize.flatten_struct(df) for table, df in tables.items()}
    if sync.cursor_field is not None:
        check_cursor(tables, sync.cursor_field)

    def load(item: tuple[str, DataFrame]) -> list[dict[str, Any]]:
        table, df = item
        if sync.mode == "incremental":
            last = target.cursor(table)
            df = _incremental(df, spec, target, table, last)
            if limit is not None:  # the cursor moves, so rows are taken in its order
                df = limit_by_cursor(df, limit, sync.cursor_field, last)
        elif limit is not None:
            df = limit_rows(df, limit, _order(df, spec))
        return _store(target, table, df, spec, sync.cursor_field)

    # Tables have their own commits, so their jobs may share the cluster.
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return [row for rows in pool.map(load, tables.items()) for row in rows]


def _store(
    target: Target, table: str, df: DataFrame, spec: PipelineSpec,
    cursor: str | None, **facts: Any,
) -> list[dict[str, Any]]:
    """Write a table, and its arrays as child tables of their own."""
    key, merging = spec.sync.key, spec.disposition == "merge"
    common = {"contract": spec.options.schema_contract, "pipeline": spec.name}
    if merging and normalize.arrays_of(df):
        # Children must come from the row that wins, so it is chosen before they are split off.
        df = dedup_latest(df, key, total_order(df, [cursor] if cursor else []))
    flat, children = normalize.split_nested(table, df, key, keep_empty=merging)
    # Children go first: the parent's commit moves the cursor, so a run that dies between
    # them reads the parents again.
    done = []
    for name, child in children.items():
        if merging:
            done.append(target.load_children(name, child, **common))
        else:
            done.append(target.load(name, child.rows, spec.disposition, **common))
    done.append(target.load(table, flat, spec.disposition, key=key, cursor=cursor, **common, **facts))
    return done


def run(
    spark: SparkSession, spec: PipelineSpec, root: str, connections: Connections | None = None,
    limit: int | None = None, parallel: int = 4,
) -> DataFrame:
    """Load every table of the spec once; returns the audit rows of this run.

    A failure is recorded beside the audit rows, with credentials masked, and raised.
    """
    use_utc(spark)
    connections = connections or {}
    target = target_of(spark, spec, root, connections)
    try:
        return _run(spark, spec, target, connections, limit, parallel)
    except Exception as error:
        audit = target if isinstance(target, Dataset) else target.audit
        audit.record_failure("_", spec.name, repr(error))
        raise


def _run(
    spark: SparkSession, spec: PipelineSpec, target: Target,
    connections: Connections, limit: int | None, parallel: int,
) -> DataFrame:
    tables = registry.build(spark, spec.source, connections)
    if spec.sync.mode == "cdc":
        done = _load_changes(spark, spec, target, connections, tables)
    else:
        done = _load_tables(spec, target, tables, limit, parallel)
    if spec.quality.row_count_check and limit is None:
        check_counts(reconcile(spark, spec, target, connections))
    return target.loads_of(done)


def reconcile(
    spark: SparkSession, spec: PipelineSpec, target: Target, connections: Connections
) -> DataFrame:
    """Source against target per table: two counts, or one verdict of an engine that reaches
    both sides where the spec says ``same_cluster``."""
    source = registry.build(spark, spec.source, connections)
    if spec.sync.mode == "cdc":
        config = changelog.LogConfig.of(spec.source, connections)
        copies = changelog.snapshots(spark, config)
        source = {
            table: changes.live_rows(
                changes.latest_changes(
                    changes.snapshot_plus_stream(copies[table], log) if table in copies else log,
                    spec.sync.key,
                )
            )
            for table, log in source.items()
        }
    landed = {table: target.read(table) for table in source}
    if spec.quality.check_mode == "cross_cluster":
        return reconcile_counts(source, landed)
    verdicts = [
        reconcile_same_engine(spark, source[table], live_only(landed[table])).select(
            F.lit(table).alias("table_name"), "ok"
        )
        for table in source
    ]
    return reduce(DataFrame.unionByName, verdicts)


def dry_run(
    spark: SparkSession, spec: PipelineSpec, connections: Connections | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Read and shape, write nothing: rows ``(table_name, n_rows, columns)``."""
    use_utc(spark)
    shaped: dict[str, DataFrame] = {}
    for table, df in registry.build(spark, spec.source, connections or {}).items():
        if limit is not None:
            df = limit_rows(df, limit, _order(df, spec))
        flat, children = normalize.split_nested(table, df, spec.sync.key)
        shaped[table] = flat
        shaped.update({name: child.rows for name, child in children.items()})
    return describe_tables(shaped)


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = []
    for table, df in tables.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(table).alias("table_name"), "n_rows", F.lit(columns).alias("columns")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def run_backfill(
    spark: SparkSession, spec: PipelineSpec, start: datetime, end: datetime, root: str,
    connections: Connections | None = None,
) -> DataFrame:
    """Load the chunks of ``[start, end)`` that no earlier run has finished, whatever bounds and
    chunk size it had.

    A table is read once, for all its open chunks, written once, and committed once: all of them
    are loaded or none. The stored cursor is left alone, and so is any lag. Bounds must name their
    time zone. Rows without a cursor value belong to no chunk; they are counted as ``n_skipped``.

    Returns a row per loaded chunk: table_name, load_id, pipeline, n_skipped (of its load),
    chunk_start, chunk_end and n_rows (null where the target does not tell).
    """
    use_utc(spark)
    for bound in (start, end):
        if bound.tzinfo is None:
            raise ValueError(f"backfill bound {bound} must name its time zone")
    if spec.sync.mode != "incremental":
        raise ValueError(
            f"{spec.name!r} syncs by {spec.sync.mode!r}, but a backfill requires 'incremental'"
        )
    if spec.sync.backfill is None:
        raise ValueError(f"{spec.name!r} has no sync.backfill block to take a chunk size from")
    if spec.disposition == "replace":
        raise ValueError("a backfill cannot replace: every chunk would wipe the one before")
    naive = [b.astimezone(timezone.utc).replace(tzinfo=None) for b in (start, end)]
    chunks = backfill.chunk_bounds(*naive, spec.sync.backfill.chunk_size)
    cursor = spec.sync.backfill.partition_field or spec.sync.cursor_field
    connections = connections or {}
    target = target_of(spark, spec, root, connections)
    built = registry.build(spark, spec.source, connections)
    tables = {table: normalize.flatten_struct(df) for table, df in built.items()}
    check_cursor(tables, cursor)
    all_chunks = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(chunks)], backfill.CHUNK_SCHEMA
    )
    done: list[dict[str, Any]] = []
    for table, df in tables.items():
        todo = backfill.pending_chunks(all_chunks, target.done_chunks(table))
        open_chunks = sorted((c.chunk_start, c.chunk_end) for c in todo.collect())
        if not open_chunks:
            continue
        dtype, skipped = df.schema[cursor].dataType, Observation()
        wanted = backfill.in_ranges(F.col(cursor), dtype, backfill.joined_ranges(open_chunks))
        none = F.col(cursor).isNull()
        # both conditions reach the scan; rows without a value are only counted
        part = df.filter(wanted | none).observe(skipped, F.count_if(none).alias("n_skipped")).filter(wanted)
        done += _store(
            target, table, part, spec, cursor, move_cursor=False, chunks=open_chunks, skipped=skipped,
        )
    loads = target.loads_of(done).filter(F.col("chunks").isNotNull())
    return loads.select("table_name", "load_id", "pipeline", "n_skipped", F.inline("chunks"))


def run_fleet(
    spark: SparkSession, specs: Sequence[Mapping[str, Any]], root: str,
    connections: Connections | None = None, parallel: int = 4,
) -> DataFrame:
    """Run many specs; one that is broken or fails does not stop the others.
    Returns one row per spec: ``(pipeline, status, n_rows, error)``."""

    def attempt(raw: Mapping[str, Any]) -> tuple[str, str, int, str | None]:
        name = str(raw.get("name", "?"))
        try:
            spec = PipelineSpec.from_dict(raw)
            loads = run(spark, spec, root, connections)
            total = loads.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
            return name, "ok", int(total), None
        except Exception as error:  # noqa: BLE001 - any failure becomes a status row
            return name, "failed", 0, repr(error)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        rows = list(pool.map(attempt, specs))
    statuses = spark.createDataFrame(
        rows, "pipeline string, status string, n_rows bigint, error string"
    )
    return statuses.withColumn("error", masked_error(F.col("error")))


def delete_pipeline(
    spark: SparkSession, spec: PipelineSpec, root: str, connections: Connections | None = None,
    keep_data: bool = False, checkpoint: str | None = None,
) -> dict[str, Any]:
    """Remove a pipeline's target and state; with ``keep_data`` only its state.

    Every step runs even if one before it failed, and reports its errors. Repeating is fine.
    """
    target = target_of(spark, spec, root, connections or {})
    steps: list[dict[str, Any]] = []

    def step(name: str, action: Any) -> None:
        try:
            action()
            steps.append({"step": name, "errors": []})
        except Exception as error:  # noqa: BLE001 - reported, not raised
            steps.append({"step": name, "errors": [repr(error)[:500]]})

    if checkpoint is not None:
        step("drop_stream_checkpoint", lambda: storage.remove(spark, checkpoint))
    if not keep_data:
        step("drop_destination_dataset", target.drop)
    else:
        step("drop_state", lambda: [target.reset_state(t) for t in target.tables()])
    failed = any(s["errors"] for s in steps)
    return {"status": "error" if failed else "ok", "name": spec.name, "steps": steps}

"""Change logs: initial snapshots and the stream of changes behind them.

The log is a folder of Parquet files that some decoder writes: ``lsn, tx_id, op, commit_ts,
table_name`` and the row's columns. Snapshots are plain Parquet folders, one per table.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators import changes
from tidewell.sources.registry import Connections, check_keys, register
from tidewell.spec import Source

# Config keys and defaults.
CONFIG_KEYS = frozenset(
    {
        "slot_name", "publication_name", "tables", "schema", "publish", "reset",
        "include_columns", "columns", "target_batch_size", "flush_slot",
    }
)
REQUIRED_KEYS = ("slot_name", "publication_name", "tables")
DEFAULT_BATCH_SIZE = 1000

@dataclass(frozen=True)
class LogConfig:
    """The checked settings of a change-log source.

    A load takes all changes there are, so it never splits a transaction; ``sync_transactions``
    takes them in batches of about ``batch_size``.
    """

    slot: str
    tables: list[str]
    log_path: str
    snapshot_path: str | None
    publish: str
    reset: bool
    include: dict[str, list[str]]
    hints: dict[str, dict[str, dict[str, str]]]
    batch_size: int
    flush: bool

    @classmethod
    def of(cls, source: Source, connections: Connections) -> LogConfig:
        check_keys(source, CONFIG_KEYS, REQUIRED_KEYS)
        place: Any = connections.get(source.connection)
        if not place or "log_path" not in place:
            raise ValueError(
                f"pg_cdc source {source.connection!r}: pass connections entry "
                f"{source.connection!r} with log_path (and snapshot_path)"
            )
        config = source.config
        publish = str(config.get("publish", changes.DEFAULT_PUBLISH))
        changes.published_codes(publish)
        return cls(
            slot=str(config["slot_name"]), tables=[str(t) for t in config["tables"]],
            log_path=place["log_path"], snapshot_path=place.get("snapshot_path"),
            publish=publish, reset=bool(config.get("reset", False)),
            include=dict(config.get("include_columns") or {}),
            hints=dict(config.get("columns") or {}),
            batch_size=int(config.get("target_batch_size", DEFAULT_BATCH_SIZE)),
            flush=bool(config.get("flush_slot", True)),
        )


def shape(log: DataFrame, table: str, key: list[str], config: LogConfig) -> DataFrame:
    """Changes of one table: published kinds, chosen columns, overridden types."""
    df = changes.publish_filter(log, config.publish)
    if table in config.include:
        df = changes.include_columns(df, key, config.include[table])
    if table in config.hints:
        present = {c: h for c, h in config.hints[table].items() if c in df.columns}
        df = changes.column_hints(df, present)
    return df


def snapshots(spark: SparkSession, config: LogConfig) -> dict[str, DataFrame]:
    """The initial copy of every table, tagged so that any logged change outranks it."""
    if config.snapshot_path is None:
        return {}
    return {
        table: changes.snapshot(spark.read.parquet(f"{config.snapshot_path}/{table}"))
        for table in config.tables
    }


@register("pg_cdc")
def build(spark: SparkSession, source: Source, connections: Connections) -> dict[str, DataFrame]:
    """Changes per table from a shared change log."""
    config = LogConfig.of(source, connections)
    log = spark.read.option("mergeSchema", True).parquet(config.log_path)
    return changes.demux(log, config.tables)

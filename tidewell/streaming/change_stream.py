"""Continuous change data capture with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators import changes
from tidewell.session import new_scratch
from tidewell.sinks import storage
from tidewell.sinks.dataset import Dataset
from tidewell.sources.changelog import LogConfig, shape, snapshots


def read_log(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """The change log as a stream; files are taken in the order they appear."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def apply_tables(
    batch: DataFrame, target: Dataset, tables: Sequence[str], key: Sequence[str],
    *, config: LogConfig | None = None, delete_mode: str = "soft", pipeline: str = "",
    contract: str = "evolve",
) -> None:
    """One batch of changes into its tables."""
    # Several tables read the same batch: keep it, on disk where memory is short.
    shared = len(tables) > 1
    if shared:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for table, part in changes.demux(batch, tables).items():
            part = shape(part, table, list(key), config) if config else part
            target.apply(
                table, part, key, contract=contract, delete_mode=delete_mode, pipeline=pipeline
            )
    finally:
        if shared:
            batch.unpersist()


def apply_stream(
    log: DataFrame, target: Dataset, tables: Sequence[str], key: Sequence[str], checkpoint: str,
    *, config: LogConfig | None = None, delete_mode: str = "soft", pipeline: str = "",
    contract: str = "evolve", continuous: bool = False, interval: str = "1 minute",
) -> StreamingQuery:
    """Apply a change stream to its tables.

    The default drains what is there and stops, so that any scheduler can call it; a second
    call finds nothing new. Positions live in the checkpoint, and changes carry their log
    position into the target, so a batch that is replayed after a failure changes nothing.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        apply_tables(
            batch, target, tables, key, config=config, delete_mode=delete_mode, pipeline=pipeline,
            contract=contract,
        )

    writer = log.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def prepare(
    spark: SparkSession, target: Dataset, config: LogConfig, key: Sequence[str], checkpoint: str,
    *, delete_mode: str = "soft", pipeline: str = "", contract: str = "evolve",
) -> None:
    """A reset forgets the positions; tables that are not there yet begin with their copy."""
    if config.reset:  # the log is read anew as well, from a checkpoint that knows nothing
        storage.remove(spark, checkpoint)
    for table, copy in snapshots(spark, config).items():
        if config.reset or target.head(table) is None:
            rows = shape(copy, table, list(key), config)
            target.apply(
                table, rows, key, contract=contract, delete_mode=delete_mode, pipeline=pipeline,
                reset=config.reset,
            )


def sync_changes(
    spark: SparkSession, log_path: str, schema: T.StructType, target: Dataset, config: LogConfig,
    key: Sequence[str], checkpoint: str, *, files_per_batch: int | None = None,
    delete_mode: str = "soft", pipeline: str = "", contract: str = "evolve",
) -> None:
    """Snapshot on the first run, then the stream behind it; returns when drained.

    Snapshot rows carry position 0, so changes that were logged while the copy was taken win
    over it, and a snapshot that is repeated after a failure never overwrites a change. With
    ``flush`` off the changes are applied and the positions stay, so the next call reads them
    again; they change nothing then.
    """
    prepare(
        spark, target, config, key, checkpoint, delete_mode=delete_mode, pipeline=pipeline,
        contract=contract,
    )
    if not config.flush:
        checkpoint = positions_apart(spark, checkpoint)
    log = read_log(spark, log_path, schema, files_per_batch)
    query = apply_stream(
        log, target, config.tables, key, checkpoint, config=config, delete_mode=delete_mode,
        pipeline=pipeline, contract=contract,
    )
    query.awaitTermination()


def positions_apart(spark: SparkSession, checkpoint: str) -> str:
    """A copy of a stream's checkpoint (a few small files) for a query that must not move it."""
    apart = new_scratch(spark, "positions")
    storage.copy(spark, checkpoint, apart)
    return apart


def pending_changes(
    spark: SparkSession, log_path: str, schema: T.StructType, checkpoint: str
) -> DataFrame:
    """Changes behind the positions that a checkpoint has committed, as a batch; all of the log if
    there is no checkpoint yet. The checkpoint stays as it is, so a second call gives the same.

    A stream from a copy of the checkpoint drains them into a folder of its own, which only reads
    the files that the stream itself would read next. Not while that stream is running.
    """
    out = new_scratch(spark, "pending")

    def keep(batch: DataFrame, batch_id: int) -> None:
        # A batch that is tried again replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (
        read_log(spark, log_path, schema).writeStream.foreachBatch(keep)
        .option("checkpointLocation", positions_apart(spark, checkpoint))
        .trigger(availableNow=True).start().awaitTermination()
    )
    if not storage.exists(spark, out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out).select(*schema.fieldNames())


def new_loads(spark: SparkSession, target: Dataset, schema: T.StructType) -> DataFrame:
    """Finished loads as a stream, for jobs that start when a table was loaded."""
    return (
        spark.readStream.schema(schema).option("basePath", f"{target.path}/_loads")
        .parquet(f"{target.path}/_loads").filter(F.col("status") == "ok")
    )

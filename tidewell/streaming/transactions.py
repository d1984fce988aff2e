"""A change log read in batches of whole transactions.

The stream itself carries positions: its offsets are log positions, and every micro-batch is one
row ``(after_lsn, end_lsn)`` whose end falls on a cut between transactions. The changes of that
range are then read by Spark's own reader, which skips what lies outside it.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewell.operators.changes import transaction_cuts
from tidewell.sinks import storage
from tidewell.sinks.dataset import Dataset
from tidewell.sources.changelog import LogConfig
from tidewell.streaming.change_stream import apply_tables, positions_apart, prepare

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = -1  # before any position of a log
CUTS_PER_QUERY = 10_000  # a query's cuts go to the driver; a longer log takes several queries

Handler = Callable[[DataFrame, int, int], None]


class PositionRange(InputPartition):
    def __init__(self, after: int, end: int) -> None:
        self.after = after
        self.end = end


class PositionReader(DataSourceStreamReader):
    """Moves from one cut to the next; a query that is started again stands where it was."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.position = int(options["after"])
        self.cuts: list[int] = json.loads(options["cuts"])

    def initialOffset(self) -> dict[str, int]:
        return {"lsn": self.position}

    def latestOffset(self) -> dict[str, int]:
        return {"lsn": next((cut for cut in self.cuts if cut > self.position), self.position)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> Sequence[PositionRange]:
        self.position = end["lsn"]
        return [PositionRange(start["lsn"], end["lsn"])]

    def read(self, partition: PositionRange) -> Iterator[tuple[int, int]]:
        yield partition.after, partition.end

    def commit(self, end: dict[str, int]) -> None:
        self.position = max(self.position, end["lsn"])


class PositionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_positions"

    def schema(self) -> str:
        return "after_lsn bigint, end_lsn bigint"

    def streamReader(self, schema: Any) -> PositionReader:
        return PositionReader(self.options)


def committed_position(spark: SparkSession, checkpoint: str) -> int:
    """The position that a checkpoint's last finished batch ended at."""
    done = [int(n) for n in storage.child_names(spark, f"{checkpoint}/commits") if n.isdigit()]
    if not done:
        return START
    entry = spark.read.text(f"{checkpoint}/offsets/{max(done)}", wholetext=True).first()[0]
    return int(json.loads(entry.splitlines()[-1])["lsn"])


def drain_transactions(
    spark: SparkSession, log: DataFrame, checkpoint: str, handle: Handler, batch_size: int
) -> int:
    """Hand over all changes behind the committed position, in batches of whole transactions of
    about ``batch_size`` rows (see ``transaction_cuts``); returns the position reached.

    ``log`` is a batch frame with ``lsn`` and ``tx_id``; it must hold transactions whole. The cuts
    take one scan of these two columns. ``handle(changes, after_lsn, end_lsn)`` may see a batch
    again after a failure, with the same bounds. Empty logs hand over nothing.
    """
    spark.dataSource.register(PositionSource)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        for after, end in batch.collect():  # one row
            handle(log.filter((F.col("lsn") > after) & (F.col("lsn") <= end)), after, end)

    while True:
        after = committed_position(spark, checkpoint)
        ahead = transaction_cuts(log.filter(F.col("lsn") > after).select("lsn", "tx_id"), batch_size)
        cuts = [r.end_lsn for r in ahead.orderBy("end_lsn").limit(CUTS_PER_QUERY).collect()]
        if not cuts:
            return after
        positions = (
            spark.readStream.format("log_positions")
            .option("after", str(after)).option("cuts", json.dumps(cuts)).load()
        )
        # Not ``availableNow``, which would take all cuts as one batch.
        query = (
            positions.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .start()
        )
        try:
            query.processAllAvailable()
        finally:
            query.stop()


def sync_transactions(
    spark: SparkSession, log_path: str, schema: T.StructType, target: Dataset, config: LogConfig,
    key: Sequence[str], checkpoint: str, *, delete_mode: str = "soft", pipeline: str = "",
    contract: str = "evolve",
) -> None:
    """``sync_changes`` in batches of whole transactions: readers of several tables see all of a
    transaction's changes once a batch is done, and never wait for more than
    ``target_batch_size`` rows and what belongs to them. Each batch is read once for all tables.
    """
    prepare(
        spark, target, config, key, checkpoint, delete_mode=delete_mode, pipeline=pipeline,
        contract=contract,
    )
    if not config.flush:
        checkpoint = positions_apart(spark, checkpoint)

    def apply(part: DataFrame, after: int, end: int) -> None:
        apply_tables(
            part, target, config.tables, key, config=config, delete_mode=delete_mode,
            pipeline=pipeline, contract=contract,
        )

    log = spark.read.schema(schema).parquet(log_path)
    drain_transactions(spark, log, checkpoint, apply, config.batch_size)

"""Target tables partitioned by date, brought up to date by dynamic partition overwrite.

    <root>/<dataset>/<table>/_part=<2024-05>/...     the rows of one month

Spark's own partition overwrite does the rewriting: a merge reads and writes only partitions that
its rows fall in, or that hold an older row of one of its keys. Rows come first and the audit row
last, and a load that is repeated after a failure between them changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import contracts
from tidewell.operators.backfill import Range
from tidewell.operators.changes import LSN, apply_changes, live_rows, target_rows
from tidewell.operators.merge import as_key, dedup_latest, merge_upsert, replace_children
from tidewell.operators.normalize import Child
from tidewell.operators.quality import load_metrics
from tidewell.session import new_scratch
from tidewell.sinks import storage
from tidewell.sinks.dataset import NO_ROWS, Dataset, NullKeys, count_chunks, observed, readable_as, total_order

PART = "_part"
# The partition of rows without a date.
NO_DATE = "none"
UNITS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}
# Partitions that a load of a table may touch; their names pass through the driver.
MAX_PARTS = 100_000


class PartitionTarget:
    """The tables of one dataset, all laid out by the date ``field``. Tables without that column
    (children among them) have the one partition ``none``.

    Unless it is ``fixed``, a key's date may change. A merge then looks up where its keys are
    stored now, which reads the key columns of the whole table, and moves them.
    """

    def __init__(
        self, spark: SparkSession, path: str, audit: Dataset, *, field: str, unit: str = "month",
        fixed: bool = False,
    ) -> None:
        self.spark = spark
        self.path = path
        self.audit = audit
        self.field = field
        self.pattern = UNITS[unit]
        self.fixed = fixed

    # -- state, kept in the audit table -------------------------------------------------

    def loads(self) -> DataFrame:
        return self.audit.loads()

    def loads_of(self, done: Sequence[dict[str, Any]]) -> DataFrame:
        return self.audit.loads_of(done)

    def cursor(self, table: str) -> str | None:
        return self.audit.cursor(table)

    def done_chunks(self, table: str) -> DataFrame:
        return self.audit.done_chunks(table)

    def tables(self) -> list[str]:
        return self.audit.tables()

    def reset_state(self, table: str) -> None:
        self.audit.reset_state(table)

    def drop(self) -> bool:
        return storage.remove(self.spark, self.path)

    # -- rows -----------------------------------------------------------------------------

    def _folder(self, table: str) -> str:
        return f"{self.path}/{table}"

    def part_of(self, df: DataFrame) -> Column:
        """The partition of a row, as text."""
        if self.field not in df.columns:
            return F.lit(NO_DATE)
        return F.coalesce(F.date_format(F.col(self.field), self.pattern), F.lit(NO_DATE))

    def _stored(self, table: str, schema: T.StructType) -> DataFrame:
        """Rows with their partition; no rows if there are none yet."""
        with_part = T.StructType([*schema.fields, T.StructField(PART, T.StringType())])
        if not storage.exists(self.spark, self._folder(table)):
            return self.spark.createDataFrame([], with_part)
        return self.spark.read.schema(with_part).parquet(self._folder(table))

    def read(self, table: str, live_only: bool = False) -> DataFrame:
        head = self.audit.head(table)
        if head is None:
            raise LookupError(f"no table {table!r} in {self.path}")
        df = self._stored(table, head.schema).drop(PART)
        return live_rows(df) if live_only else df

    def _put(self, df: DataFrame, folder: str, mode: str, metrics: Sequence[Column]) -> dict[str, Any]:
        """Write rows by partition; what was seen on the way. Large partitions are split over
        tasks and small ones share one."""
        seen = Observation()
        placed = df.withColumn(PART, self.part_of(df)).observe(
            seen, *metrics, F.collect_set(PART).alias("parts")
        )
        (
            placed.hint("rebalance", F.col(PART)).write.mode(mode)
            .option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(folder)
        )
        return {**NO_ROWS, "parts": [], **observed(seen)}

    def _drop_parts(self, table: str, parts: Sequence[str]) -> None:
        for part in parts:
            storage.remove(self.spark, f"{self._folder(table)}/{PART}={part}")

    def _held(self, table: str, schema: T.StructType) -> list[str]:
        """Names of the partitions that are stored."""
        names = storage.child_names(self.spark, self._folder(table))
        return [n.split("=", 1)[1] for n in names if n.startswith(f"{PART}=")]

    # -- loads ----------------------------------------------------------------------------

    def load(
        self, table: str, df: DataFrame, disposition: str, *, key: str | Sequence[str] = (),
        cursor: str | None = None, contract: str = contracts.EVOLVE, pipeline: str = "",
        move_cursor: bool = True, chunks: Sequence[Range] | None = None,
        skipped: Observation | None = None,
    ) -> dict[str, Any]:
        """Write rows by disposition, then commit the audit row.

        An appending load that fails between the two and is repeated may store its rows twice.
        """
        key = as_key(key) if key else []
        combine = None
        if disposition == "merge":
            if not key:
                raise ValueError(f"merge into {table!r} needs a primary key")
            df = dedup_latest(df, key, total_order(df, [cursor] if cursor else []))
            combine = lambda base, delta: merge_upsert(base, delta, key)
        return self._store(
            table, df, disposition, combine, key, cursor, contract, pipeline, move_cursor, chunks, skipped
        )

    def load_children(
        self, table: str, child: Child, *, contract: str = contracts.EVOLVE, pipeline: str = "",
    ) -> dict[str, Any]:
        """Merge a table of array elements: parents in the batch get exactly its elements."""
        pos = child.positions[-1]
        return self._store(
            table, child.rows, "merge",
            lambda base, delta: replace_children(base, delta, child.parent_key, pos),
            child.parent_key, None, contract, pipeline, False,
        )

    def apply(
        self, table: str, log: DataFrame, key: str | Sequence[str], *, delete_mode: str = "soft",
        contract: str = contracts.EVOLVE, pipeline: str = "", reset: bool = False,
        move_cursor: bool = True,
    ) -> dict[str, Any]:
        """Bring a table up to date with changes; ``reset`` starts it anew from them."""
        columns = as_key(key)
        latest = target_rows(log, columns, delete_mode)
        return self._store(
            table, latest, "replace" if reset else "merge",
            lambda base, delta: apply_changes(base, delta, columns, False),
            columns, LSN, contract, pipeline, move_cursor,
        )

    def _store(
        self, table: str, df: DataFrame, disposition: str,
        combine: Callable[[DataFrame, DataFrame], DataFrame] | None, key: list[str],
        cursor: str | None, contract: str, pipeline: str, move_cursor: bool,
        chunks: Sequence[Range] | None = None, skipped: Observation | None = None,
    ) -> dict[str, Any]:
        started = datetime.now(timezone.utc)
        head = self.audit.head(table)
        df, schema, added, rejected = self.audit.agree(df, head, contract)
        # Staged once: its size, keys and partitions are known before anything is rewritten, and
        # the source is read once even where it is the table itself.
        staging = new_scratch(self.spark, f"load-{table}")
        facts = load_metrics(df, cursor if cursor in df.columns else None, key)
        metrics = self._put(df, staging, "errorifexists", facts)
        delta = self._read_back(staging, schema, bool(metrics["n_rows"]))
        try:
            if disposition == "merge" and metrics["null_keys"]:
                raise NullKeys(f"{metrics['null_keys']} rows of {table!r} have a NULL in {key}")
            counted = None
            if chunks is not None:
                counted = count_chunks(delta if metrics["n_rows"] else None, cursor, chunks)
            self._place(table, head.schema if head else None, schema, delta, disposition, combine, key, metrics["parts"])
        finally:
            storage.remove(self.spark, staging)
        return self.audit.commit_external(
            table, disposition, metrics, schema, cursor=cursor, added=added, rejected=rejected,
            pipeline=pipeline, move_cursor=move_cursor, started=started, chunks=counted, skipped=skipped,
        )

    def _read_back(self, folder: str, schema: T.StructType, any_rows: bool) -> DataFrame:
        if not any_rows:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def _place(
        self, table: str, old: T.StructType | None, schema: T.StructType, delta: DataFrame,
        disposition: str, combine: Callable[[DataFrame, DataFrame], DataFrame] | None,
        key: list[str], parts: Sequence[str],
    ) -> None:
        """Bring the staged rows into the table's partitions."""
        folder, held = self._folder(table), self._held(table, schema)
        if not parts and disposition == "replace":
            self._drop_parts(table, held)
            return
        if old is not None and not all(readable_as(f.dataType, schema[f.name].dataType) for f in old):
            # another type: all partitions are rewritten, those of the delta included
            base = contracts.conform(self._stored(table, old).drop(PART), schema)
            touched = sorted({*held, *parts})
        elif not parts:
            return
        elif disposition == "append":
            self._put(delta, folder, "append", ())
            return
        elif disposition == "merge":
            touched = self._touched(table, schema, delta, key, parts, held)
            base = self._stored(table, schema).filter(F.col(PART).isin(touched)).drop(PART)
        else:
            touched, base = sorted({*held, *parts}), None
        if disposition == "replace" or base is None:
            whole = delta
        else:
            whole = combine(base, delta) if combine else base.unionByName(delta)
        written = self._put(whole, folder, "overwrite", ())["parts"] if touched else []
        # a partition whose last row went is not overwritten by any
        self._drop_parts(table, [p for p in touched if p in held and p not in set(written)])

    def _touched(
        self, table: str, schema: T.StructType, delta: DataFrame, key: list[str],
        parts: Sequence[str], held: Sequence[str],
    ) -> list[str]:
        """The partitions of the delta's rows, and those that hold its keys now."""
        found = set(parts)
        if not self.fixed and held:
            stored = self._stored(table, schema).select(*key, PART)
            now = stored.join(delta.select(*key).distinct(), key, "left_semi").select(PART).distinct()
            found |= {row[PART] for row in now.limit(MAX_PARTS + 1).collect()}
        if len(found) > MAX_PARTS:
            raise ValueError(f"{table!r}: a load of over {MAX_PARTS} partitions; choose a longer unit")
        return sorted(found)

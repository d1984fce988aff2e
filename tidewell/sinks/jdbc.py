"""SQL databases as targets: append, replace, and merge through a staging table.

Rows are written by Spark's JDBC writer; the merge itself is one MERGE statement that the
database runs, so it is atomic there and keys never pass through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from tidewell.operators import contracts
from tidewell.operators.backfill import Range
from tidewell.operators.changes import LSN, target_rows
from tidewell.operators.merge import as_key, dedup_latest
from tidewell.operators.normalize import Child
from tidewell.operators.quality import load_metrics
from tidewell.sinks.dataset import NO_ROWS, Dataset, NullKeys, count_chunks, observed, total_order

# SQL names of Spark types; every other type is stored as text.
SQL_TYPES = {
    "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "float": "REAL", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP",
}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def merge_statement(
    target: str, staging: str, columns: Sequence[str], key: Sequence[str],
    newer: str | None = None,
) -> str:
    """Standard MERGE: update the rows that match by key and insert the others. With
    ``newer``, only rows whose value in that column is above the stored one are updated."""
    on = " AND ".join(f"t.{quoted(k)} = s.{quoted(k)}" for k in key)
    rest = [c for c in columns if c not in key]
    updates = ", ".join(f"{quoted(c)} = s.{quoted(c)}" for c in rest)
    names = ", ".join(quoted(c) for c in columns)
    values = ", ".join(f"s.{quoted(c)}" for c in columns)
    guard = f" AND (t.{quoted(newer)} IS NULL OR s.{quoted(newer)} > t.{quoted(newer)})" if newer else ""
    matched = f" WHEN MATCHED{guard} THEN UPDATE SET {updates}" if updates else ""
    return (
        f"MERGE INTO {target} t USING {staging} s ON ({on}){matched}"
        f" WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
    )


def execute(spark: SparkSession, connection: Mapping[str, Any], *statements: str) -> None:
    """Run statements in one transaction over the driver's own JDBC connection."""
    properties = spark._jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in connection:
            properties.setProperty(name, str(connection[name]))
    if "driver" in connection:
        spark._jvm.java.lang.Class.forName(connection["driver"])
    handle = spark._jvm.java.sql.DriverManager.getConnection(connection["url"], properties)
    try:
        handle.setAutoCommit(False)
        for statement in statements:
            handle.createStatement().execute(statement)
        handle.commit()
    finally:
        handle.close()


def add_column_statement(table: str, column: T.StructField) -> str:
    dtype = column.dataType
    if isinstance(dtype, T.DecimalType):
        kind = f"DECIMAL({dtype.precision},{dtype.scale})"
    else:
        kind = SQL_TYPES.get(dtype.simpleString(), "TEXT")
    return f"ALTER TABLE {table} ADD COLUMN {quoted(column.name)} {kind}"


class JdbcTarget:
    """Tables of one schema in a SQL database. Audit rows and cursors are kept in ``audit``."""

    def __init__(
        self, spark: SparkSession, connection: Mapping[str, Any], schema: str, audit: Dataset
    ) -> None:
        self.spark = spark
        self.connection = {str(k): str(v) for k, v in connection.items()}
        self.schema = schema
        self.audit = audit

    def table(self, name: str) -> str:
        return f"{quoted(self.schema)}.{quoted(name)}"

    def loads(self) -> DataFrame:
        return self.audit.loads()

    def loads_of(self, done: Sequence[Mapping[str, Any]]) -> DataFrame:
        return self.audit.loads_of(done)

    def cursor(self, name: str) -> str | None:
        return self.audit.cursor(name)

    def done_chunks(self, name: str) -> DataFrame:
        return self.audit.done_chunks(name)

    def read(self, name: str) -> DataFrame:
        return (
            self.spark.read.format("jdbc").options(**self.connection)
            .option("dbtable", self.table(name)).load()
        )

    def _execute(self, *statements: str) -> None:
        execute(self.spark, self.connection, *statements)

    def _write(self, df: DataFrame, table: str, mode: str) -> None:
        # A replaced table is emptied, not dropped, so that grants and indexes stay.
        (
            df.write.format("jdbc").options(**self.connection).option("dbtable", table)
            .option("truncate", True).mode(mode).save()
        )

    def load(
        self, name: str, df: DataFrame, disposition: str, *, key: str | Sequence[str] = (),
        cursor: str | None = None, contract: str = contracts.EVOLVE, pipeline: str = "",
        move_cursor: bool = True, chunks: Sequence[Range] | None = None,
        skipped: Observation | None = None,
    ) -> dict[str, Any]:
        """Write rows by disposition, then commit the audit row.

        Rows and audit row are two commits. A merge that is repeated after a failure between
        them changes nothing; an append may store its rows twice.
        """
        started = datetime.now(timezone.utc)
        key = as_key(key) if key else []
        head = self.audit.head(name)
        df, schema, added, rejected = self.audit.agree(df, head, contract)
        self._add_columns(name, schema, added)
        if disposition == "merge":
            latest = dedup_latest(df, key, total_order(df, [cursor] if cursor else []))
            metrics = self._merge(name, latest, key, cursor, create=head is None)
        else:
            metrics = self._put(name, df, disposition, key, cursor)
        return self.audit.commit_external(
            name, disposition, metrics, schema, cursor=cursor, added=added, rejected=rejected,
            pipeline=pipeline, move_cursor=move_cursor, started=started, skipped=skipped,
            chunks=None if chunks is None else count_chunks(None, cursor, chunks, counted=False),
        )

    def apply(
        self, name: str, log: DataFrame, key: str | Sequence[str], *, delete_mode: str = "soft",
        contract: str = contracts.EVOLVE, pipeline: str = "", reset: bool = False,
        move_cursor: bool = True,
    ) -> dict[str, Any]:
        """Bring a table up to date with changes; the database compares log positions, so a
        change that is not newer than the stored row is ignored."""
        started = datetime.now(timezone.utc)
        columns = as_key(key)
        head = self.audit.head(name)
        latest = target_rows(log, columns, delete_mode)
        latest, schema, added, rejected = self.audit.agree(latest, head, contract)
        if reset:
            metrics = self._put(name, latest, "replace", columns, LSN)
        else:
            self._add_columns(name, schema, added)
            metrics = self._merge(name, latest, columns, LSN, create=head is None, newer=LSN)
        return self.audit.commit_external(
            name, "replace" if reset else "merge", metrics, schema, cursor=LSN, added=added,
            rejected=rejected, pipeline=pipeline, move_cursor=move_cursor, started=started,
        )

    def load_children(
        self, name: str, child: Child, *, contract: str = contracts.EVOLVE, pipeline: str = "",
    ) -> dict[str, Any]:
        """Replace the array elements of the batch's parents, in one transaction."""
        started = datetime.now(timezone.utc)
        head = self.audit.head(name)
        df, schema, added, rejected = self.audit.agree(child.rows, head, contract)
        self._add_columns(name, schema, added)
        metrics = self._merge(
            name, df, child.parent_key, None, create=head is None,
            statements=lambda staging: children_statements(
                self.table(name), staging, df.columns, child.parent_key, child.positions[-1]
            ),
        )
        return self.audit.commit_external(
            name, "merge", metrics, schema, cursor=None, added=added, rejected=rejected,
            pipeline=pipeline, move_cursor=False, started=started,
        )

    def _add_columns(self, name: str, schema: T.StructType, added: Sequence[str]) -> None:
        if added:
            self._execute(*[add_column_statement(self.table(name), schema[c]) for c in added])

    def _put(
        self, name: str, df: DataFrame, disposition: str, key: Sequence[str], cursor: str | None
    ) -> dict[str, Any]:
        seen = Observation()
        watched = df.observe(seen, *load_metrics(df, cursor, list(key)))
        self._write(watched, self.table(name), "overwrite" if disposition == "replace" else "append")
        return {**NO_ROWS, **observed(seen)}

    def _merge(
        self, name: str, latest: DataFrame, key: list[str], cursor: str | None, *,
        create: bool, newer: str | None = None,
        statements: Callable[[str], list[str]] | None = None,
    ) -> dict[str, Any]:
        """Stage the rows, then let the database merge them in one transaction."""
        staging = self.table(f"{name}_stage_{uuid.uuid4().hex[:8]}")
        seen = Observation()
        watched = latest.observe(seen, *load_metrics(latest, cursor, key))
        self._write(watched, staging, "errorifexists")
        metrics = {**NO_ROWS, **observed(seen)}
        try:
            if metrics["null_keys"]:
                raise NullKeys(f"{metrics['null_keys']} rows of {name!r} have a NULL in {key}")
            if create:
                # Appending no rows creates the table if it is not there yet.
                self._write(latest.limit(0), self.table(name), "append")
            if statements is not None:
                self._execute(*statements(staging))
            else:
                target = self.table(name)
                self._execute(merge_statement(target, staging, latest.columns, key, newer))
        finally:
            self._execute(f"DROP TABLE {staging}")
        return metrics

    def drop(self) -> None:
        self._execute(f"DROP SCHEMA IF EXISTS {quoted(self.schema)} CASCADE")
        self.audit.drop()

    def tables(self) -> list[str]:
        return self.audit.tables()

    def reset_state(self, name: str) -> None:
        self.audit.reset_state(name)

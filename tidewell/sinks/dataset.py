"""Target tables as Parquet folders with an audit table that doubles as the commit record.

    <root>/<dataset>/<table>/load=<id>/...           rows of one load
    <root>/<dataset>/<table>/load=<id>/_bucket=<k>/  the same for tables with a key
    <root>/<dataset>/_loads/table_name=<t>/seq=<n>/  one row per finished load

A load writes its folder first and its ``_loads`` row last. Readers follow the newest row,
so a load that dies half-way was never there, and rows and cursor become visible together.
A merge rewrites only the key buckets its rows fall in. Catalogs whose tables take MERGE
themselves are served by :func:`merge_into_catalog` instead.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from decimal import Decimal
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scrub import scrub
from tidewell.operators import contracts
from tidewell.operators.backfill import Range, range_counts
from tidewell.operators.changes import LSN, apply_changes, live_rows, target_rows
from tidewell.operators.merge import as_key, dedup_latest, merge_upsert, replace_children
from tidewell.operators.normalize import Child
from tidewell.operators.quality import load_metrics
from tidewell.sinks import storage

BUCKET = "_bucket"
# The disposition of a commit that only forgets the cursor; no folder belongs to it.
RESET = "reset"
DEFAULT_BUCKETS = 8
ERROR_CHARS = 500
# What a load reports that wrote nothing.
NO_ROWS = {
    "n_rows": 0, "null_keys": 0, "null_cursors": 0, "min_cursor": None, "max_cursor": None,
    "buckets": [],
}
# A delta counts as small, and its keys are broadcast, only below both bounds.
SMALL_DELTA_ROWS = 1_000_000
SMALL_DELTA_BYTES = 64 * 1024 * 1024
# A commit that was begun and left alone for so long belongs to a writer that died.
ABANDONED_SECONDS = 3600

LOADS_COLUMNS = {
    "load_id": "string", "pipeline": "string", "disposition": "string", "status": "string",
    "n_rows": "bigint", "n_rejected": "bigint", "null_cursors": "bigint",
    "min_cursor": "string", "max_cursor": "string", "state_cursor": "string",
    "n_skipped": "bigint",
    "chunks": "array<struct<chunk_start:timestamp_ntz,chunk_end:timestamp_ntz,n_rows:bigint>>",
    "new_columns": "array<string>", "schema_json": "string", "key": "array<string>",
    "n_buckets": "int", "base_seq": "bigint", "layout": "map<string,array<string>>",
    "started_at": "timestamp", "finished_at": "timestamp", "error": "string",
}
LOADS_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in LOADS_COLUMNS.items())


class ConcurrentLoad(RuntimeError):
    """Another load of the same table was committed meanwhile."""


class NullKeys(ValueError):
    """Rows whose merge key is NULL; nothing was changed."""


@dataclass(frozen=True)
class Head:
    """The newest commit of a table."""

    seq: int
    base_seq: int
    schema: T.StructType
    key: list[str]
    n_buckets: int
    layout: Mapping[int, list[str]] = field(default_factory=dict)
    state_cursor: str | None = None


def _later(old: str | None, new: str | None, dtype: T.DataType | None) -> str | None:
    if old is None or new is None:
        return new if old is None else old
    if isinstance(dtype, T.NumericType):
        return max(old, new, key=Decimal)
    return max(old, new)


def readable_as(old: T.DataType, new: T.DataType) -> bool:
    """Whether Parquet files of the old type can be read as the new one without a rewrite."""
    ints = (T.ByteType, T.ShortType, T.IntegerType)
    return (
        old == new
        or (isinstance(old, ints) and isinstance(new, (*ints, T.LongType, T.DoubleType)))
        or (isinstance(old, T.FloatType) and isinstance(new, T.DoubleType))
        or (isinstance(old, T.DateType) and isinstance(new, T.TimestampNTZType))
    )


def total_order(df: DataFrame, first: Sequence[str]) -> list[str]:
    """``first``, then every other sortable column, so that equal cursors resolve alike."""
    unsortable = (T.MapType, T.VariantType)
    rest = [f.name for f in df.schema if not isinstance(f.dataType, unsortable)]
    return list(dict.fromkeys([*first, *rest]))


def observed(seen: Observation) -> dict[str, Any]:
    """What was observed; nothing where Spark knew beforehand that there are no rows and left
    the metrics out, for which it has no row to give."""
    try:
        return seen.get
    except Py4JJavaError as error:
        if "assertion failed" not in str(error.java_exception):
            raise
        return {}


def count_chunks(
    rows: DataFrame | None, cursor: str | None, chunks: Sequence[Range], counted: bool = True
) -> list[dict[str, Any]]:
    """Chunk ranges with their rows: none of no rows, unknown unless ``counted``."""
    n: Sequence[int | None] = [0 if counted else None] * len(chunks)
    if rows is not None:
        n = range_counts(rows, cursor, chunks)
    return [
        {"chunk_start": start, "chunk_end": end, "n_rows": k}
        for (start, end), k in zip(chunks, n, strict=True)
    ]


def masked_error(text: Column) -> Column:
    """An error's text for a status row: credentials are masked first, then it is cut to size."""
    return F.substring(scrub(text), 1, ERROR_CHARS)


class Dataset:
    """The tables of one target dataset."""

    def __init__(
        self, spark: SparkSession, root: str, name: str, buckets: int = DEFAULT_BUCKETS
    ) -> None:
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{name}"
        self.buckets = buckets

    # -- reading ---------------------------------------------------------------------

    def _commits(self, table: str) -> str:
        return f"{self.path}/_loads/table_name={table}"

    def tables(self) -> list[str]:
        names = storage.child_names(self.spark, f"{self.path}/_loads")
        return sorted(n.split("=", 1)[1] for n in names if n.startswith("table_name="))

    def head(self, table: str) -> Head | None:
        """The newest commit. Numbers have no gaps, so it takes few probes, not a listing."""

        def committed(seq: int) -> bool:
            return storage.exists(self.spark, f"{self._commits(table)}/seq={seq}/_SUCCESS")

        above = 1
        while committed(above):
            above *= 2
        found = above // 2
        while above - found > 1:
            middle = (found + above) // 2
            found, above = (middle, above) if committed(middle) else (found, middle)
        if not found:
            return None
        folder = f"{self._commits(table)}/seq={found}"
        row = self.spark.read.schema(LOADS_SCHEMA).parquet(folder).first()
        schema = T.StructType.fromJson(json.loads(row.schema_json))
        return Head(
            found, row.base_seq, schema, list(row.key or []), row.n_buckets or 0,
            {int(b): ids for b, ids in (row.layout or {}).items()}, row.state_cursor,
        )

    def loads(self) -> DataFrame:
        """The audit table: every finished load, and failed ones with their error."""
        schema = f"{LOADS_SCHEMA}, table_name string, seq bigint"
        frames = [
            self.spark.read.schema(schema).option("basePath", path).parquet(path)
            for path in (f"{self.path}/_loads", f"{self.path}/_failed")
            if storage.exists(self.spark, path)
        ]
        if not frames:
            return self.spark.createDataFrame([], schema)
        return frames[0].unionByName(frames[1]) if len(frames) > 1 else frames[0]

    def schema_log(self) -> DataFrame:
        return self.loads().filter(F.size("new_columns") > 0).select(
            "load_id", "pipeline", "table_name", "seq", "new_columns"
        )

    def loads_of(self, done: Sequence[Mapping[str, Any]]) -> DataFrame:
        """The audit rows of some loads only, without listing the whole history."""
        schema = f"{LOADS_SCHEMA}, table_name string, seq bigint"
        paths = [f"{self._commits(row['table_name'])}/seq={row['seq']}" for row in done]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/_loads")
        return reader.parquet(*paths)

    def done_chunks(self, table: str) -> DataFrame:
        """Bounds of the backfill chunks that are loaded."""
        if not storage.exists(self.spark, self._commits(table)):
            return self.spark.createDataFrame([], "chunk_start timestamp_ntz, chunk_end timestamp_ntz")
        commits = self.spark.read.schema(LOADS_SCHEMA).parquet(self._commits(table))
        return commits.select(F.inline("chunks")).select("chunk_start", "chunk_end")

    def cursor(self, table: str) -> str | None:
        head = self.head(table)
        return head.state_cursor if head else None

    def read(self, table: str, live_only: bool = False) -> DataFrame:
        head = self.head(table)
        if head is None:
            raise LookupError(f"no table {table!r} in {self.path}")
        df = self._read(table, head)
        return live_rows(df) if live_only else df

    def _live(
        self, table: str, head: Head, buckets: Sequence[int] | None = None
    ) -> list[tuple[int | None, str]]:
        """Bucket and load of every folder that readers see."""
        if head.key:
            chosen = head.layout if buckets is None else [b for b in buckets if b in head.layout]
            return [(b, load_id) for b in chosen for load_id in head.layout[b]]
        commits = self.spark.read.schema(f"{LOADS_SCHEMA}, seq bigint")
        ids = (
            commits.option("basePath", self._commits(table)).parquet(self._commits(table))
            .filter((F.col("seq") >= head.base_seq) & (F.col("disposition") != RESET))
            .select("load_id")
        )
        return [(None, row.load_id) for row in ids.collect()]

    def _read(self, table: str, head: Head, buckets: Sequence[int] | None = None) -> DataFrame:
        folder = f"{self.path}/{table}"
        paths = [
            f"{folder}/load={load_id}" + (f"/{BUCKET}={b}" if b is not None else "")
            for b, load_id in self._live(table, head, buckets)
        ]
        if not paths:
            return self.spark.createDataFrame([], head.schema)
        return self.spark.read.schema(head.schema).parquet(*paths)

    # -- writing ---------------------------------------------------------------------

    def load(
        self, table: str, df: DataFrame, disposition: str, *, key: str | Sequence[str] = (),
        cursor: str | None = None, contract: str = contracts.EVOLVE, pipeline: str = "",
        move_cursor: bool = True, chunks: Sequence[Range] | None = None,
        skipped: Observation | None = None,
    ) -> dict[str, Any]:
        """Write rows by disposition and commit them; returns the audit row. ``chunks`` are the
        ranges of the cursor that a backfill loads with them."""
        head = self.head(table)
        key = as_key(key) if key else []
        if head is not None and head.key and not key:
            key = head.key
        df, schema, added, rejected = self.agree(df, head, contract)
        if disposition == "merge":
            if not key:
                raise ValueError(f"merge into {table!r} needs a primary key")
            df = dedup_latest(df, key, total_order(df, [cursor] if cursor else []))
            combine = lambda base, delta, small: merge_upsert(base, delta, key, small)
        else:
            combine = None
        return self._store(
            table, df, head, disposition, combine, schema=schema, key=key, cursor=cursor,
            added=added, rejected=rejected, pipeline=pipeline, move_cursor=move_cursor, chunks=chunks,
            skipped=skipped,
        )

    def load_children(
        self, table: str, child: Child, *, contract: str = contracts.EVOLVE, pipeline: str = "",
    ) -> dict[str, Any]:
        """Merge a table of array elements: parents in the batch get exactly its elements."""
        head = self.head(table)
        df, schema, added, rejected = self.agree(child.rows, head, contract)
        pos = child.positions[-1]
        if head is None:
            df = df.filter(F.col(pos).isNotNull())
        return self._store(
            table, df, head, "merge",
            lambda base, delta, small: replace_children(base, delta, child.parent_key, pos, small),
            schema=schema, key=child.parent_key, cursor=None, added=added, rejected=rejected,
            pipeline=pipeline, move_cursor=False,
        )

    def apply(
        self, table: str, log: DataFrame, key: str | Sequence[str], *, delete_mode: str = "soft",
        contract: str = contracts.EVOLVE, pipeline: str = "", reset: bool = False,
        move_cursor: bool = True,
    ) -> dict[str, Any]:
        """Bring a table up to date with changes; ``reset`` starts it anew from them."""
        head = self.head(table)
        columns = as_key(key)
        latest = target_rows(log, columns, delete_mode)
        latest, schema, added, rejected = self.agree(latest, head, contract)
        return self._store(
            table, latest, head, "replace" if reset else "merge",
            lambda base, delta, small: apply_changes(base, delta, columns, small),
            schema=schema, key=columns, cursor=LSN, added=added, rejected=rejected,
            pipeline=pipeline, move_cursor=move_cursor,
        )

    def agree(
        self, df: DataFrame, head: Head | None, contract: str
    ) -> tuple[DataFrame, T.StructType, list[str], Observation | None]:
        """The batch and the table's schema after the contract had its say."""
        if head is None:
            return df, df.schema, [], None
        if contract == contracts.FREEZE:
            return contracts.contract_freeze(head.schema, df), head.schema, [], None
        if contract == contracts.DISCARD_ROW:
            # Counted where rows are read, so a stage that Spark repeats may count rows twice;
            # the rows themselves are not affected.
            seen = Observation()
            broken = contracts.violates(head.schema, df)
            watched = df.observe(seen, F.count_if(broken).alias("n_rejected"))
            accepted, _ = contracts.contract_discard_row(head.schema, watched)
            return accepted, head.schema, [], seen
        added = contracts.new_columns(head.schema, df.schema)
        schema = contracts.evolved_schema(head.schema, df.schema)
        return contracts.conform(df, schema), schema, added, None

    def _store(
        self, table: str, df: DataFrame, head: Head | None, disposition: str,
        combine: Callable[[DataFrame, DataFrame, bool], DataFrame] | None, *,
        schema: T.StructType, key: list[str], cursor: str | None, added: list[str],
        rejected: Observation | None, pipeline: str, move_cursor: bool,
        chunks: Sequence[Range] | None = None, skipped: Observation | None = None,
    ) -> dict[str, Any]:
        started = datetime.now(timezone.utc)
        load_id = uuid.uuid4().hex
        folder = f"{self.path}/{table}/load={load_id}"
        buckets = head.n_buckets if head and head.n_buckets else self.buckets
        fresh = head is None or disposition == "replace" or (bool(key) and key != head.key)
        # Another key type hashes into other buckets, so it needs a rewrite in any case.
        rewrite = head is not None and not fresh and any(
            not readable_as(f.dataType, schema[f.name].dataType)
            or (f.name in key and f.dataType != schema[f.name].dataType)
            for f in head.schema
        )
        merging = disposition == "merge" and not fresh
        staged_in = f"{self.path}/_staging/{load_id}" if merging or rewrite else folder

        if head is not None and disposition != "replace" and fresh:
            # The key is new or another one: everything is bucketed anew.
            before = contracts.conform(self._read(table, head), schema)
            df = combine(before, df, False) if combine else before.unionByName(df)
        staging = staged_in != folder
        metrics = self._write(df, staged_in, key, buckets, cursor, bucketed=not staging)
        if key and disposition == "merge" and metrics["null_keys"]:
            storage.remove(self.spark, staged_in)
            raise NullKeys(f"{metrics['null_keys']} rows of {table!r} have a NULL in {key}")
        counted = None
        if chunks is not None:  # of what was just written, so the source is read once
            written = self.spark.read.schema(schema).parquet(staged_in) if metrics["n_rows"] else None
            counted = count_chunks(written, cursor, chunks)

        touched = sorted(metrics["buckets"])
        layout: dict[int, list[str]] = {} if fresh else dict(head.layout)
        if not staging:
            for b in touched:
                layout[b] = [*layout.get(b, []), load_id]
        elif metrics["n_rows"] or rewrite:
            staged = self.spark.read.schema(schema).parquet(staged_in)
            small = not rewrite and metrics["n_rows"] <= SMALL_DELTA_ROWS and (
                storage.size_in_bytes(self.spark, staged_in) <= SMALL_DELTA_BYTES
            )
            if small:
                # Base rows come from bucket folders; with few new rows gathered likewise, the
                # whole needs no further shuffle.
                staged = (
                    staged.withColumn(BUCKET, self._bucket(key, buckets))
                    .hint("rebalance", F.col(BUCKET)).drop(BUCKET)
                )
            base = self._read(table, head, None if rewrite else touched)
            base = contracts.conform(base, schema)
            merged = combine(base, staged, small) if merging else base.unionByName(staged)
            written = self._write(merged, folder, key, buckets, cursor, clustered=small)["buckets"]
            if rewrite:
                layout, fresh = {}, True
            # A touched bucket whose last rows went has no folder any more.
            layout = {b: ids for b, ids in layout.items() if b not in touched}
            layout.update({b: [load_id] for b in sorted(written)})

        row = self._audit_row(
            head, load_id, disposition, metrics, schema, key=key, cursor=cursor, added=added,
            rejected=rejected, pipeline=pipeline, move_cursor=move_cursor, chunks=counted,
            skipped=skipped, started=started, layout=layout, buckets=buckets, fresh=fresh,
        )
        self._commit(table, row["seq"], row)
        if staging:
            storage.remove(self.spark, staged_in)
        return {"table_name": table, **row}

    def _audit_row(
        self, head: Head | None, load_id: str, disposition: str, metrics: Mapping[str, Any],
        schema: T.StructType, *, key: list[str], cursor: str | None, added: list[str],
        rejected: Observation | None, pipeline: str, move_cursor: bool, started: datetime,
        layout: Mapping[int, list[str]], buckets: int, fresh: bool,
        chunks: list[dict[str, Any]] | None = None, skipped: Observation | None = None,
    ) -> dict[str, Any]:
        seq = head.seq + 1 if head else 1
        state = head.state_cursor if head else None
        if move_cursor:
            dtype = schema[cursor].dataType if cursor in schema.fieldNames() else None
            state = _later(state, metrics["max_cursor"], dtype)
        return {
            "seq": seq, "load_id": load_id, "pipeline": pipeline, "disposition": disposition,
            "status": "ok", "n_rows": metrics["n_rows"],
            "n_rejected": observed(rejected).get("n_rejected", 0) if rejected is not None else 0,
            "null_cursors": metrics["null_cursors"], "min_cursor": metrics["min_cursor"],
            "max_cursor": metrics["max_cursor"], "state_cursor": state,
            "n_skipped": observed(skipped).get("n_skipped", 0) if skipped is not None else 0, "chunks": chunks,
            "new_columns": added, "schema_json": schema.json(), "key": key, "n_buckets": buckets,
            "base_seq": seq if fresh or head is None else head.base_seq, "layout": layout,
            "started_at": started, "finished_at": datetime.now(timezone.utc), "error": None,
        }

    def commit_external(
        self, table: str, disposition: str, metrics: Mapping[str, Any], schema: T.StructType,
        **facts: Any,
    ) -> dict[str, Any]:
        """The audit row of a load whose rows went to another store; no folder belongs to it."""
        head = self.head(table)
        row = self._audit_row(
            head, uuid.uuid4().hex, disposition, metrics, schema, key=[], layout={}, buckets=0,
            fresh=disposition == "replace", **facts,
        )
        self._commit(table, row["seq"], row)
        return {"table_name": table, **row}

    def _bucket(self, key: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")

    def _write(
        self, df: DataFrame, folder: str, key: list[str], buckets: int, cursor: str | None,
        bucketed: bool = True, clustered: bool = False,
    ) -> dict[str, Any]:
        """Write rows and measure them on the way, ``bucketed`` by key if there is one.

        Rebalancing by bucket lets Spark settle file sizes at run time: large buckets are split
        over tasks, small ones share one. Rows that are ``clustered`` already skip it.
        """
        bucketed = bucketed and bool(key)
        columns = load_metrics(df, cursor if cursor in df.columns else None, key)
        if key:
            # At most one number per bucket, however many rows there are.
            columns.append(F.collect_set(self._bucket(key, buckets)).alias("buckets"))
        if bucketed:
            df = df.withColumn(BUCKET, self._bucket(key, buckets))
            if not clustered:
                df = df.hint("rebalance", F.col(BUCKET))
        seen = Observation()
        writer = df.observe(seen, *columns).write
        if bucketed:
            writer = writer.partitionBy(BUCKET)
        writer.mode("errorifexists").parquet(folder)
        return {**NO_ROWS, **observed(seen)}

    def _record(self, row: Mapping[str, Any]) -> DataFrame:
        """One audit row, built without a Python worker."""

        def plain(value: Any) -> Any:
            if isinstance(value, datetime):
                return value.isoformat()
            if isinstance(value, list):
                return [plain(v) for v in value]
            return {str(k): plain(v) for k, v in value.items()} if isinstance(value, dict) else value

        text = json.dumps({c: plain(row.get(c)) for c in LOADS_COLUMNS})
        parsed = F.from_json(F.lit(text), LOADS_SCHEMA, {"mode": "FAILFAST"})
        return self.spark.range(1, numPartitions=1).select(parsed.alias("r")).select("r.*")

    def _commit(self, table: str, seq: int, row: Mapping[str, Any]) -> None:
        """Compare and swap: the next sequence number must still be free."""
        target = f"{self._commits(table)}/seq={seq}"
        if storage.exists(self.spark, target) and not (
            storage.exists(self.spark, f"{target}/_SUCCESS")
            or storage.age_in_seconds(self.spark, target) < ABANDONED_SECONDS
        ):
            storage.remove(self.spark, target)
        try:
            self._record(row).write.mode("errorifexists").parquet(target)
        except AnalysisException as error:
            raise ConcurrentLoad(f"load {seq} of {table!r} was committed by another writer") from error

    def record_failure(self, table: str, pipeline: str, error: str) -> None:
        """A status row for a load that failed; it never affects what readers see."""
        now = datetime.now(timezone.utc)
        row = {"load_id": uuid.uuid4().hex, "pipeline": pipeline, "status": "failed",
               "error": error, "started_at": now, "finished_at": now}
        target = f"{self.path}/_failed/table_name={table}/seq=0"
        failed = self._record(row).withColumn("error", masked_error(F.col("error")))
        failed.write.mode("append").parquet(target)

    # -- removal ---------------------------------------------------------------------

    def reset_state(self, table: str) -> None:
        """Forget the cursor and keep the rows: the next load takes everything again."""
        head = self.head(table)
        if head is None:
            return
        last = self.spark.read.schema(LOADS_SCHEMA).parquet(f"{self._commits(table)}/seq={head.seq}").first()
        row = {**last.asDict(), "state_cursor": None, "n_rows": 0, "disposition": RESET,
               "new_columns": [], "load_id": uuid.uuid4().hex}
        self._commit(table, head.seq + 1, row)

    def drop(self) -> bool:
        """Remove the whole dataset; removing it twice is no error."""
        return storage.remove(self.spark, self.path)

    def vacuum(self, table: str) -> int:
        """Remove load folders that the newest commit no longer refers to. Run it while no
        load of the table is going on: rows that are not committed yet are removed as well."""
        head = self.head(table)
        if head is None:
            return 0
        live = {load_id for _, load_id in self._live(table, head)}
        folders = storage.child_names(self.spark, f"{self.path}/{table}")
        old = [n for n in folders if n.startswith("load=") and n[5:] not in live]
        return sum(storage.remove(self.spark, f"{self.path}/{table}/{n}") for n in old)


def merge_into_catalog(table: str, delta: DataFrame, key: str | Sequence[str]) -> None:
    """Upsert into a catalog table whose format supports MERGE; the format plans the rest."""
    on = [F.col(f"target.{k}") == F.col(f"source.{k}") for k in as_key(key)]
    condition = on[0]
    for part in on[1:]:
        condition = condition & part
    (
        delta.alias("source").mergeInto(f"{table} AS target", condition)
        .whenMatched().updateAll()
        .whenNotMatched().insertAll()
        .merge()
    )

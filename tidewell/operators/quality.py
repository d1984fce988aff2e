"""Row-count reconciliation, load metrics, freshness and run-time budgets."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.changes import DELETED_AT, live_rows


def _counts(frames: Mapping[str, DataFrame], name: str) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(table).alias("table_name"), name)
        for table, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def live_only(df: DataFrame) -> DataFrame:
    """A target without the rows that change data flagged as deleted."""
    return live_rows(df) if DELETED_AT in df.columns else df


def reconcile_counts(
    source: Mapping[str, DataFrame], target: Mapping[str, DataFrame], flagged: bool = False
) -> DataFrame:
    """One row per table with both counts; flagged rows count only if asked for."""
    if not flagged:
        target = {table: live_only(df) for table, df in target.items()}
    both = _counts(source, "source_rows").join(_counts(target, "target_rows"), "table_name", "full")
    return both.select(
        "table_name", "source_rows", "target_rows",
        (F.coalesce("source_rows", F.lit(-1)) == F.coalesce("target_rows", F.lit(-1))).alias("ok"),
    )


def check_counts(reconciled: DataFrame) -> None:
    """Raise with the first mismatches; a verdict without counts names the table only."""
    bad = reconciled.filter(~F.col("ok")).orderBy("table_name").take(20)
    if bad:
        facts = [row.asDict() for row in bad]
        raise ValueError(
            "; ".join(
                f"row count mismatch for {f['table_name']}"
                + (f": source={f['source_rows']} destination={f['target_rows']}" if len(f) > 2 else "")
                for f in facts
            )
        )


def reconcile_same_engine(spark: SparkSession, source: DataFrame, target: DataFrame) -> DataFrame:
    """One boolean from one statement, where one engine reaches both sides."""
    return spark.sql(
        "SELECT (SELECT count(*) FROM {source}) = (SELECT count(*) FROM {target}) AS ok",
        source=source, target=target,
    )


def load_metrics(df: DataFrame, cursor: str | None, keys: list[str]) -> list[Column]:
    """What a load reports about its rows; used with ``observe``, so it needs no second scan."""
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.lit(False))
    cursor_col = F.col(cursor) if cursor else F.lit(None).cast("string")
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(null_key).alias("null_keys"),
        (F.count_if(cursor_col.isNull()) if cursor else F.lit(0).cast("bigint")).alias("null_cursors"),
        F.min(cursor_col).cast("string").alias("min_cursor"),
        F.max(cursor_col).cast("string").alias("max_cursor"),
    ]


def load_audit(df: DataFrame, load: list[str], cursor: str, key: list[str]) -> DataFrame:
    """The same metrics per load of a table of loaded rows."""
    return df.groupBy(*load).agg(*load_metrics(df, cursor, key))


def stale_components(
    components: DataFrame, beats: DataFrame, now: datetime, threshold_seconds: float = 60
) -> DataFrame:
    """Components whose last beat is older than the threshold, or that never beat.

    ``beats(component, ts)``: only the latest per component matters, so beats are combined
    before the join.
    """
    last = beats.groupBy("component").agg(F.max("ts").alias("last_seen"))
    seen = F.col("last_seen")
    moment = F.lit(now.isoformat(sep=" ")).cast(beats.schema["ts"].dataType)
    age = (F.unix_micros(moment.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))) / 1e6
    return (
        components.join(last, "component", "left")
        .filter(seen.isNull() | (age > threshold_seconds))
        .select("component", F.coalesce(seen.cast("string"), F.lit("never")).alias("last_seen"))
    )


def sla_misses(runs: DataFrame, sla_minutes: float) -> DataFrame:
    """``runs(pipeline, task, started_at, finished_at)``: per pipeline, the tasks that took
    longer than allowed. Distinct names only, so a list is no longer than the pipeline has tasks."""
    took = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    return (
        runs.filter(took > F.lit(round(sla_minutes * 60_000_000)))
        .groupBy("pipeline")
        .agg(F.array_join(F.array_sort(F.collect_set("task")), ", ").alias("tasks"))
    )

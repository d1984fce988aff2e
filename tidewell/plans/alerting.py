"""Alerts that follow from the audit table: failures, schema changes and late loads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import truncate_summary
from tidewell.functions.scrub import scrub
from tidewell.operators.alerts import alert_rows, suppress_alerts
from tidewell.operators.contracts import schema_update_dedup, schema_update_report
from tidewell.spec import PipelineSpec


def load_events(loads: DataFrame, spec: PipelineSpec) -> DataFrame:
    """Audit rows of one pipeline as alert events, zero to three per load."""
    late = F.lit(False)
    if spec.sync.sla_minutes is not None and spec.alerts.on_sla_miss:
        took = F.unix_micros("finished_at") - F.unix_micros("started_at")
        late = took > spec.sync.sla_minutes * 60_000_000
    grown = F.lit(spec.alerts.on_schema_change) & (F.size("new_columns") > 0)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("status") == "failed", F.lit("failure")),
            F.when(grown, F.lit("schema")),
            F.when(late, F.lit("sla")),
        )
    )
    return loads.filter(F.col("pipeline") == spec.name).select(
        F.col("finished_at").alias("ts"), F.col("load_id").alias("event_id"), "pipeline",
        F.explode(kinds).alias("kind"), F.lit(spec.alerts.severity).alias("severity"),
        F.lit(spec.alerts.slack_channel).cast("string").alias("channel_override"),
    )


def pipeline_alerts(loads: DataFrame, spec: PipelineSpec, channels: Mapping[str, str]) -> DataFrame:
    """Routed alert rows with ``deduped`` set inside the spec's suppression window."""
    rows = alert_rows(load_events(loads, spec), channels)
    return suppress_alerts(
        rows, ["pipeline", "severity", "kind"], "ts", "event_id", spec.alerts.dedup_window_minutes
    )


def failure_summaries(loads: DataFrame) -> DataFrame:
    """Failed loads with a short error text that holds no credentials."""
    return loads.filter(F.col("status") == "failed").select(
        "pipeline", "load_id", truncate_summary(scrub(F.col("error"))).alias("summary")
    )


def schema_report(loads: DataFrame) -> DataFrame:
    """The first schema changes per pipeline, and how many more there were."""
    updates = loads.filter(F.size("new_columns") > 0).select(
        "pipeline", F.col("seq").alias("step_no"), F.lit("load").alias("step"), "table_name",
        "new_columns",
    )
    return schema_update_report(schema_update_dedup(updates))

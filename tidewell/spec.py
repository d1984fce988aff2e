"""The declarative description of one replication pipeline."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, field, fields
from types import UnionType
from typing import Any, Union, get_args, get_origin, get_type_hints

from tidewell.functions.durations import fixed_seconds, parse_duration

# The names a spec may use and the ranges of its numbers.
SOURCE_TYPES = ("rest_api", "sql_database", "filesystem", "pg_cdc")
DESTINATION_TYPES = ("postgres", "snowflake", "databricks", "duckdb")
SYNC_MODES = ("full_refresh", "incremental", "cdc")
DISPOSITIONS = ("append", "replace", "merge")
CONTRACTS = ("evolve", "freeze", "discard_row")
DELETE_MODES = ("soft", "hard")
PARTITION_UNITS = ("year", "month", "day")
CHECK_MODES = ("same_cluster", "cross_cluster")
ALERT_SEVERITIES = ("P1", "P2", "info")
NAME_FORMAT = r"[a-z][a-z0-9_]*"
CRON_FIELD_FORMAT = r"[0-9*/,\-?]+"
MAX_TOLERANCE_SECONDS = 86400
MAX_DEDUP_MINUTES = 1440

COUNTED_SOURCES = ("sql_database", "pg_cdc")


class SpecError(ValueError):
    """All problems of one spec, one per line."""


@dataclass(frozen=True)
class Source:
    type: str
    connection: str
    config: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Backfill:
    chunk_size: str
    partition_field: str | None = None


@dataclass(frozen=True)
class Sync:
    mode: str
    cursor_field: str | None = None
    primary_key: str | list[str] | None = None
    tolerance_seconds: int = 0
    lookback: str | None = None
    backfill: Backfill | None = None
    sla_minutes: int | None = None

    @property
    def key(self) -> list[str]:
        if self.primary_key is None:
            return []
        return [self.primary_key] if isinstance(self.primary_key, str) else list(self.primary_key)


@dataclass(frozen=True)
class Destination:
    type: str
    connection: str
    dataset: str


@dataclass(frozen=True)
class Schedule:
    """Kept for the scheduler that calls us; not interpreted here."""

    cron: str
    enabled: bool = True


@dataclass(frozen=True)
class Options:
    """``partition_field`` lays a table out by that date, per ``partition_unit``; say
    ``partition_fixed`` only if the date of a key never changes."""

    write_disposition: str | None = None
    schema_contract: str = "evolve"
    delete_mode: str = "soft"
    partition_field: str | None = None
    partition_unit: str = "month"
    partition_fixed: bool = False


@dataclass(frozen=True)
class Resources:
    """Kept for the scheduler that calls us; not interpreted here."""

    cpu: str | None = None
    memory: str | None = None


@dataclass(frozen=True)
class Alerts:
    severity: str = "P2"
    dedup_window_minutes: int = 15
    slack_channel: str | None = None
    email_recipients: list[str] = field(default_factory=list)
    on_schema_change: bool = True
    on_sla_miss: bool = True


@dataclass(frozen=True)
class Quality:
    row_count_check: bool = False
    check_mode: str = "cross_cluster"


def _fits(value: Any, hint: Any) -> bool:
    """Whether a value has the type that a field declares."""
    origin, inner = get_origin(hint), get_args(hint)
    if origin in (UnionType, Union):
        return any(_fits(value, option) for option in inner)
    if origin is list:
        return isinstance(value, list) and all(_fits(item, inner[0]) for item in value)
    if hint is int:
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, origin or hint)


def _section(cls: type, raw: Any, path: str, problems: list[str]) -> Any:
    """One block of the spec as ``cls``; unknown and missing keys become problems."""
    if not isinstance(raw, Mapping):
        problems.append(f"{path}: expected a block, got {raw!r}")
        return None
    allowed = {f.name: f for f in fields(cls)}
    for key in sorted(set(raw) - set(allowed)):
        problems.append(f"{path}: unknown key {key!r}")
    missing = [
        f.name for f in fields(cls)
        if f.default is MISSING and f.default_factory is MISSING and raw.get(f.name) is None
    ]
    for key in missing:
        problems.append(f"{path}.{key} is required")
    if missing:
        return None
    values = {k: raw[k] for k in allowed if k in raw}
    if cls is Sync and values.get("backfill") is not None:
        values["backfill"] = _section(Backfill, values["backfill"], f"{path}.backfill", problems)
    hints = get_type_hints(cls)
    wrong = [key for key, value in values.items() if not _fits(value, hints[key])]
    for key in wrong:
        problems.append(f"{path}.{key}: {values[key]!r} has the wrong type")
    return None if wrong else cls(**values)


@dataclass(frozen=True)
class PipelineSpec:
    name: str
    source: Source
    sync: Sync
    destination: Destination
    schedule: Schedule | None = None
    options: Options = field(default_factory=Options)
    resources: Resources = field(default_factory=Resources)
    alerts: Alerts = field(default_factory=Alerts)
    quality: Quality = field(default_factory=Quality)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> PipelineSpec:
        """Build and check a spec; every problem found is reported at once."""
        blocks = {
            "source": Source, "sync": Sync, "destination": Destination, "schedule": Schedule,
            "options": Options, "resources": Resources, "alerts": Alerts, "quality": Quality,
        }
        problems = [f"unknown key {key!r}" for key in sorted(set(raw) - {"name", *blocks})]
        for key in ("name", "source", "sync", "destination"):
            if key not in raw:
                problems.append(f"{key} is required")
        built = {
            key: _section(kind, raw[key], key, problems)
            for key, kind in blocks.items()
            if raw.get(key) is not None
        }
        if problems:
            raise SpecError("\n".join(problems))
        spec = cls(name=raw["name"], **built)
        spec.check()
        return spec

    def check(self) -> None:
        problems = [*self._value_problems(), *self._rule_problems()]
        if problems:
            raise SpecError("\n".join(problems))

    def _value_problems(self) -> list[str]:
        found: list[str] = []
        for label, text in (("name", self.name), ("destination.dataset", self.destination.dataset)):
            if not (isinstance(text, str) and re.fullmatch(NAME_FORMAT, text)):
                found.append(f"{label} must match ^{NAME_FORMAT}$, got {text!r}")
        choices = (
            ("source.type", self.source.type, SOURCE_TYPES),
            ("destination.type", self.destination.type, DESTINATION_TYPES),
            ("sync.mode", self.sync.mode, SYNC_MODES),
            ("options.schema_contract", self.options.schema_contract, CONTRACTS),
            ("options.delete_mode", self.options.delete_mode, DELETE_MODES),
            ("options.partition_unit", self.options.partition_unit, PARTITION_UNITS),
            ("quality.check_mode", self.quality.check_mode, CHECK_MODES),
            ("alerts.severity", self.alerts.severity, ALERT_SEVERITIES),
        )
        found += [f"{p} must be one of {list(c)}, got {v!r}" for p, v, c in choices if v not in c]
        if self.options.write_disposition not in (None, *DISPOSITIONS):
            found.append(f"options.write_disposition must be one of {list(DISPOSITIONS)}")
        if not 0 <= self.sync.tolerance_seconds <= MAX_TOLERANCE_SECONDS:
            found.append(f"sync.tolerance_seconds must be in 0..{MAX_TOLERANCE_SECONDS}")
        if not 0 <= self.alerts.dedup_window_minutes <= MAX_DEDUP_MINUTES:
            found.append(f"alerts.dedup_window_minutes must be in 0..{MAX_DEDUP_MINUTES}")
        if self.sync.sla_minutes is not None and self.sync.sla_minutes <= 0:
            found.append("sync.sla_minutes must be above 0")
        durations = [("sync.lookback", self.sync.lookback, fixed_seconds)]
        if self.sync.backfill is not None:
            size = self.sync.backfill.chunk_size
            durations.append(("sync.backfill.chunk_size", size, parse_duration))
        for label, text, parse in durations:
            if text is not None:
                try:
                    parse(text)
                except ValueError as problem:
                    found.append(f"{label}: {problem}")
        if self.schedule is not None:
            cron = self.schedule.cron.split(" ")
            if len(cron) != 5 or not all(re.fullmatch(CRON_FIELD_FORMAT, f) for f in cron):
                found.append(f"schedule.cron needs five fields of {CRON_FIELD_FORMAT}, one space apart")
        return found

    def _rule_problems(self) -> list[str]:
        sync, mode = self.sync, self.sync.mode
        counted = self.quality.row_count_check
        rules = (
            (mode == "incremental" and sync.cursor_field is None,
             "sync.mode 'incremental' needs sync.cursor_field"),
            (mode == "full_refresh" and sync.cursor_field is not None,
             "sync.mode 'full_refresh' takes no sync.cursor_field"),
            (mode == "cdc" and self.source.type != "pg_cdc",
             "sync.mode 'cdc' reads change logs only (source.type 'pg_cdc')"),
            (mode == "cdc" and not sync.key,
             "sync.mode 'cdc' needs sync.primary_key"),
            (self.options.write_disposition == "merge" and not sync.key,
             "options.write_disposition 'merge' needs sync.primary_key"),
            (sync.backfill is not None and mode != "incremental",
             "sync.backfill goes with sync.mode 'incremental' only"),
            (sync.tolerance_seconds > 0 and sync.cursor_field is None,
             "sync.tolerance_seconds needs sync.cursor_field"),
            (sync.lookback is not None and sync.cursor_field is None,
             "sync.lookback needs sync.cursor_field"),
            (counted and self.source.type not in COUNTED_SOURCES,
             f"quality.row_count_check counts {list(COUNTED_SOURCES)} sources only"),
            (counted and self.destination.type == "databricks",
             "quality.row_count_check cannot count a 'databricks' destination"),
        )
        return [message for broken, message in rules if broken]

    @property
    def disposition(self) -> str:
        """How rows are written: a full refresh replaces unless told otherwise, and a change
        log is never plainly appended."""
        chosen = self.options.write_disposition
        if self.sync.mode == "cdc":
            return "merge" if chosen in (None, "append") else chosen
        return chosen or ("replace" if self.sync.mode == "full_refresh" else "append")

import copy

import pytest

from tidewell.spec import PipelineSpec, SpecError

VALID = {
    "name": "orders_inc",
    "source": {"type": "sql_database", "connection": "db", "config": {"tables": ["orders"]}},
    "sync": {"mode": "incremental", "cursor_field": "updated_at", "primary_key": "id"},
    "destination": {"type": "duckdb", "connection": "local", "dataset": "raw_orders"},
    "schedule": {"cron": "0 */2 * * *", "enabled": True},
    "options": {"write_disposition": "merge"},
}


def spec(**changes):
    """The valid spec with dotted paths changed; None removes a key."""
    raw = copy.deepcopy(VALID)
    for path, value in changes.items():
        *parents, last = path.split(".")
        block = raw
        for parent in parents:
            block = block.setdefault(parent, {})
        if value is None:
            block.pop(last, None)
        else:
            block[last] = value
    return raw


def build(changes):
    return PipelineSpec.from_dict(spec(**changes))


def test_valid_spec():
    made = PipelineSpec.from_dict(VALID)
    assert made.sync.key == ["id"]
    assert made.disposition == "merge"
    assert made.alerts.dedup_window_minutes == 15


@pytest.mark.parametrize(
    ("changes", "message"),
    [
        ({"name": "Orders"}, "name must match"),
        ({"name": "orders\n"}, "name must match"),
        ({"destination.dataset": "raw; drop"}, "destination.dataset must match"),
        ({"extra": 1}, "unknown key 'extra'"),
        ({"sync.colour": "red"}, "sync: unknown key 'colour'"),
        ({"source": None}, "source is required"),
        ({"source.type": "ftp"}, "source.type must be one of"),
        ({"sync.cursor_field": None}, "'incremental' needs sync.cursor_field"),
        ({"sync.mode": "full_refresh"}, "'full_refresh' takes no"),
        ({"sync.mode": "cdc"}, "source.type 'pg_cdc'"),
        ({"source.type": "pg_cdc", "sync.mode": "cdc", "sync.primary_key": None,
          "sync.cursor_field": None}, "'cdc' needs sync.primary_key"),
        ({"sync.primary_key": None}, "'merge' needs sync.primary_key"),
        ({"sync.mode": "full_refresh", "sync.cursor_field": None,
          "sync.backfill": {"chunk_size": "P1D"}}, "sync.backfill goes with"),
        ({"sync.backfill": {"chunk_size": "one day"}}, "not an ISO-8601 duration"),
        ({"sync.backfill": {}}, "sync.backfill.chunk_size is required"),
        ({"sync.lookback": "P1M"}, "no fixed length"),
        ({"sync.mode": "full_refresh", "sync.cursor_field": None, "sync.lookback": "P1D"},
         "sync.lookback needs"),
        ({"sync.mode": "full_refresh", "sync.cursor_field": None, "sync.tolerance_seconds": 5},
         "sync.tolerance_seconds needs"),
        ({"sync.tolerance_seconds": 86401}, "0..86400"),
        ({"sync.tolerance_seconds": "5"}, "sync.tolerance_seconds: '5' has the wrong type"),
        ({"sync.primary_key": ["id", 3]}, "sync.primary_key"),
        ({"sync.primary_key": []}, "'merge' needs sync.primary_key"),
        ({"schedule.enabled": 1}, "schedule.enabled: 1 has the wrong type"),
        ({"source.config": ["a"]}, "source.config"),
        ({"alerts.dedup_window_minutes": 1441}, "0..1440"),
        ({"sync.sla_minutes": 0}, "sla_minutes must be above 0"),
        ({"schedule.cron": "* * *"}, "schedule.cron"),
        ({"source.type": "filesystem", "quality.row_count_check": True}, "row_count_check counts"),
        ({"destination.type": "databricks", "quality.row_count_check": True}, "cannot count"),
    ],
)
def test_refusals(changes, message):
    with pytest.raises(SpecError, match=message):
        build(changes)


def test_all_problems_at_once():
    with pytest.raises(SpecError) as caught:
        build({"sync.tolerance_seconds": -1, "alerts.severity": "P9", "sync.primary_key": None})
    assert len(str(caught.value).splitlines()) == 3


@pytest.mark.parametrize(
    ("changes", "disposition"),
    [
        ({"sync.mode": "full_refresh", "sync.cursor_field": None, "options": None}, "replace"),
        ({"sync.mode": "full_refresh", "sync.cursor_field": None,
          "options.write_disposition": "append"}, "append"),
        ({"options": None}, "append"),
        ({"source.type": "pg_cdc", "sync.mode": "cdc", "sync.cursor_field": None, "options": None},
         "merge"),
        ({"source.type": "pg_cdc", "sync.mode": "cdc", "sync.cursor_field": None,
          "options.write_disposition": "append"}, "merge"),
        ({"source.type": "pg_cdc", "sync.mode": "cdc", "sync.cursor_field": None,
          "options.write_disposition": "replace"}, "replace"),
    ],
)
def test_disposition(changes, disposition):
    assert build(changes).disposition == disposition

"""Reading ahead of a change stream, and applying changes without moving its positions."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest

from tidewell.operators import changes
from tidewell.sinks.dataset import Dataset
from tidewell.sources.changelog import LogConfig
from tidewell.streaming.change_stream import pending_changes, sync_changes

COLUMNS = "lsn bigint, tx_id bigint, op string, commit_ts timestamp_ntz, table_name string, id bigint, amount double"


@pytest.fixture
def log(spark, tmp_path):
    """The log's folder and schema, a target, a checkpoint, and a way to add changes."""
    path = str(tmp_path / "log")

    def add(*entries):
        rows = [(lsn, lsn, op, datetime(2025, 1, 1, 0, lsn), "orders", key, amount) for lsn, op, key, amount in entries]
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)

    add((1, "I", 1, 10.0), (2, "I", 2, 20.0))
    config = LogConfig(
        slot="s", tables=["orders"], log_path=path, snapshot_path=None, publish=changes.DEFAULT_PUBLISH,
        reset=False, include={}, hints={}, batch_size=1000, flush=True,
    )
    schema = spark.read.parquet(path).schema
    target = Dataset(spark, str(tmp_path / "out"), "raw")
    checkpoint = str(tmp_path / "cp")

    def drain(**other):
        sync_changes(spark, path, schema, target, replace(config, **other), ["id"], checkpoint)
        return sorted((r.id, r.amount) for r in target.read("orders", live_only=True).collect())

    def pending():
        return sorted(r.lsn for r in pending_changes(spark, path, schema, checkpoint).collect())

    return add, drain, pending


def test_pending_changes_leave_the_positions(log):
    add, drain, pending = log
    assert pending() == [1, 2]  # nothing was drained yet: all of the log
    assert drain() == [(1, 10.0), (2, 20.0)]
    assert pending() == []
    add((3, "U", 1, 11.0), (4, "D", 2, None), (5, "I", 3, 30.0))
    assert pending() == [3, 4, 5]
    assert pending() == [3, 4, 5]
    assert drain() == [(1, 11.0), (3, 30.0)]
    assert pending() == []


def test_run_without_flush_applies_and_keeps_positions(log):
    add, drain, pending = log
    drain()
    add((3, "U", 1, 11.0))
    assert drain(flush=False) == [(1, 11.0), (2, 20.0)]
    assert pending() == [3]
    assert drain() == [(1, 11.0), (2, 20.0)]  # the same change again changes nothing
    assert pending() == []


def test_reset_reads_the_whole_log_again(log):
    add, drain, pending = log
    drain()
    add((3, "D", 2, None))
    assert drain(reset=True) == [(1, 10.0)]
    assert pending() == []

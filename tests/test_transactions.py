"""A change log in batches of whole transactions."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from tidewell.operators import changes
from tidewell.operators.changes import transaction_cuts
from tidewell.sinks.dataset import Dataset
from tidewell.sources.changelog import LogConfig
from tidewell.streaming.transactions import (
    START,
    committed_position,
    drain_transactions,
    sync_transactions,
)

COLUMNS = "lsn bigint, tx_id bigint"


def brute_cuts(entries, size):
    """Cuts row by row: groups of overlapping transactions, dealt by the rows before each."""
    last = {}
    for lsn, tx in entries:
        last[tx if tx is not None else ("alone", lsn)] = lsn
    groups, reach = [], None
    for lsn, tx in sorted(entries):
        if reach is None or lsn > reach:
            groups.append([])
            reach = lsn
        reach = max(reach, last[tx if tx is not None else ("alone", lsn)])
        groups[-1].append(lsn)
    ends, before = {}, 0
    for group in groups:
        ends[before // size] = group[-1]
        before += len(group)
    return sorted(ends.values())


@pytest.mark.parametrize("seed", range(6))
def test_cuts_split_no_transaction(spark, seed):
    rng = random.Random(seed)
    entries = [
        (lsn, rng.choice([None, lsn // 9, lsn // 9 + 1, lsn // 30 + 500]))
        for lsn in sorted(rng.sample(range(4000), 400))
    ]
    for size, width in ((1, 64), (25, 7), (25, 1 << 24), (1000, 512)):
        log = spark.createDataFrame(sorted(entries, key=lambda e: str(e)), COLUMNS)
        found = sorted(r.end_lsn for r in transaction_cuts(log, size, width).collect())
        assert found == brute_cuts(sorted(entries), size)


def test_no_changes_no_cuts(spark, tmp_path):
    log = spark.createDataFrame([], COLUMNS)
    assert transaction_cuts(log).collect() == []
    assert drain_transactions(spark, log, str(tmp_path / "cp"), None, 10) == START


def test_failed_batch_comes_again_with_its_bounds(spark, tmp_path):
    log = spark.createDataFrame([(lsn, lsn // 3) for lsn in range(30)], COLUMNS)
    checkpoint, seen, failing = str(tmp_path / "cp"), [], [True]

    def handle(part, after, end):
        seen.append((after, end, sorted(r.lsn for r in part.collect())))
        if after == 11 and failing.pop():
            raise RuntimeError("lost")

    failing.append(True)
    with pytest.raises(Exception, match="lost"):
        drain_transactions(spark, log, checkpoint, handle, 12)
    assert committed_position(spark, checkpoint) == 11
    failing[:] = [False]
    assert drain_transactions(spark, log, checkpoint, handle, 12) == 29
    assert [s[:2] for s in seen] == [(-1, 11), (11, 23), (11, 23), (23, 29)]
    assert seen[1] == seen[2]
    assert sorted(lsn for s in (seen[0], seen[2], seen[3]) for lsn in s[2]) == list(range(30))
    assert drain_transactions(spark, log, checkpoint, handle, 12) == 29
    assert len(seen) == 4


def test_more_cuts_than_a_query_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidewell.streaming.transactions.CUTS_PER_QUERY", 2)
    log = spark.createDataFrame([(lsn, lsn // 2) for lsn in range(10)], COLUMNS)
    seen = []
    drain_transactions(spark, log, str(tmp_path / "cp"), lambda p, a, e: seen.append((a, e)), 2)
    assert seen == [(-1, 1), (1, 3), (3, 5), (5, 7), (7, 9)]


def test_without_flush_positions_stay(spark, tmp_path):
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    rows = [
        (lsn, lsn // 4, "I", datetime(2025, 1, 1), "a" if lsn % 2 else "b", lsn % 5, float(lsn))
        for lsn in range(20)
    ]
    log = spark.createDataFrame(
        rows, f"{COLUMNS}, op string, commit_ts timestamp_ntz, table_name string, id bigint, v double"
    )
    log.write.parquet(path)
    target = Dataset(spark, str(tmp_path / "out"), "raw")

    def drain(flush):
        config = LogConfig(
            slot="s", tables=["a", "b"], log_path=path, snapshot_path=None,
            publish=changes.DEFAULT_PUBLISH, reset=False, include={}, hints={}, batch_size=8,
            flush=flush,
        )
        sync_transactions(spark, path, log.schema, target, config, ["id"], checkpoint)
        return {t: sorted((r.id, r.v) for r in target.read(t).collect()) for t in config.tables}

    wanted = {
        t: sorted({r[5]: (r[5], r[6]) for r in rows if r[4] == t}.values()) for t in ("a", "b")
    }
    assert drain(False) == wanted
    assert committed_position(spark, checkpoint) == START
    assert drain(True) == wanted
    assert committed_position(spark, checkpoint) == 19

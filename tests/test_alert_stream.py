"""Alert suppression with keyed state: the rule over micro-batches, and what grows with the keys."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.test_alerts import brute
from tidewell.operators.alerts import suppress_alerts
from tidewell.plans.queries import alerting
from tidewell.session import ROCKSDB_PROVIDER
from tidewell.streaming.alert_stream import Suppressor, suppress_stream

T0 = datetime(2025, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, event_id bigint"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def drain(spark, root, parts, minutes, keys=("k",), schema=SCHEMA, **options):
    """A run of the stream after each part has come; the last run's progress comes along."""
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{root}/alerts")
        alerts = spark.readStream.schema(schema).parquet(f"{root}/alerts")
        flagged = suppress_stream(alerts, keys, "ts", "event_id", minutes, **options)
        running = (
            flagged.writeStream.format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    return spark.read.schema(flagged.schema).parquet(f"{root}/out").collect(), running.lastProgress


def in_thirds(alerts):
    ordered = sorted(alerts, key=lambda a: (a[1], a[2]))
    # A part ends where a time ends.
    cuts = [ordered[len(ordered) * i // 3][1] for i in (1, 2)]
    parts = [[], [], []]
    for alert in ordered:
        parts[sum(alert[1] >= c for c in cuts)].append(alert)
    for part in parts:
        random.Random(1).shuffle(part)
    return parts


@pytest.mark.parametrize("minutes", [7, 600])
def test_stream_equals_the_rule(spark, rocksdb, tmp_path, minutes):
    """A hot key, cold ones that share buckets with it, keys that look alike, and equal times."""
    rng = random.Random(minutes)
    hot = [("hot", T0 + timedelta(seconds=20 * (i // 2)), i) for i in range(2000)]
    names = [None, "null", "", '"', *(f"c{i}" for i in range(40))]
    cold = [
        (rng.choice(names), T0 + timedelta(seconds=rng.randrange(20000)), 9000 + i)
        for i in range(900)
    ]
    rows, _ = drain(spark, tmp_path, in_thirds(hot + cold), minutes, buckets=3)
    assert sorted((r.event_id, r.k) for r in rows) == sorted((a[2], a[0]) for a in hot + cold)
    assert {(r.event_id, r.k, r.ts) for r in rows} == {(a[2], a[0], a[1]) for a in hot + cold}
    assert {r.event_id for r in rows if not r.deduped} == brute(hot + cold, minutes)


def test_keys_that_differ_by_a_microsecond(spark, rocksdb, tmp_path):
    a, b = T0, T0 + timedelta(microseconds=1)
    alerts = [(a, None, T0, 0), (b, None, T0, 1), (a, 1, T0, 2), (a, None, T0 + timedelta(minutes=1), 3)]
    rows, _ = drain(
        spark, tmp_path, [alerts], 15, keys=["at", "n"], buckets=1,
        schema="at timestamp_ntz, n int, ts timestamp_ntz, event_id bigint",
    )
    assert {r.event_id for r in rows if not r.deduped} == {0, 1, 2}


def test_a_key_without_a_number_leaves_the_others_apart(spark, rocksdb, tmp_path):
    """Numbers beside a NULL reach Python as floats; as state keys they were all one."""
    rng = random.Random(3)
    alerts = [
        ((rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])), T0 + timedelta(seconds=7 * i), i)
        for i in range(1200)
    ]
    parts = [[(*key, ts, i) for key, ts, i in part] for part in in_thirds(alerts)]
    rows, _ = drain(
        spark, tmp_path, parts, 15, keys=["user", "kind"],
        schema="user bigint, kind string, ts timestamp_ntz, event_id bigint",
    )
    assert {((r.user, r.kind), r.ts, r.event_id) for r in rows} == set(alerts)
    assert {r.event_id for r in rows if not r.deduped} == brute(alerts, 15)


def test_calls_do_not_grow_with_the_keys(spark, rocksdb, tmp_path):
    """One state row is one call of a micro-batch: at most one a bucket, not one a key."""
    parts = [
        [(f"k{i}", T0 + timedelta(minutes=10 * n, seconds=i % 60), 5000 * n + i) for i in range(3000)]
        for n in range(3)
    ]
    rows, progress = drain(spark, tmp_path, parts, 15)
    assert progress["stateOperators"][0]["numRowsTotal"] <= 1024
    assert {r.event_id for r in rows if r.deduped} == {a[2] for a in parts[1]}


def test_an_alert_without_a_time_stops_the_stream(spark, rocksdb, tmp_path):
    with pytest.raises(StreamingQueryException, match="has no time"):
        drain(spark, tmp_path, [[("a", T0, 0), ("a", None, 1)]], 15)


def test_chunks_of_a_bucket_are_one_walk():
    """Without Spark: a bucket's rows come in frames, and leave in the same ones."""
    columns = ["k", "ts", "event_id", "micros", "name", "bucket"]
    times = [50, 0, 20, 10, 30, 31]
    rows = pd.DataFrame(
        [(n, t, i, t, n, 0) for i, (t, n) in enumerate(zip(times, "aabaab"))], columns=columns
    )

    class State:
        stored = None

        def exists(self):
            return self.stored is not None

        def get(self):
            return self.stored

        def update(self, value):
            self.stored = value

    suppressor = Suppressor(20, "event_id", columns[:3])
    suppressor.last = State()
    out = list(suppressor.handleInputRows((0,), iter([rows[:2].copy(), rows[2:].copy()]), None))
    assert [len(frame) for frame in out] == [2, 4]
    assert list(pd.concat(out)["deduped"]) == [False, False, False, True, False, True]
    later = pd.DataFrame(
        [(n, t, t, t, n, 0) for n, t in [("a", 69), ("b", 40), ("c", 41)]], columns=columns
    )
    out = list(suppressor.handleInputRows((0,), iter([later]), None))
    assert list(pd.concat(out)["deduped"]) == [True, False, False]


def test_query_writes_its_parts_with_all_tasks(spark, tmp_path, monkeypatch):
    """Three parts of a table in several files: no part passes through one task."""
    rng = random.Random(5)
    for n in range(4):
        events = [
            (
                i, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(30 * 86400)),
                rng.randrange(3), rng.choice("xy"),
            )
            for i in range(500 * n, 500 * (n + 1))
        ]
        frame = spark.createDataFrame(
            events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
        )
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(alerting, "new_scratch", lambda spark, label: f"{tmp_path}/{label}")
    # So that each file is read by a task of its own.
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        flagged = alerting.alert_dedup_stream(spark, str(tmp_path))
        files = [f for f in os.listdir(f"{tmp_path}/alert-stream/alerts") if f.endswith(".parquet")]
        events = spark.read.parquet(f"{tmp_path}/events.parquet")
        expected = suppress_alerts(events, ["user_id", "event_type"], "ts", "event_id", 15)
        assert len(files) == 12
        assert flagged.count() == 2000
        assert flagged.exceptAll(expected.select(flagged.columns)).count() == 0
        assert flagged.filter(F.col("deduped")).count() > 20
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")

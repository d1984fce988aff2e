import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewell.operators import alerts as module
from tidewell.operators.alerts import _carry, _carry_on, _compose, _entries, _sent, suppress_alerts

T0 = datetime(2025, 1, 1)


def brute(alerts, minutes):
    """The rule row by row: ids of the alerts that are sent."""
    last, sent = {}, set()
    for key, ts, event_id in sorted(alerts, key=lambda a: (a[1], a[2])):
        if minutes <= 0 or key not in last or ts - last[key] >= timedelta(minutes=minutes):
            last[key] = ts
            sent.add(event_id)
    return sent


def run(spark, alerts, minutes, parts):
    frame = spark.createDataFrame(alerts, "k string, ts timestamp_ntz, event_id bigint")
    flagged = suppress_alerts(frame, ["k"], "ts", "event_id", minutes, parts=parts)
    rows = flagged.collect()
    assert sorted(r.event_id for r in rows) == sorted(a[2] for a in alerts)
    return {r.event_id for r in rows if not r.deduped}


def at(*minutes):
    return [("k", T0 + timedelta(minutes=m), i) for i, m in enumerate(minutes)]


@pytest.mark.parametrize(
    ("alerts", "minutes", "sent"),
    [
        (at(0, 0), 15, {0}),
        (at(0, 14.99, 15), 15, {0, 2}),
        (at(0, 10, 20, 30), 15, {0, 2}),
        (at(0, 30), 5, {0, 1}),
        (at(0, 0, 0), 0, {0, 1, 2}),
    ],
)
def test_rule(spark, alerts, minutes, sent):
    assert run(spark, alerts, minutes, 4) == sent


def test_no_alerts(spark):
    assert run(spark, [], 15, 4) == set()


@pytest.mark.parametrize("minutes", [7, 15, 600])
def test_hot_key_cut_into_ranges(spark, minutes):
    """One key holds most alerts, a regular beat that never leaves a gap."""
    rng = random.Random(minutes)
    hot = [("hot", T0 + timedelta(seconds=20 * i), i) for i in range(3000)]
    cold = [
        (f"c{rng.randrange(5)}", T0 + timedelta(seconds=rng.randrange(90000)), 10000 + i)
        for i in range(700)
    ]
    alerts = hot + cold
    rng.shuffle(alerts)
    assert run(spark, alerts, minutes, 13) == brute(alerts, minutes)


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(1, 25),
    st.lists(st.integers(1, 39), max_size=6),
)
def test_chained_ranges_equal_one_walk(times, window, cuts):
    """Without Spark: cutting a walk anywhere and chaining the parts changes nothing."""
    import numpy as np
    import pandas as pd

    times = np.sort(np.asarray(times, dtype=np.int64))
    whole = _sent(times, window, None)
    edges = sorted({0, len(times), *[c for c in cuts if c < len(times)]})
    table = [
        ("k", part, to, on)
        for part, (a, b) in enumerate(zip(edges, edges[1:]))
        for to, on in _entries(times[a:b], window)
    ]
    frame = pd.DataFrame(table, columns=["__key", "__part", "enters_to", "leaves_on"])
    carried = _carry(window)(frame).sort_values("__part")["__last"]
    found = []
    for (a, b), last in zip(zip(edges, edges[1:]), carried):
        last = None if pd.isna(last) else int(last)
        found += [a + i for i in _sent(times[a:b], window, last)]
    assert found == whole


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.integers(0, 90), min_size=1, max_size=60), st.integers(1, 40),
    st.lists(st.integers(1, 59), max_size=20), st.integers(2, 4),
)
def test_composed_blocks_equal_one_walk(times, window, cuts, block):
    """Without Spark: the ranges' tables composed in blocks, and handed down again."""
    import numpy as np
    import pandas as pd

    names = ["__key", "__part", "enters_to", "leaves_on"]
    times = np.sort(np.asarray(times, dtype=np.int64))
    edges = sorted({0, len(times), *[c for c in cuts if c < len(times)]})
    levels = [
        pd.DataFrame(
            [
                ("k", part, to, on)
                for part, (a, b) in enumerate(zip(edges, edges[1:]))
                for to, on in _entries(times[a:b], window)
            ],
            columns=names,
        )
    ]
    before = module.BLOCK
    module.BLOCK = block
    try:
        while levels[-1]["__part"].max() >= block:
            blocks = levels[-1].groupby(levels[-1]["__part"] // block)
            levels.append(pd.concat([_compose(window)(rows) for _, rows in blocks])[names])
    finally:
        module.BLOCK = before
    carried = _carry(window)(levels.pop()).dropna()
    while levels:
        tables = levels.pop()
        parts = [
            _carry_on(window)(rows, carried[carried["__part"] == n])
            for n, rows in tables.groupby(tables["__part"] // block)
        ]
        carried = pd.concat(parts).dropna()
    lasts = dict(zip(carried["__part"], carried["__last"]))
    found = []
    for part, (a, b) in enumerate(zip(edges, edges[1:])):
        last = int(lasts[part]) if part in lasts else None
        found += [a + i for i in _sent(times[a:b], window, last)]
    assert found == _sent(times, window, None)


@pytest.mark.parametrize("minutes", [9, 33, 20000])
def test_more_ranges_than_a_block(spark, minutes):
    """Three levels of blocks; windows within a range, of about one, and of all ranges."""
    rng = random.Random(minutes)
    hot = [("hot", T0 + timedelta(seconds=20 * i + rng.randrange(9)), i) for i in range(2000)]
    cold = [(f"c{i % 3}", T0 + timedelta(seconds=rng.randrange(40000)), 9000 + i) for i in range(90)]
    assert run(spark, hot + cold, minutes, 70) == brute(hot + cold, minutes)


def test_no_group_holds_more_than_a_block(spark, monkeypatch):
    """Tables that meet in one group are counted where they are read."""
    most = module.BLOCK

    def check(tables):
        assert tables["__part"].nunique() <= most

    def one(make):
        def outer(window):
            inner = make(window)
            return lambda tables: (check(tables), inner(tables))[1]

        return outer

    def two(make):
        def outer(window):
            inner = make(window)
            return lambda tables, before: (check(tables), inner(tables, before))[1]

        return outer

    monkeypatch.setattr(module, "_compose", one(module._compose))
    monkeypatch.setattr(module, "_carry_on", two(module._carry_on))
    alerts = [("hot", T0 + timedelta(seconds=20 * i), i) for i in range(1500)]
    assert run(spark, alerts, 15, 70) == brute(alerts, 15)

"""Alert rows and their suppression window."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalars import route
from tidewell.session import shared_root

# The helpers below run in Python workers: send them along, so that this package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Severities and kinds of alert.
SEVERITIES = ("P1", "P2", "info")
KINDS = ("failure", "schema", "sla", "heartbeat")

_PART, _KEY, _TIME, _LAST = "__part", "__key", "__micros", "__last"
_ENTRY_SCHEMA = f"{_KEY} string, {_PART} int, enters_to bigint, leaves_on bigint"
_CARRY_SCHEMA = f"{_KEY} string, {_PART} int, {_LAST} bigint"
BLOCK = 8


def _segments(keys: pa.Array) -> list[tuple[int, int]]:
    """Index ranges of equal neighbours."""
    if len(keys) == 0:
        return []
    changed = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))
    cuts = (np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(keys)]))


def _sent(times: np.ndarray, window: int, last: int | None) -> list[int]:
    """Positions sent when ``last`` was sent before: jump from one to the first alert at least
    a window later, so the work follows the alerts sent rather than all of them."""
    found: list[int] = []
    i = 0 if last is None else int(np.searchsorted(times, last + window))
    while i < len(times):
        found.append(i)
        i = int(np.searchsorted(times, times[i] + window))
    return found


def _entries(times: np.ndarray, window: int) -> list[tuple[int, int]]:
    """How a walk passes this stretch: ``(enters_to, leaves_on)`` says that a walk entering
    at or before that time, but after the row above, last sends at ``leaves_on``. The walk
    enters at most one window after the first alert, and entries that leave alike share a row."""
    here = np.arange(len(times))
    following = np.searchsorted(times, times + window)
    following = np.where(following < len(times), following, here)
    # Doubling the jump until it settles leads every alert to the last one of its walk.
    while not np.array_equal(jumped := following[following], following):
        following = jumped
    reach = min(int(np.searchsorted(times, times[0] + window)) + 1, len(times))
    leaves = times[following[:reach]]
    ends = np.append(np.flatnonzero(leaves[1:] != leaves[:-1]), reach - 1)
    return [(int(times[i]), int(leaves[i])) for i in ends]


def _summarize(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = rows[_KEY].chunk(0)
        times = rows[_TIME].chunk(0).to_numpy()
        segments = _segments(keys)
        out: list[tuple[str, int, int, int]] = []
        # Keys between the first and the last lie in this part alone: nothing to hand over.
        for start, stop in sorted({segments[0], segments[-1]}):
            for enters_to, leaves_on in _entries(times[start:stop], window):
                out.append((keys[start].as_py(), rows[_PART][0].as_py(), enters_to, leaves_on))
        columns = [list(c) for c in zip(*out)]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=[_KEY, _PART, "enters_to", "leaves_on"],
        )

    return run


def _through(tables: pd.DataFrame, window: int) -> list[tuple[int, int]]:
    """How a walk passes neighbouring ranges one after the other: their tables as a single one."""
    enters: np.ndarray | None = None
    for _, rows in tables.sort_values([_PART, "enters_to"]).groupby(_PART, sort=True):
        to, on = rows["enters_to"].to_numpy(), rows["leaves_on"].to_numpy()
        if enters is None:
            enters, leaves = to, on
            continue
        # Walks that send before this range come into it with their last alert ...
        at = np.searchsorted(to, leaves + window)
        passed = np.where(at < len(to), on[np.minimum(at, len(to) - 1)], leaves)
        # ... and those that were to send after all of it come into this one unchanged.
        later = to > enters[-1]
        enters, leaves = np.append(enters, to[later]), np.append(passed, on[later])
    ends = np.append(np.flatnonzero(leaves[1:] != leaves[:-1]), len(leaves) - 1)
    return [(int(enters[i]), int(leaves[i])) for i in ends]


def _compose(window: int):
    """The tables of a block of ranges as the table of one wider range."""

    def run(tables: pd.DataFrame) -> pd.DataFrame:
        rows = _through(tables, window)
        return pd.DataFrame(
            {
                _KEY: tables[_KEY].iloc[0], _PART: int(tables[_PART].iloc[0]) // BLOCK,
                "enters_to": [r[0] for r in rows], "leaves_on": [r[1] for r in rows],
            }
        )

    return run


def _carry_on(window: int):
    """The last alert sent before each of a block's ranges, given the one before the block."""

    def run(tables: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, int, int | None]] = []
        last = int(before[_LAST].iloc[0]) if len(before) else None
        for part, rows in tables.sort_values([_PART, "enters_to"]).groupby(_PART, sort=True):
            out.append((rows[_KEY].iloc[0], part, last))
            entry = 0
            if last is not None:
                entry = int(np.searchsorted(rows["enters_to"].to_numpy(), last + window))
            if entry < len(rows):
                last = int(rows["leaves_on"].iloc[entry])
        return pd.DataFrame(out, columns=[_KEY, _PART, _LAST]).astype({_LAST: "Int64"})

    return run


def _carry(window: int):
    """The same for a key's first block."""
    carry_on, nothing = _carry_on(window), pd.DataFrame()
    return lambda tables: carry_on(tables, nothing)


def _handed_over(entries: DataFrame, window: int, parts: int) -> DataFrame:
    """``(key, part, last)``: the last alert sent before each range, where there is one.

    The tables of neighbouring ranges of a key are composed in blocks of ``BLOCK``, those of the
    blocks again, until a key has one block; then each block tells its members what they get. So
    no group holds more than ``BLOCK`` tables, however many ranges a key has, in a number of
    rounds that grows with the logarithm of the ranges.
    """
    levels = [entries]
    reach = BLOCK
    while reach < parts:
        # Read on the way up and on the way down.
        levels[-1] = levels[-1].checkpoint()
        block = F.expr(f"cast({_PART} div {BLOCK} as int)")
        levels.append(levels[-1].groupBy(_KEY, block).applyInPandas(_compose(window), _ENTRY_SCHEMA))
        reach *= BLOCK
    carried = levels.pop().groupBy(_KEY).applyInPandas(_carry(window), _CARRY_SCHEMA)
    carried = carried.filter(F.col(_LAST).isNotNull())
    while levels:
        members = levels.pop().groupBy(_KEY, F.expr(f"cast({_PART} div {BLOCK} as int)"))
        carried = (
            members.cogroup(carried.groupBy(_KEY, _PART))
            .applyInPandas(_carry_on(window), _CARRY_SCHEMA).filter(F.col(_LAST).isNotNull())
        )
    return carried


def _flag(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: str | None = None
        last: int | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(_KEY)
            times = batch.column(_TIME).to_numpy()
            handed = batch.column(_LAST)
            deduped = np.ones(batch.num_rows, dtype=bool)
            for start, stop in _segments(keys):
                if keys[start].as_py() != key:
                    key, last = keys[start].as_py(), handed[start].as_py()
                sent = _sent(times[start:stop], window, last)
                if sent:
                    deduped[[start + i for i in sent]] = False
                    last = int(times[start + sent[-1]])
            kept = [n for n in batch.schema.names if n not in (_PART, _KEY, _TIME, _LAST)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array(deduped)], names=[*kept, "deduped"]
            )

    return run


def suppress_alerts(
    alerts: DataFrame, keys: Sequence[str], ts: str, tie: str, window_minutes: float,
    parts: int | None = None,
) -> DataFrame:
    """Every alert with ``deduped``: true while the last *sent* alert of its key is less than
    a window old. An alert exactly one window later is sent; a window of 0 sends everything.
    ``ts`` must not be NULL, and ``tie`` orders alerts of one instant.

    The rule is a walk along each key's alerts. A hot key's walk is not run in one task: the
    alerts are sorted into ranges of key and time that may cut through a key, each range
    tells how a walk would pass it, these short tables are composed in blocks of neighbours,
    and every range then flags its rows knowing how its first key came in. The sorted ranges are
    checkpointed, so that all steps see the same ones and a lost executor costs no re-sort.
    """
    if window_minutes <= 0:
        return alerts.withColumn("deduped", F.lit(False))
    spark = alerts.sparkSession
    shared_root(spark)
    window = round(window_minutes * 60_000_000)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        alerts.withColumn(_KEY, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
        .withColumn(_TIME, F.unix_micros(F.col(ts).cast("timestamp")))
        .repartitionByRange(parts, _KEY, _TIME, tie)
        .sortWithinPartitions(_KEY, _TIME, tie)
        .withColumn(_PART, F.spark_partition_id())
        .checkpoint()
    )
    entries = ranged.select(_KEY, _PART, _TIME).mapInArrow(_summarize(window), _ENTRY_SCHEMA)
    carried = _handed_over(entries, window, parts)
    # At most two keys per range: the size is bounded by the number of ranges.
    joined = ranged.join(F.broadcast(carried), [_KEY, _PART], "left")
    schema = T.StructType([*alerts.schema.fields, T.StructField("deduped", T.BooleanType())])
    return joined.select(*alerts.columns, _PART, _KEY, _TIME, _LAST).mapInArrow(
        _flag(window), schema
    )


def alert_text(kind: Column, severity: Column, subject: Column) -> Column:
    """The one-line text of an alert."""
    label = F.concat(F.lit("["), severity, F.lit("] "))
    # The wording of the four kinds.
    return (
        F.when(kind == "failure", F.concat(label, F.lit("pipeline `"), subject, F.lit("` failed")))
        .when(kind == "schema", F.concat(F.lit("[info] schema evolution in `"), subject, F.lit("`")))
        .when(kind == "sla", F.concat(label, F.lit("SLA miss in `"), subject, F.lit("`")))
        .when(kind == "heartbeat", F.concat(label, F.lit("`"), subject, F.lit("` heartbeat stale")))
    )


def alert_rows(events: DataFrame, channels: Mapping[str, str]) -> DataFrame:
    """``events(ts, event_id, pipeline, kind, severity, channel_override)`` with the routed
    channel, the text and the JSON payload; a payload without a channel leaves the choice to
    whoever delivers it. Schema changes are always informational."""
    severity = F.when(F.col("kind") == "schema", F.lit("info")).otherwise(F.col("severity"))
    channel = route(F.col("channel_override"), F.col("severity"), channels)
    text = alert_text(F.col("kind"), F.col("severity"), F.col("pipeline"))
    routed = events.withColumn("severity", severity).select(
        "ts", "event_id", "pipeline", "kind", "severity", channel.alias("channel"),
        text.alias("text"),
    )
    return routed.withColumn("payload", F.to_json(F.struct("channel", "text")))

"""Alert suppression as a stateful stream: the last sent time per key is the only state."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MICROS, _NAME, _BUCKET = "__micros", "__name", "__bucket"
# Keys that differ must differ as text, so times keep their microseconds.
_AS_TEXT = {
    "ignoreNullFields": "false",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _unpacked(table: bytes) -> dict[str, int]:
    columns = pa.ipc.open_stream(table).read_all()
    return dict(zip(columns["key"].to_pylist(), columns["micros"].to_pylist()))


def _packed(last: dict[str, int]) -> bytes:
    columns = pa.table(
        {"key": pa.array(last.keys(), pa.string()), "micros": pa.array(last.values(), pa.int64())}
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, columns.schema) as writer:
        writer.write_table(columns)
    return sink.getvalue().to_pybytes()


class Suppressor(StatefulProcessor):
    """Flags the alerts of a bucket of keys in time order within a micro-batch; batches must come
    in time order. A call for each key would cost several trips to the state store and a frame of
    a few rows, some milliseconds a key; a bucket's keys share them."""

    def __init__(self, window: int, tie: str, columns: Sequence[str]) -> None:
        self.window = window
        self.tie = tie
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_sent", "by_key binary")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        codes: dict[str, int] = {}
        chunks, of_key, micros = [], [], []
        for chunk in rows:
            # Names that start with an underscore do not survive the way here; the order does.
            chunk.columns = [*self.columns, _MICROS, _NAME, _BUCKET]
            if chunk[_MICROS].isna().any():
                raise ValueError("an alert has no time")
            of_key.append(np.array([codes.setdefault(n, len(codes)) for n in chunk[_NAME]]))
            micros.append(chunk[_MICROS].to_numpy(np.int64))
            chunks.append(chunk[self.columns])
        keyed, times = np.concatenate(of_key), np.concatenate(micros)
        ties, values = pd.factorize(pd.concat([c[self.tie] for c in chunks]), sort=True)
        ties[ties < 0] = len(values)
        order = np.lexsort((ties, times, keyed))
        stored = self.last.get() if self.last.exists() else None
        last = {} if stored is None else _unpacked(bytes(stored[0]))
        edges = np.searchsorted(keyed[order], np.arange(len(codes) + 1)).tolist()
        found = self._sent(times[order].tolist(), list(codes), edges, last)
        deduped = np.ones(len(order), dtype=bool)
        deduped[order[found]] = False
        if found:
            self.last.update((_packed(last),))
        start = 0
        for chunk in chunks:
            yield chunk.assign(deduped=deduped[start : start + len(chunk)])
            start += len(chunk)

    def _sent(
        self, times: list[int], names: list[str], edges: list[int], last: dict[str, int]
    ) -> list[int]:
        """Positions sent in the sorted alerts, where ``edges`` part the keys; ``last`` takes each
        key's last one. The walk jumps from one to the first alert at least a window later."""
        found: list[int] = []
        for name, start, stop in zip(names, edges, edges[1:]):
            sent = last.get(name)
            i = start if sent is None else bisect_left(times, sent + self.window, start, stop)
            while i < stop:
                found.append(i)
                sent = times[i]
                i = bisect_left(times, sent + self.window, i + 1, stop)
            last[name] = sent
        return found

    def close(self) -> None:
        pass


def suppress_stream(
    alerts: DataFrame, keys: Sequence[str], ts: str, tie: str, window_minutes: float,
    buckets: int = 1024,
) -> DataFrame:
    """The streaming form of ``suppress_alerts``. Rows of a micro-batch are bounded by the
    source's trigger limits; between batches a key costs its name and one number.

    Keys are dealt by hash into ``buckets``, whose state is read and written as a whole by a batch
    that brings one of its keys. A bucket costs some milliseconds a batch; some thousand keys in
    each are a good aim. The number is fixed by the first run of a checkpoint.
    """
    if window_minutes <= 0:
        return alerts.withColumn("deduped", F.lit(False))
    schema = T.StructType([*alerts.schema.fields, T.StructField("deduped", T.BooleanType())])
    name = F.to_json(F.struct(*[F.col(k).alias(str(i)) for i, k in enumerate(keys)]), _AS_TEXT)
    timed = (
        alerts.withColumn(_MICROS, F.unix_micros(F.col(ts).cast("timestamp")))
        .withColumn(_NAME, name)
        .withColumn(_BUCKET, F.pmod(F.xxhash64(_NAME), F.lit(buckets)).cast("int"))
    )
    return timed.groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=Suppressor(round(window_minutes * 60_000_000), tie, alerts.columns),
        outputStructType=schema, outputMode="Append", timeMode="None",
    )

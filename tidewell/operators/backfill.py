"""Chunked history: bounds, assignment of rows to chunks, resuming."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.durations import parse_duration
from tidewell.operators.incremental import cursor_literal

CHUNK_SCHEMA = "chunk_id bigint, chunk_start timestamp_ntz, chunk_end timestamp_ntz"
MAX_CHUNKS = 1_000_000
# So many ranges become comparisons of their own.
FEW_RANGES = 16

Range = tuple[datetime, datetime]


def chunk_bounds(start: datetime, end: datetime, size: str) -> list[tuple[datetime, datetime]]:
    """Half-open chunks over ``[start, end)``, the last one clipped at ``end``.

    Calendar steps are counted from ``start``, so P1M from 31 January does not drift.
    """
    if start >= end:
        raise ValueError(f"start {start} must precede end {end}")
    step = parse_duration(size)
    if step.after(start) <= start:
        raise ValueError(f"chunk size {size!r} must be longer than zero")
    bounds: list[tuple[datetime, datetime]] = []
    current = start
    while current < end:
        upper = min(step.times(len(bounds) + 1).after(start), end)
        bounds.append((current, upper))
        current = upper
        if len(bounds) > MAX_CHUNKS:
            raise ValueError(f"chunk size {size!r} cuts the range into over {MAX_CHUNKS} chunks")
    return bounds


def chunk_table(spark: SparkSession, start: datetime, end: datetime, size: str) -> DataFrame:
    rows = [(i, lower, upper) for i, (lower, upper) in enumerate(chunk_bounds(start, end, size))]
    return spark.createDataFrame(rows, CHUNK_SCHEMA)


def chunk_id(
    cursor: Column, dtype: T.DataType, start: datetime, end: datetime, size: str
) -> Column:
    """Number of the chunk a row falls in; NULL outside the range.

    Fixed sizes are plain arithmetic, which needs no join. Calendar sizes look the row up in
    the sorted bounds.
    """
    lower, upper = cursor_literal(start, dtype), cursor_literal(end, dtype)
    step = parse_duration(size)
    if step.is_fixed:
        micros = round(step.span.total_seconds() * 1_000_000)
        if micros <= 0:
            raise ValueError(f"chunk size {size!r} must be longer than zero")
        offset = F.unix_micros(cursor.cast("timestamp")) - F.unix_micros(lower.cast("timestamp"))
        number = F.floor(offset / F.lit(micros))
        # Division is in floating point: settle values next to a bound exactly.
        number = number - F.when(number * micros > offset, 1).otherwise(0)
        number = number + F.when((number + 1) * micros <= offset, 1).otherwise(0)
    else:
        number = range_number(cursor, dtype, [b[0] for b in chunk_bounds(start, end, size)])
    return F.when((cursor >= lower) & (cursor < upper), number.cast("bigint"))


def range_number(cursor: Column, dtype: T.DataType, starts: Sequence[datetime]) -> Column:
    """How many of the sorted starts are at or below the cursor, less one: a binary search."""
    bounds = F.array(*[cursor_literal(s, dtype) for s in starts])
    steps = [1 << k for k in reversed(range(len(starts).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(-1),
        lambda at, step: F.when(F.get(bounds, at + step) <= cursor, at + step).otherwise(at),
    )


def joined_ranges(ranges: Sequence[Range]) -> list[Range]:
    """Half-open ranges as few as possible: those that meet or overlap become one."""
    out: list[Range] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def in_ranges(cursor: Column, dtype: T.DataType, ranges: Sequence[Range]) -> Column:
    """Whether the cursor lies in one of the sorted ranges, which are apart from each other.

    A few ranges are compared one by one, so that all bounds reach the scan. Of many the outer
    bounds do, and each row is then looked up by binary search.
    """
    if len(ranges) <= FEW_RANGES:
        inside = F.lit(False)
        for lower, upper in ranges:
            inside = inside | ((cursor >= cursor_literal(lower, dtype)) & (cursor < cursor_literal(upper, dtype)))
        return inside
    outer = (cursor >= cursor_literal(ranges[0][0], dtype)) & (cursor < cursor_literal(ranges[-1][1], dtype))
    ends = F.array(*[cursor_literal(r[1], dtype) for r in ranges])
    return outer & (cursor < F.get(ends, range_number(cursor, dtype, [r[0] for r in ranges])))


def range_counts(df: DataFrame, cursor: str, ranges: Sequence[Range]) -> list[int]:
    """Rows of every range, in order; the ranges are sorted and apart from each other."""
    number = range_number(F.col(cursor), df.schema[cursor].dataType, [r[0] for r in ranges])
    counts = df.select(number.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {row["k"]: row["n"] for row in counts}
    return [found.get(k, 0) for k in range(len(ranges))]


def backfill_counts(
    df: DataFrame, cursor: str, start: datetime, end: datetime, size: str
) -> DataFrame:
    """Rows per chunk, empty chunks included."""
    number = chunk_id(F.col(cursor), df.schema[cursor].dataType, start, end, size)
    counts = (
        df.select(number.alias("chunk_id")).filter(F.col("chunk_id").isNotNull())
        .groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))
    )
    chunks = chunk_table(df.sparkSession, start, end, size)
    return chunks.join(counts, "chunk_id", "left").fillna(0, ["n_rows"])


def uncovered(chunk: Range, done: Sequence[Range]) -> list[Range]:
    """The parts of a half-open chunk that none of the ``done`` ranges covers; these are half-open,
    sorted and apart from each other."""
    lower, upper = chunk
    parts: list[Range] = []
    for k in range(bisect_right(done, lower, key=lambda r: r[1]), len(done)):
        start, end = done[k]
        if start >= upper:
            break
        if start > lower:
            parts.append((lower, start))
        lower = max(lower, end)
    return [*parts, (lower, upper)] if lower < upper else parts


def pending_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """What of the chunks no finished load covers yet, whatever bounds and chunk size it had.

    A chunk that is covered in part leaves one row, with its ``chunk_id``, per remaining part.
    Bounds meet on the driver: at most ``MAX_CHUNKS`` chunks, and one range per finished load.
    """
    ranges = joined_ranges([tuple(r) for r in done.select("chunk_start", "chunk_end").collect()])
    parts = [
        (number, *part)
        for number, lower, upper in chunks.select("chunk_id", "chunk_start", "chunk_end").collect()
        for part in uncovered((lower, upper), ranges)
    ]
    return chunks.sparkSession.createDataFrame(parts, CHUNK_SCHEMA)

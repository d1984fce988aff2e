"""Cursor filters, cursor state and row limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.durations import fixed_seconds

_INSTANTS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def lag_seconds(tolerance_seconds: float = 0, lookback: str | None = None) -> float | None:
    """Width of the trailing window to read again; both settings add up, None if there is none."""
    total = float(tolerance_seconds) + (fixed_seconds(lookback) if lookback else 0.0)
    return total if total > 0 else None


def cursor_literal(value: Any, dtype: T.DataType) -> Column:
    """A bound as a literal of the cursor's own type, so that the filter reaches the scan.

    Zone-aware datetimes are taken to UTC first; naive cursor columns hold UTC by convention.
    """
    if isinstance(value, datetime) and value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
        if isinstance(dtype, T.TimestampType):
            value += "+00:00"
    return F.lit(value).cast(dtype)


def check_cursor(frames: Mapping[str, DataFrame], cursor: str) -> None:
    """Every table of an incremental source must carry the cursor column."""
    missing = sorted(name for name, df in frames.items() if cursor not in df.columns)
    if missing:
        raise ValueError(f"cursor column {cursor!r} is missing on {', '.join(missing)}")


def incremental_filter(
    df: DataFrame, cursor: str, last: Any = None, lag: float | None = None,
    keep_null: bool = False,
) -> DataFrame:
    """Rows at or after the stored cursor less the lag; everything while nothing is stored.

    The bound is inclusive, so that rows sharing the last cursor value are not lost; keyed
    merges make the repeated ones harmless. Rows without a cursor value have no place in that
    order: ``keep_null`` reads them every time, so that none is lost.
    """
    if last is None:
        return df
    dtype = df.schema[cursor].dataType
    bound = cursor_literal(last, dtype)
    if lag:
        if isinstance(dtype, _INSTANTS):
            bound = (bound - F.make_dt_interval(secs=F.lit(lag))).cast(dtype)
        else:
            bound = bound - F.lit(lag).cast(dtype)
    fresh = F.col(cursor) >= bound
    return df.filter(fresh | F.col(cursor).isNull() if keep_null else fresh)


def bounded_range(df: DataFrame, cursor: str, start: Any, end: Any) -> DataFrame:
    """Rows of the half-open range ``[start, end)``."""
    dtype = df.schema[cursor].dataType
    lower, upper = cursor_literal(start, dtype), cursor_literal(end, dtype)
    return df.filter((F.col(cursor) >= lower) & (F.col(cursor) < upper))


def drop_loaded(df: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Leave out rows that an appending load would store twice: those that the target holds
    with equal ``columns`` (NULL equals NULL). Pass only the target's re-read range."""
    seen = target.select(*[F.col(c).alias(f"__seen_{c}") for c in columns])
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__seen_{c}")) for c in columns]
    )
    return df.join(seen, same, "left_anti")


def cursor_state(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """The highest cursor per table, with row and null counts, rendered as text."""
    rows = [
        df.agg(
            F.max(cursor).cast("string").alias("cursor_value"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(cursor).isNull()).alias("null_cursors"),
        ).select(F.lit(table).alias("table_name"), "cursor_value", "rows", "null_cursors")
        for table, (df, cursor) in frames.items()
    ]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def advance(old: Column, new: Column) -> Column:
    """A cursor never moves back."""
    return F.greatest(old, new)


def limit_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a stated order (a top-k, not a sort of the whole table)."""
    return df.orderBy(*order_by).limit(n)


def limit_by_cursor(df: DataFrame, n: int, cursor: str, last: Any = None) -> DataFrame:
    """The first ``n`` rows by cursor behind ``last``, and all others that share the last one's
    value, so that nothing at or before the highest value taken is left behind and every run gets
    further. Rows at or before ``last`` that ``df`` still holds (those read again) come along.
    Rows without a value wait until nothing else is behind ``last``."""
    behind = F.col(cursor).isNotNull()
    if last is not None:
        behind = F.col(cursor) > cursor_literal(last, df.schema[cursor].dataType)
    edge = df.select(cursor).filter(behind).orderBy(cursor).limit(n)
    edge = edge.agg(F.max(cursor).alias("__edge"))
    taken = F.when(F.col("__edge").isNotNull(), F.col(cursor) <= F.col("__edge")).otherwise(True)
    return df.join(F.broadcast(edge), taken).drop("__edge")

"""Keyed dedup and upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def as_key(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def dedup_latest(
    df: DataFrame, key: str | Sequence[str], order_by: Sequence[str | Column]
) -> DataFrame:
    """The last row per key under ``order_by``, which must be a total order within a key.

    Filtering a row number to 1 lets Spark keep one row per key in every map task before the
    shuffle, so a key that holds a third of all rows reaches its reducer as one row per task.
    """
    latest = [(F.col(c) if isinstance(c, str) else c).desc() for c in order_by]
    ranked = df.withColumn(
        _RANK, F.row_number().over(Window.partitionBy(*as_key(key)).orderBy(*latest))
    )
    return ranked.filter(F.col(_RANK) == 1).drop(_RANK)


def merge_upsert(
    base: DataFrame, delta: DataFrame, key: str | Sequence[str], small_delta: bool = False
) -> DataFrame:
    """``base`` with every row of ``delta`` added or replaced by key.

    ``delta`` holds one row per key. Say ``small_delta`` only after its size was checked: its
    keys are then broadcast and the base is not shuffled. Otherwise Spark decides, and falls
    back to a shuffle join with run-time skew handling.
    """
    columns = as_key(key)
    keys = delta.select(*columns)
    kept = base.join(F.broadcast(keys) if small_delta else keys, columns, "left_anti")
    return kept.unionByName(delta, allowMissingColumns=True)


def replace_children(
    base: DataFrame, delta: DataFrame, parent_key: Sequence[str], pos: str,
    small_delta: bool = False,
) -> DataFrame:
    """``base`` with all children of the delta's parents replaced by the delta's. A parent
    whose row has no position has no children any more."""
    parents = delta.select(*parent_key).distinct()
    kept = base.join(F.broadcast(parents) if small_delta else parents, list(parent_key), "left_anti")
    return kept.unionByName(delta.filter(F.col(pos).isNotNull()), allowMissingColumns=True)


def null_key(key: str | Sequence[str]) -> Column:
    """True where any part of the key is NULL; such rows can never be matched again."""
    parts = [F.col(c).isNull() for c in as_key(key)]
    condition = parts[0]
    for part in parts[1:]:
        condition = condition | part
    return condition

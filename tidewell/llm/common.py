"""Helpers shared by the operators: staged tables, row numbers, hot-key joins, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import new_scratch

# A key that holds at least 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def stage(frame: DataFrame, label: str) -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and read it back: lineage ends here."""
    spark = frame.sparkSession
    path = new_scratch(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Equality of the named columns, with null equal to null."""
    return reduce(Column.__and__, (left[c].eqNullSafe(right[c]) for c in columns))


def numbered(frame: DataFrame, order: list[str], label: str, name: str = "at") -> DataFrame:
    """Add gapless positions from 0 in the given order, nulls first.

    Rows are range-partitioned and sorted, so no single task sees them all. Every task numbers
    its own rows; the tasks' row counts (one row per task) give the offsets. Rows that tie in all
    of ``order`` are numbered in any order, so ``order`` should name what tells rows apart.
    """
    spark = frame.sparkSession
    sorted_rows = (
        frame.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_local", F.monotonically_increasing_id())
    )
    staged = stage(sorted_rows, label)
    task = F.shiftright("_local", 33)
    counts = {
        r["task"]: r["n"]
        for r in staged.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()
    }
    offsets, before = [], 0
    for key in sorted(counts):
        offsets.append((key, before))
        before += counts[key]
    table = spark.createDataFrame(offsets, "_task int, _before long")
    return (
        staged.withColumn("_task", task.cast("int"))
        .join(F.broadcast(table), "_task")
        .withColumn(name, F.col("_before") + F.col("_local").bitwiseAND((1 << 33) - 1))
        .drop("_task", "_before", "_local")
    )


def join_by_key(
    rows: DataFrame, keys: DataFrame, on: str, weight: str, total: int, how: str = "inner"
) -> DataFrame:
    """Join many rows with one row per key, where one key may hold a large share of the rows.

    ``keys`` carries how many rows each key has (``weight``), of ``total`` in all. Keys with at
    least a thousandth of the rows are at most a thousand, so these are broadcast and their rows
    stay where they are; all others are joined by a shuffle that has no such key.
    """
    bound = max(1, total // HOT_SHARE)
    hot = keys.filter(F.col(weight) >= bound)
    hot_keys = F.broadcast(hot.select(on))
    first = rows.join(F.broadcast(hot), on, "inner")
    rest = rows.join(hot_keys, on, "left_anti").join(
        keys.filter(F.col(weight) < bound), on, how
    )
    return first.unionByName(rest)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node of each connected component of the edges (a, b).

    Rounds of hooking and pointer jumping: each node takes the smallest root among its
    neighbours' roots, then roots follow their own roots. All steps are joins and aggregations;
    only the number of changed nodes reaches the driver. Edge columns must not be null.
    """
    both = stage(
        edges.select("a", "b")
        .filter("a <> b")
        .unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(),
        f"{label}-edges",
    )
    state = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")),
        f"{label}-roots",
    )
    while True:
        # the smallest root seen from a node's neighbourhood, offered to the node and to its root
        seen = (
            both.join(state.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("rb").alias("offer"))
        )
        offers = state.join(seen, "node").select("node", "root", F.least("root", "offer").alias("m"))
        hooked = (
            offers.select("node", F.col("m"))
            .unionByName(offers.select(F.col("root").alias("node"), "m"))
            .groupBy("node")
            .agg(F.min("m").alias("m"))
        )
        jumped = hooked.join(
            hooked.select(F.col("node").alias("m"), F.col("m").alias("mm")), "m", "left"
        ).select("node", F.coalesce("mm", "m").alias("root"))
        new = stage(jumped, f"{label}-roots")
        old = state.select("node", F.col("root").alias("was"))
        changed = new.join(old, "node").filter("root <> was").limit(1).count()
        state = new
        if not changed:
            return state

"""Sharding by a minimax contiguous partition of ordered, atomic groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import join_by_key, numbered, stage

# Blocks of groups that the driver holds at first, and into how many parts a block is then cut.
BLOCKS, FAN_OUT = 65_536, 256
OVERHEAD = 8


@dataclass
class _Blocks:
    """Runs of consecutive groups: first group, number of groups, and bytes of each run."""

    first: np.ndarray
    groups: np.ndarray
    bytes: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.bytes)


def _next_cut(ends: np.ndarray, groups: np.ndarray, reach: int, hopeful: bool) -> int:
    """The last known end within ``reach`` bytes; if hopeful, as if blocks could be cut anywhere."""
    k = int(np.searchsorted(ends, reach, "right"))
    if hopeful and k < len(ends) and groups[k] > 1:
        return reach
    return int(ends[k - 1]) if k else 0


def _walk(blocks: _Blocks, ends: np.ndarray, shards: int, capacity: int, hopeful: bool) -> list[int]:
    cuts, at = [], 0
    for _ in range(shards):
        at = _next_cut(ends, blocks.groups, at + capacity, hopeful)
        cuts.append(at)
    return cuts


def _least_capacity(blocks: _Blocks, shards: int, hopeful: bool) -> int:
    """Binary search for the smallest capacity with which a greedy walk reaches the end."""
    ends = blocks.ends
    total = int(ends[-1])
    low, high = -(-total // shards) - 1, total
    while high - low > 1:
        middle = (low + high) // 2
        if _walk(blocks, ends, shards, middle, hopeful)[-1] >= total:
            high = middle
        else:
            low = middle
    return high


def _cut(blocks: _Blocks, shards: int, capacity: int) -> tuple[list[int], list[int]]:
    """Cuts in bytes under the capacity, near equal parts where that leaves a choice.

    A cut may lie no earlier than where the rest still fits the remaining shards, and no later
    than the capacity allows. Also returns the points that fell inside a block of several groups.
    """
    ends = blocks.ends
    starts = ends - blocks.bytes
    total, inside = int(ends[-1]), []

    def down(x: int) -> int:
        k = int(np.searchsorted(ends, x, "right"))
        if k < len(ends) and blocks.groups[k] > 1 and x > starts[k]:
            inside.append(k)
        return int(ends[k - 1]) if k else 0

    def up(x: int) -> int:
        if x <= 0:
            return 0
        k = int(np.searchsorted(ends, x, "left"))
        if blocks.groups[k] > 1 and x < ends[k]:
            inside.append(k)
        return int(ends[k])

    least = [total]
    for _ in range(shards - 1):
        least.append(up(least[-1] - capacity))
    least = least[::-1][:-1]  # of cuts 1 .. shards - 1
    cuts, at = [], 0
    for j in range(1, shards):
        at = max(down(min(at + capacity, max(total * j // shards, least[j - 1]))), least[j - 1], at)
        cuts.append(at)
    return cuts, inside


def minimax_cuts(ordered: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the first group of shards 1 .. shards - 1.

    ``ordered`` has one row per group: at (gapless position) and bytes. The driver sees runs of
    groups, never all of them: at first at most BLOCKS runs, then finer runs, only where a greedy
    walk may have to cut. With runs of size d the capacity is known up to d, so each round
    leaves under shards * shards runs to be cut finer, whatever the number of groups.
    """
    groups = ordered.count()
    if not groups:
        return 0, [0] * (shards - 1)

    def read(rows: DataFrame, width: int) -> _Blocks:
        got = (
            rows.groupBy(F.floor(F.col("at") / F.lit(width)).alias("block"))
            .agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("bytes").alias("b"))
            .orderBy("first")
            .toPandas()
        )
        return _Blocks(*(got[c].to_numpy(np.int64) for c in ("first", "n", "b")))

    width = -(-groups // BLOCKS)
    blocks = read(ordered, width)

    def finer(blocks: _Blocks, which: np.ndarray) -> _Blocks:
        nonlocal width
        width = max(1, width // FAN_OUT)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], which.astype(np.int8), [0]])))
        runs = [
            (int(blocks.first[a]), int(blocks.first[b - 1] + blocks.groups[b - 1]))
            for a, b in zip(edges[::2], edges[1::2], strict=True)
        ]
        spans = ordered.sparkSession.createDataFrame(runs, "lo long, hi long")
        part = read(
            ordered.join(F.broadcast(spans), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))),
            width,
        )
        keep = ~which
        first = np.concatenate([blocks.first[keep], part.first])
        order = np.argsort(first, kind="stable")
        return _Blocks(
            first[order],
            np.concatenate([blocks.groups[keep], part.groups])[order],
            np.concatenate([blocks.bytes[keep], part.bytes])[order],
        )

    while True:
        low, high = (_least_capacity(blocks, shards, hopeful) for hopeful in (True, False))
        ends = blocks.ends
        which = np.zeros(len(ends), bool)
        for a, b in zip(
            _walk(blocks, ends, shards, low, False), _walk(blocks, ends, shards, high, True), strict=True
        ):
            which[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "left") + 1] = True
        which &= blocks.groups > 1
        if low == high or not which.any():
            break
        blocks = finer(blocks, which)
    while True:
        cuts, inside = _cut(blocks, shards, high)
        if not inside:
            ends = np.concatenate([[0], blocks.ends])
            firsts = np.concatenate([blocks.first, [groups]])
            return high, [int(firsts[np.searchsorted(ends, c, "left")]) for c in cuts]
        which = np.zeros(len(blocks.first), bool)
        which[inside] = True
        blocks = finer(blocks, which)


def shard(
    docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Put every row into one of ``shards`` parts of near equal bytes; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law (``bytes``), shard, slot (gapless
    from 0 in each shard), grown_shard (null under this law) and capacity. Groups are the distinct
    texts, ordered by smallest id. A null text counts as an empty one: size 8, checksum 0, in one
    group with the empty texts. Rows with a null id come first in their group. Repeated rows keep
    one slot each. No rows give no rows. A group larger than an even share is never split, so its
    shard is larger than others. Other columns of the input are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n")
    )
    ordered = numbered(groups, ["first", "digest"], "shard-groups")
    capacity, cuts = minimax_cuts(ordered.select("at", "bytes"), shards)
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    number = F.size(F.filter(edges, lambda c: c <= F.col("at"))).cast("int") if cuts else F.lit(0)
    placed = ordered.select("digest", "at", "n", number.alias("shard"))
    starts, before = [], 0
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    for k in range(shards):
        starts.append((k, before))
        before += counts.get(k, 0)
    joined = join_by_key(rows, placed, "digest", "n", before)
    slotted = numbered(joined.drop("n"), ["shard", "at", "doc_id"], "shard-slots", "place")
    table = docs.sparkSession.createDataFrame(starts, "shard int, start long")
    return slotted.join(F.broadcast(table), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(capacity).cast("long").alias("capacity"),
    )

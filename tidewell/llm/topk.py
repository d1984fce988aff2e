"""Exact top-k inner products: an impact-ordered index read score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import stage

SCALE = 1024
# Vectors of one index, and queries that a task answers from it.
SHARD, QUERY_BLOCK = 16_384, 4_096
LEVELS = 16
# Segments read between two tests of whether the result is proven.
STRIDE = 128


def usable(vector: Column) -> Column:
    """Vectors that are null, or hold a null or non-finite component, take no part."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def blocks(vectors: DataFrame, queries: DataFrame, shard: int, query_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (shard, block): every query block meets every shard once.

    Rows are dealt by a hash of all their columns' bytes and id, so shards are even whatever the
    vectors; each side is copied as often as the other has blocks.
    """
    n_shards = max(1, -(-vectors.count() // shard))
    n_blocks = max(1, -(-queries.count() // query_block))
    shards = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
    many = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = queries.withColumn("shard", shards).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    right = vectors.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_shards)).cast("int")).withColumn("block", many)
    return left, right


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query over all shards, which bring k rows each at most."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    merged = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(merged.flatten()).astype(kind).reshape(-1, width)


class ImpactIndex:
    """Postings of one shard: for each dimension, vectors grouped by quantised component.

    Segment (d, level) lists the vectors whose component d lies in [edge[level], edge[level + 1]).
    A query gives each segment an impact, its component times the segment's best value above the
    dimension's worst; segments are read by falling impact. What a vector may still gain is known
    from the best segment not yet read in each dimension.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray, levels: int) -> None:
        self.ids, self.values = ids, values
        n, width = values.shape
        low, high = values.min(0), values.max(0)
        step = np.maximum(1, -(-(high - low + 1) // levels))
        level = (values - low) // step
        self.order = [np.argsort(level[:, d], kind="stable") for d in range(width)]
        self.starts = [
            np.searchsorted(level[self.order[d], d], np.arange(levels + 1)).tolist() for d in range(width)
        ]
        self.least = np.full((width, levels), 0, np.int64)
        self.most = np.full((width, levels), 0, np.int64)
        for d in range(width):
            for v in range(levels):
                a, b = self.starts[d][v], self.starts[d][v + 1]
                if b > a:
                    part = values[self.order[d][a:b], d]
                    self.least[d, v], self.most[d, v] = part.min(), part.max()
        self.full = np.diff(np.array(self.starts), axis=1) > 0

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, the query's own id left out."""
        own = self.ids == query_id
        n, width, levels = len(own), *self.least.shape
        want = min(k, n - int(own.sum()))
        if want <= 0:
            return self.ids[:0], np.zeros(0, np.int64)
        q = query[:, None]
        upper = np.where(q >= 0, q * self.most, q * self.least)
        lower = np.where(q >= 0, q * self.least, q * self.most)
        floor = np.where(self.full, lower, np.iinfo(np.int64).max).min(1, keepdims=True)
        gain, sure = upper - floor, lower - floor
        segments = np.flatnonzero(self.full.ravel())
        segments = segments[np.argsort(-gain.ravel()[segments], kind="stable")]
        waiting = [[] for _ in range(width)]
        for s in segments[::-1]:
            waiting[s // levels].append(int(gain.flat[s]))
        # In a dimension, a vector that was met gains no more than its segment's width on top of
        # what it was given, and one that was not, no more than the next segment still brings.
        spread = np.where(self.full, upper - lower, 0).max(1)
        least = np.zeros(n, np.int64)  # above the floors, of what is read
        for at in range(0, len(segments), STRIDE):
            for s in segments[at : at + STRIDE].tolist():
                d, v = divmod(s, levels)
                least[self.order[d][self.starts[d][v] : self.starts[d][v + 1]]] += sure[d, v]
                waiting[d].pop()
            still = np.maximum(spread, [w[-1] if w else 0 for w in waiting]).sum()
            proven = np.partition(np.where(own, -1, least), n - want)[n - want]
            members = np.flatnonzero((least + still >= proven) & ~own)
            if len(members) <= max(4 * k, n // 4):
                break
        exact = self.values[members] @ query
        order = np.lexsort((self.ids[members], -exact))[:want]
        return self.ids[members][order], exact[order]


def top_k(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k highest integer inner products of each query with every row but its own, exactly.

    Components become floor(SCALE * x). ``queries`` defaults to the rows whose id is divisible by
    100. Returns query_id, rank from 1, vec_id and score, ties to the smaller id. Vectors that are
    null or hold null or non-finite components take no part, nor do those whose length differs
    from the most frequent length, nor rows without an id. A row's own are all rows of its id;
    repeated query rows give repeated results once per id. Empty tables give no rows. Other
    columns are ignored.
    """
    def whole(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.col(id_column).cast("long").alias("id"),
            F.transform(F.col(vector_column), lambda x: F.floor(x.cast("double") * SCALE)).alias("values"),
            F.col(vector_column).alias("_raw"),
        ).filter(usable(F.col("_raw")) & F.col("id").isNotNull()).drop("_raw")

    every = stage(whole(vectors), "topk-vectors")
    asked = whole(queries) if queries is not None else every.filter(F.col("id") % 100 == 0)
    return _search(every, asked, k)


def _search(every: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    widths = every.groupBy(F.size("values").alias("w")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), "w").first()
    width = common["w"] if common else 1
    fit = every.filter(F.size("values") == width)
    left, right = blocks(fit, asked.filter(F.size("values") == width).dropDuplicates(["id"]), SHARD, QUERY_BLOCK)

    def answer(queries: pa.Table, shard: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        if not queries.num_rows or not shard.num_rows:
            return empty
        index = ImpactIndex(
            shard.column("id").to_numpy(), matrix(shard.column("values"), width, np.int64), LEVELS
        )
        names, found, scores = [], [], []
        asking = matrix(queries.column("values"), width, np.int64)
        for query_id, query in zip(queries.column("id").to_pylist(), asking, strict=True):
            ids, values = index.search(query_id, query, k)
            names.append(np.full(len(ids), query_id))
            found.append(ids)
            scores.append(values)
        return pa.table(
            {
                "query_id": pa.array(np.concatenate(names), pa.int64()),
                "vec_id": pa.array(np.concatenate(found), pa.int64()),
                "score": pa.array(np.concatenate(scores), pa.int64()),
            }
        )

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        answer, "query_id long, vec_id long, score long"
    )
    return best(found, k)

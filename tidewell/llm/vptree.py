"""Approximate nearest neighbours by inner product: a vantage-point tree per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import stage
from tidewell.llm.topk import best, blocks, matrix, usable

SHARD, QUERY_BLOCK = 16_384, 4_096
LEAF = 128
FACTOR = 1.25


class VantageTree:
    """Euclidean distances order a shard like falling inner products once each vector gets one
    more component, sqrt(largest squared norm - own squared norm), and queries get a zero there.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.lifted = np.column_stack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))])
        self.leaf = leaf
        self.root = self._build(np.arange(len(vectors)), np.random.default_rng(0))

    def _build(self, rows: np.ndarray, random: np.random.Generator):
        if len(rows) <= self.leaf:
            return rows
        # of a few vantage points, the one from which distances spread most
        tries = random.choice(rows, min(5, len(rows)), replace=False)
        seen = random.choice(rows, min(256, len(rows)), replace=False)
        spread = [np.std(np.linalg.norm(self.lifted[seen] - self.lifted[t], axis=1)) for t in tries]
        vantage = int(tries[int(np.argmax(spread))])
        away = np.linalg.norm(self.lifted[rows] - self.lifted[vantage], axis=1)
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        if away[order[0]] == away[order[-1]]:
            return rows  # all alike from here: no way to split
        near, far = rows[order[:half]], rows[order[half:]]
        radius = (away[order[half - 1]] + away[order[half]]) / 2
        return vantage, radius, self._build(near, random), self._build(far, random)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k nearest per query (-1 where there are fewer), ties to the smaller row, and
        their distances.

        ``own`` (queries by at most a few rows) marks rows a query must not return, as pairs.
        A side of a node is passed over if the triangle inequality puts it, ``factor`` times as
        far, beyond the k-th nearest found: factor 1 is exact, more is faster.
        """
        lifted = np.column_stack([queries, np.zeros(len(queries))])
        rows = np.full((len(queries), k), -1, np.int64)
        away = np.full((len(queries), k), np.inf)
        banned: dict[int, set[int]] = {}
        for q, r in own:
            banned.setdefault(int(q), set()).add(int(r))

        def visit(node, active: np.ndarray) -> None:
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                part = self.lifted[node]
                square = (
                    (lifted[active] ** 2).sum(1)[:, None] - 2 * lifted[active] @ part.T + (part**2).sum(1)[None]
                )
                found = np.sqrt(np.maximum(square, 0))
                places = {int(r): j for j, r in enumerate(node)} if banned else {}
                for i, q in enumerate(active):
                    for r in banned.get(int(q), ()):
                        if r in places:
                            found[i, places[r]] = np.inf
                all_away = np.concatenate([away[active], found], axis=1)
                all_rows = np.concatenate([rows[active], np.broadcast_to(node, found.shape)], axis=1)
                top = np.argpartition(all_away, k - 1, axis=1)[:, :k]
                last = np.take_along_axis(all_away, top, 1).max(1)
                more = (all_away <= last[:, None]).sum(1) > k
                tied = np.flatnonzero(more & np.isfinite(last))
                if len(tied):  # of equally near rows the smaller ones stay
                    top[tied] = np.lexsort((all_rows[tied], all_away[tied]))[:, :k]
                away[active] = np.take_along_axis(all_away, top, 1)
                rows[active] = np.take_along_axis(all_rows, top, 1)
                return
            vantage, radius, near, far = node
            distance = np.linalg.norm(lifted[active] - self.lifted[vantage], axis=1)
            inside = distance < radius
            visit(near, active[inside])
            visit(far, active[~inside])
            gap = np.abs(distance - radius) * factor
            still = gap <= away[active].max(1)
            visit(far, active[inside & still])
            visit(near, active[~inside & still])

        visit(self.root, np.arange(len(queries)))
        rows[np.isinf(away)] = -1
        return rows, away


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 20,
    factor: float = FACTOR,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k rows of largest inner product found for each query, scored on the original vectors.

    ``queries`` defaults to the rows whose id is divisible by 20. Every row is in the tree of its
    shard. Returns query_id, rank from 1, vec_id and score (double), ties to the smaller id.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those
    whose length differs from the most frequent length, nor rows without an id. All rows
    of the query's id count as its own; repeated query rows count once. Empty tables give no
    rows. Other columns are ignored.
    """

    def whole(frame: DataFrame) -> DataFrame:
        vector = F.col(vector_column)
        return (
            frame.select(
                F.col(id_column).cast("long").alias("id"),
                vector.cast("array<double>").alias("values"),
            )
            .filter(usable(F.col("values")) & F.col("id").isNotNull())
            .filter(F.exists("values", lambda x: x != 0))
        )

    every = stage(whole(vectors), "vp-vectors")
    asked = whole(queries) if queries is not None else every.filter(F.col("id") % 20 == 0)
    widths = every.groupBy(F.size("values").alias("w")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), "w").first()
    width = common["w"] if common else 1
    left, right = blocks(
        every.filter(F.size("values") == width),
        asked.filter(F.size("values") == width).dropDuplicates(["id"]),
        SHARD,
        QUERY_BLOCK,
    )

    def answer(asking: pa.Table, shard: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not asking.num_rows or not shard.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        ids, names = shard.column("id").to_numpy(), asking.column("id").to_numpy()
        values, wanted = (matrix(t.column("values"), width, float) for t in (shard, asking))
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], np.ascontiguousarray(values[order] + 0.0)
        # equal vectors are one entry of the tree, entries in order of their smallest id
        whole = values.view(np.dtype((np.void, values.itemsize * width))).ravel()
        _, first, entry = np.unique(whole, return_index=True, return_inverse=True)
        first, entry = np.sort(first), np.argsort(np.argsort(first))[entry]
        members = np.argsort(entry, kind="stable")
        starts = np.searchsorted(entry[members], np.arange(len(first) + 1))
        sizes = np.diff(starts)
        low, high = (np.searchsorted(ids, names, s) for s in ("left", "right"))
        own = []
        for q in range(len(names)):
            mine, n = np.unique(entry[low[q] : high[q]], return_counts=True)
            own += [(q, e) for e in mine[n == sizes[mine]]]
        rows, _ = VantageTree(values[first]).search(wanted, np.array(own, np.int64).reshape(-1, 2), k, factor)
        q, j = np.nonzero(rows >= 0)
        found = rows[q, j]
        score = np.einsum("ij,ij->i", wanted[q], values[first[found]])
        # k ids of an entry are enough, beside the query's own
        take = np.minimum(sizes[found], k + (high - low)[q])
        step = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        near = ids[members[np.repeat(starts[found], take) + step]]
        q, score = np.repeat(q, take), np.repeat(score, take)
        other = near != names[q]
        q, near, score = q[other], near[other], score[other]
        order = np.lexsort((near, -score, q))
        q, near, score = q[order], near[order], score[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pa.table(
            {
                "query_id": pa.array(names[q[kept]], kinds["query_id"]),
                "vec_id": pa.array(near[kept], kinds["vec_id"]),
                "score": pa.array(score[kept], kinds["score"]),
            }
        )

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        answer, "query_id long, vec_id long, score double"
    )
    return best(found, k)

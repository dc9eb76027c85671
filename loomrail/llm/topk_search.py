"""Exact top-k inner products by Fagin's threshold algorithm over sorted lists, one for each dimension.

Candidates are dealt into blocks by their largest component, so that vectors alike share a block. The
block that a query's own components name is searched first and gives it a floor, the kth score there;
then it runs in every other block whose longest vector could reach the floor, and stops where no unseen
vector can.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.llm.common import checkpointed, table

#: Candidates and queries that one task compares.
BLOCK, QUERIES = 8192, 4096
#: Depth of all lists' first step; each later one doubles it.
STEP = 8
#: Share of the candidates from which the others are scored without lists, as few are left to be spared.
REST = 0.5
#: Queries scored together.
TOGETHER = 256


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, vec_id, v): components as floor(scale * x), each row under a number of its own.

    Rows whose id or vector is null, or that hold a null or non-finite component, are left out. Other
    columns are not read. Repeated rows and repeated ids stay, as rows of their own.
    """
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
    # written down, so that a number stays with its row
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def most(u: np.ndarray, t: np.ndarray, square: float) -> float:
    """The largest u * y with y <= t in each component and no more than `square` as sum of squares (u > 0)."""
    if float(t @ t) <= square:
        return float(u @ t)
    # y = min(t, s * u) for the s that spends the square; components leave the cap one by one as s falls
    ratio = t / u
    by = np.argsort(ratio)
    a, b = t[by] ** 2, u[by] ** 2
    capped, free = np.cumsum(a) - a, np.cumsum(b[::-1])[::-1]
    s = np.sqrt(np.maximum(square - capped, 0) / free)
    # the last component that is not capped at its own s
    k = int(np.argmax(s <= ratio[by])) if (s <= ratio[by]).any() else len(u) - 1
    return float(t[by[:k]] @ u[by[:k]] + s[k] * free[k])


class Lists:
    """The candidates of a block, and each dimension's list of them in order."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.rows, self.ids, self.x = rows, ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        #: the values of each list, lowest first, one list after the other
        self.sorted = np.ascontiguousarray(np.take_along_axis(x, self.order, axis=0).astype(np.float64).T)
        self.square = float((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        self.largest, self.floats = float(np.abs(x).max(initial=0)), x.astype(np.float64)
        #: candidates scored and candidates there were, over all queries, and queries that the threshold ended
        self.read = self.there = self.stopped = 0

    def exact(self, q: np.ndarray) -> bool:
        """Whether doubles hold all products."""
        return self.largest * float(np.abs(q).max(initial=0)) * max(self.x.shape[1], 1) < 2**53

    def alone(self, q: np.ndarray, best: np.ndarray) -> np.ndarray:
        """(query, list): how deep each list would have to be read to end a query by itself: to its last value near enough to the query's, as a vector further off in one component scores less."""
        n = len(self.ids)
        near = np.sqrt(np.maximum(self.square + (q.astype(np.float64) ** 2).sum(axis=1) - 2 * best, 0.0)) + 1e-6
        out = np.full(q.shape, n, np.int64)
        for c in range(q.shape[1]):
            up, down = q[:, c] > 0, q[:, c] < 0
            out[up, c] = n - np.searchsorted(self.sorted[c], q[up, c] - near[up], "left")
            out[down, c] = np.searchsorted(self.sorted[c], q[down, c] + near[down], "right")
        return out

    def together(self, q: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How many candidates will about have come up when all lists, read side by side, end a query."""
        n, u = len(self.ids), np.abs(q).astype(np.float64)
        out, lists = np.full(len(q), float(n)), (q != 0).sum(axis=1)
        for part in (0.5, 0.3, 0.15, 0.06, 0.02, 0.005):
            d = int(part * n)
            bound = np.where(q > 0, u, 0) @ self.sorted[:, n - 1 - d] - np.where(q < 0, u, 0) @ self.sorted[:, d]
            ends = bound < best
            out[ends] = np.minimum(out[ends], n * (1 - (1 - part) ** lists[ends]))
        return out

    def opening(self, row: int, q: np.ndarray, k: int, depth: int) -> float:
        """The kth score of what comes up first in the lists, or none."""
        use = np.flatnonzero(q)
        first = np.unique(np.concatenate([self.order[-depth:, use[q[use] > 0]].ravel(), self.order[:depth, use[q[use] < 0]].ravel()]))
        first = first[self.rows[first] != row]
        if len(first) < k:
            return -np.inf
        scores = self.floats[first] @ q.astype(np.float64) if self.exact(q) else self.x[first] @ q
        return float(np.partition(scores, len(first) - k)[len(first) - k])

    def worth_lists(self, q: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Queries that the lists are likely to end before REST of the block has come up."""
        n, known = len(self.ids), np.where(floors > -np.inf, floors, 0.0)
        if not n:
            return np.zeros(len(q), bool)
        return (floors > -np.inf) & ((self.alone(q, known).min(axis=1, initial=n) <= REST * n) | (self.together(q, known) <= REST * n))

    def tops(self, rows: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each query as top gives them. A query without a floor takes one from the first entries of its lists.

        Where the floor shows that neither one list nor all of them would end a query before most of the
        block has come up, the block's vectors are scored for all such queries at once.
        """
        n, floors = len(self.ids), floors.astype(np.float64)
        spared, none = self.worth_lists(q, floors), floors == -np.inf
        for depth in (STEP, 4 * STEP):
            for i in np.flatnonzero(none & ~spared) if n else ():
                floors[i] = self.opening(rows[i], q[i], k, depth)
            spared = self.worth_lists(q, floors)
        out: list = [None] * len(q)
        for i in np.flatnonzero(spared):
            out[i] = self.top(rows[i], q[i], k, floors[i])
        rest = np.flatnonzero(~spared)
        for j in range(0, len(rest), TOGETHER):
            part = rest[j : j + TOGETHER]
            scores = q[part].astype(np.float64) @ self.floats.T if self.exact(q[part]) else q[part] @ self.x.T
            for i, mine in zip(part, scores):
                out[i] = self.best_of(mine, np.ones(n, bool), rows[i], k, floors[i])
        self.read, self.there = self.read + len(rest) * n, self.there + len(rest) * n
        return out

    def best_of(self, scores: np.ndarray, seen: np.ndarray, row: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best among those seen that reach the floor."""
        at = np.flatnonzero(seen & (self.rows != row) & ((scores >= floor) | (floor == -np.inf)))
        at = at[np.lexsort((self.ids[at], -scores[at]))[:k]]
        return self.ids[at], scores[at].astype(np.int64)

    def top(self, row: int, q: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of the block that reach the floor, ties to smaller ids; the query's own row does not count.

        The lists are read from the top where the query's component is positive, from the bottom where it
        is negative, and every vector that comes up is scored at once: side by side, or the one list alone
        that ends the query before REST of the block has come up. No vector unseen exceeds the present
        value of any list, nor the largest norm of the block; once what both allow is below the kth score,
        or the floor, the rest is not read. Equal scores go on, as a smaller id might follow. Where REST
        has come up without an end, the others are scored without lists.
        """
        n, use = len(self.ids), np.flatnonzero(q)
        exact = self.exact(q)
        x, w = (self.floats, q.astype(np.float64)) if exact else (self.x, q)
        seen, scores, best = np.zeros(n, bool), np.full(n, -np.inf) if exact else np.full(n, np.iinfo(np.int64).min), floor
        depth, u, up = np.zeros(len(use), np.int64), np.abs(q[use]).astype(np.float64), q[use] > 0
        need, at_best = np.zeros(0, np.int64), -np.inf
        self.there += n
        while not seen.all():
            at = np.minimum(depth, n - 1)
            value = np.where(up, self.sorted[use, n - 1 - at], -self.sorted[use, at])
            if best > -np.inf and len(use) and most(u, value, self.square) * (1 + 1e-9) + 1e-6 < best:
                self.stopped += 1
                break
            if best > at_best and len(use):
                need, at_best = self.alone(q[None], np.array([best]))[0][use], best
            new = np.zeros(n, bool)
            if len(need) and need.min() <= REST * n and need.min() > depth[need.argmin()]:
                j = int(need.argmin())
                new[self.order[n - need[j] :, use[j]] if up[j] else self.order[: need[j], use[j]]] = True
                depth[j] = need[j]
            elif len(use) and seen.sum() <= REST * n:
                end = min(max(2 * int(depth.min()), STEP), n)
                new[self.order[n - end :, use[up]]] = True
                new[self.order[:end, use[~up]]] = True
                depth = np.maximum(depth, end)
            else:
                new[:] = True
            new &= ~seen
            scores[new] = x[new] @ w
            seen |= new
            mine = scores[seen & (self.rows != row)]
            if len(mine) >= k:
                best = max(best, float(np.partition(mine, len(mine) - k)[len(mine) - k]))
        self.read += int(seen.sum())
        return self.best_of(scores, seen, row, k, best)


def blocks_of(candidates: DataFrame, size: int) -> tuple[int, Column]:
    """The number of blocks, and the block of a row by its largest component; one that many rows share is dealt over several."""
    largest = F.array_position(F.transform("v", F.abs), F.array_max(F.transform("v", F.abs)))
    key = F.coalesce(largest * F.when(F.element_at("v", F.greatest(largest, F.lit(1)).cast("int")) < 0, -1).otherwise(1), F.lit(0)).cast("long")
    key = F.when(F.size("v") > 0, key).otherwise(F.lit(0).cast("long"))
    # two rows for each dimension at most
    counts = sorted((r["key"], r["count"]) for r in candidates.groupBy(key.alias("key")).count().collect())
    starts, total = {}, 0
    for k, n in counts:
        starts[k] = (total, n)
        total += n
    if not total:
        return 1, F.lit(0)
    first = F.create_map(*(F.lit(v).cast("long") for k, (s, _) in starts.items() for v in (k, s)))
    many = F.create_map(*(F.lit(v).cast("long") for k, (_, n) in starts.items() for v in (k, n)))
    place = F.coalesce(first[key] + F.pmod(F.xxhash64("row", "vec_id"), many[key]), F.lit(0))
    return -(-total // size), F.floor(place / size).cast("int")


def top_matches(candidates: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for tables of (row, vec_id, v), as usable makes them.

    Every query row is a query of its own, and every other row a candidate of it, rows of the same
    id and copies included. Both sides are dealt into parts of bounded size and each pair of parts is
    one task's work, so no task depends on the size of either table. Every part gives its k best, of
    which the k best of each query are ranked; a query without candidates has no rows.
    """
    size = candidates.agg(F.max(F.size("v"))).first()
    width = size[0] or 0
    blocks, place = blocks_of(candidates, block)
    groups = max(1, -(-queries.count() // group))
    deal = F.pmod(F.xxhash64("row", "vec_id"), F.lit(groups)).cast("int")

    def lists(left) -> Lists:
        return Lists(left["row"].to_numpy(), left["vec_id"].to_numpy().astype(np.int64), matrix(left["v"], width))

    def run(key, left, right):
        held, rows, ids = lists(left), right["row"].to_numpy(), right["vec_id"].to_numpy()
        least = np.array([-np.inf if f is None else f for f in right["floor"].to_pylist()], np.float64)
        found = held.tops(rows, matrix(right["v"], width), k, least)
        size = np.array([len(s) for _, s in found], np.int64)
        columns = (np.repeat(rows, size), np.repeat(ids, size), *(np.concatenate([*(f[c] for f in found), np.zeros(0, np.int64)]) for c in (0, 1)))
        return pa.table({c: pa.array(v.astype(np.int64)) for c, v in zip(("row", "query_id", "vec_id", "score"), columns)})

    result = "row long, query_id long, vec_id long, score long"
    dealt = candidates.select("row", "vec_id", "v", place.alias("b"))
    # aliases, as both sides may be rows of one table
    asked = queries.select(*(F.col(c).alias(c) for c in ("row", "vec_id", "v")), deal.alias("g"), place.alias("b"))
    first = dealt.groupBy("b").cogroup(asked.withColumn("floor", F.lit(None).cast("long")).groupBy("b")).applyInArrow(run, result)
    if blocks > 1:
        first = checkpointed(first)
        floors = first.groupBy(F.col("row").alias("_row")).agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        # the longest vector of a block, one row each, tells where nothing can reach a floor
        square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
        longest = dealt.groupBy("b").agg(F.max(square).alias("longest")).select(F.col("b").alias("to"), "longest")
        others = asked.join(floors, F.col("row") == F.col("_row"), "left").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("b <> to").join(longest, "to")
        right = others.where(F.col("floor").isNull() | (F.sqrt(F.col("longest")) * F.sqrt(square) * (1 + 1e-9) + 1e-6 >= F.col("floor"))).select("row", "vec_id", "v", "g", "floor", F.col("to").alias("b"))
        left = dealt.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        first = first.union(left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(run, result))
    found = first
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return top_matches(rows, rows.where("vec_id % 20 = 0"))


OP7_SQL = """
WITH e AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
u AS (SELECT row, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS j FROM e),
c AS (SELECT row, vec_id, j, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM u),
s AS (SELECT q.row, q.vec_id AS query_id, c.row AS other, c.vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
      FROM c JOIN c q ON q.j = c.j AND q.vec_id % 20 = 0 AND q.row <> c.row GROUP BY q.row, q.vec_id, c.row, c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

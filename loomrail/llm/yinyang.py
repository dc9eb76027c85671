"""Centroid clustering with Yinyang bounds.

Centroids are put into groups once. Every vector carries an upper bound of the distance to its own
centroid and, for each group, one lower bound of the distance to that group's other centroids. A round
first compares the upper bound with all lower bounds, then with each group's, then scans the centroids
left exactly. A round is one pass over the vectors, which writes them with their bounds to the shared
folder together with one row of sums for each cluster and task; only these rows are added up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.llm.common import new_folder, table

#: Centroids in a group, on average.
GROUP = 4
#: Vectors that are compared at once.
SLICE = 2048
#: Integers below are exact as doubles; vectors with larger sums of squares are reckoned in Python's integers.
EXACT = 1 << 53
HALF = 1 << 64
WIDE = "decimal(38,0)"
LONGEST = (1 << 63) - 1
STATE = "vec_id bigint, v array<bigint>, cluster int, distance bigint, upper double, lower array<double>, n bigint, sums array<string>, scanned bigint"
ARROW = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("scanned", pa.int64())])


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of `width` finite components, each as floor(scale * x)."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where((F.size(x) == width) & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def beyond(*arrays: np.ndarray) -> bool:
    """Whether doubles can't hold sums of products of these components."""
    most = max(max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in arrays)
    return 4 * most * most * max(SLICE, *(a.shape[1] for a in arrays)) >= EXACT


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(row, centroid): squared distances, exact; as doubles where these hold them, else as Python's integers."""
    if not beyond(x, c):
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]
    x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def groups_of(centroids: np.ndarray, size: int = GROUP) -> np.ndarray:
    """The group of each centroid: a few plain rounds over the centroids alone."""
    k = len(centroids)
    c = centroids.astype(np.float64)
    heads = c[:: max(1, size)][: max(1, -(-k // size))].copy()
    of = np.zeros(k, np.int64)
    for _ in range(5):
        of = ((c[:, None] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(heads)):
            if (of == g).any():
                heads[g] = c[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


class Assigner:
    """Assigns vectors to the nearest centroid; of equal distances the smaller number."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray) -> None:
        self.c, self.group, self.drift = centroids, group, drift
        self.members = [np.flatnonzero(group == g) for g in range(group.max(initial=-1) + 1)]
        #: distances reckoned
        self.scanned = 0

    def by_group(self, bound: np.ndarray) -> np.ndarray:
        return np.stack([bound[:, m].min(axis=1) for m in self.members], axis=1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, upper bound, lower bounds), no bound being known."""
        d, rows = squares(x, self.c), np.arange(len(x))
        self.scanned += d.size
        own = d.argmin(axis=1)
        best = d[rows, own]
        bound = np.sqrt(d.astype(np.float64))
        upper = bound[rows, own]
        bound[rows, own] = np.inf
        return own, best, upper, self.by_group(bound)

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, tighten: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same with the bounds of the round before, loosened by what the centroids moved, and a little more against rounding.

        A squared distance is -1 where bounds spared it; with `tighten` all are reckoned.
        """
        rows, old = np.arange(len(x)), own
        own, best = own.copy(), np.full(len(x), -1, object if self.wide(x) else np.float64)
        upper = upper * (1 + 1e-9) + self.drift[own] * (1 + 1e-9) + 1e-6
        bound = np.maximum(lower[:, self.group] * (1 - 1e-9) - self.drift * (1 + 1e-9) - 1e-6, 0)
        bound[rows, own] = np.inf
        low = bound.min(axis=1)
        todo = np.flatnonzero(low <= upper)
        need = rows if tighten else todo
        best[need] = self.to_own(x[need], own[need])
        upper[need] = np.sqrt(best[need].astype(np.float64))
        todo = todo[low[todo] <= upper[todo]]
        went, gone = upper.copy(), todo
        for m in self.members:
            left = todo[bound[np.ix_(todo, m)].min(axis=1) <= upper[todo]]
            for c in m:
                at = left[(bound[left, c] <= upper[left]) & (old[left] != c)]
                if not len(at):
                    continue
                d = squares(x[at], self.c[c : c + 1])[:, 0]
                self.scanned += len(at)
                bound[at, c] = np.sqrt(d.astype(np.float64))
                closer = (d < best[at]) | (d == best[at]) & (c < own[at])
                own[at[closer]], best[at[closer]], upper[at[closer]] = c, d[closer], bound[at[closer], c]
        gone = gone[own[gone] != old[gone]]
        bound[gone, old[gone]] = went[gone]
        bound[rows, own] = np.inf
        return own, best, upper, self.by_group(bound)

    def wide(self, x: np.ndarray) -> bool:
        return beyond(x, self.c)

    def to_own(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to its own centroid."""
        self.scanned += len(x)
        kind = object if self.wide(x) else np.float64
        return ((x.astype(kind) - self.c[own].astype(kind)) ** 2).sum(axis=1)


def one_pass(centroids: list[list[int]], group: np.ndarray, drift: np.ndarray, known: bool, last: bool):
    """A function for mapInArrow: vectors in, their new state out, then a row of sums for each cluster."""
    c = np.array(centroids, np.int64)
    k, width = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(c, group, drift)
        counts, sums, inertia = [0] * k, np.zeros((k, width), object), [0] * k
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                n = b.num_rows
                x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, width)
                if known:
                    lower = b["lower"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                    own, best, upper, lower = assigner.again(x, b["cluster"].to_numpy(zero_copy_only=False).astype(np.int64), b["upper"].to_numpy(zero_copy_only=False), lower, last)
                else:
                    own, best, upper, lower = assigner.first(x)
                part = np.arange(k)[:, None] == own[None]
                kind = object if beyond(x, c[:0]) else np.float64
                if not last:
                    sums += np.array([[int(s) for s in row] for row in part.astype(kind) @ x.astype(kind)], object).reshape(k, width)
                for i in np.unique(own):
                    counts[i] += int(part[i].sum())
                    inertia[i] += int(best[part[i]].sum()) if last else 0
                far = [min(int(d), LONGEST) for d in best] if last else [None] * n
                offsets = pa.array(np.arange(n + 1) * lower.shape[1], pa.int32())
                nulls = lambda t: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays([b["vec_id"], nulls(pa.list_(pa.int64())) if last else b["v"], pa.array(own, pa.int32()), pa.array(far, pa.int64()), pa.array(upper), pa.ListArray.from_arrays(offsets, pa.array(lower.ravel())), nulls(pa.int64()), nulls(pa.list_(pa.string())), nulls(pa.int64())], schema=ARROW)
        # components, or in the last pass the sum of squares in two halves
        added = lambda i: [str(s) for s in (divmod(inertia[i], HALF) if last else sums[i])]
        rows = [{"cluster": i, "n": counts[i], "sums": added(i), "scanned": 0} for i in range(k) if counts[i]]
        yield pa.RecordBatch.from_pylist([*rows, {"cluster": -1, "n": 0, "sums": [], "scanned": assigner.scanned}], schema=ARROW)

    return run


class Clusters(NamedTuple):
    #: (vec_id, cluster, distance)
    members: DataFrame
    centroids: list[list[int]]
    #: sum of squared distances of each cluster
    inertia: list[int]
    #: distances reckoned in each pass
    scanned: list[int]


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> Clusters:
    """Assigns every usable vector to one of k centroids, which move `rounds` times.

    Usable are vectors of `width` components, none null or non-finite; the others, null ones too, are
    left out. Components become floor(scale * x), or the nearest long where that has none. The first
    centroids are the vectors with the least sha256 of `seed:id`; repeated ids go by their vectors, null
    ids come last. Repeated rows count as often as they stand; fewer vectors than k give fewer
    centroids, and an empty table gives none and no rows. Distances above the largest long are given as
    that. Other columns aren't read. The driver holds k centroids and k rows of sums for each pass.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, width, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = [list(r["v"]) for r in rows.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]
    if not centroids:
        return Clusters(spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), [], [], [])
    group, drift, scanned, source = groups_of(np.array(centroids, np.int64)), np.zeros(len(centroids)), [], rows
    for r in range(rounds + 1):
        folder = new_folder(spark, f"yinyang-{r}")
        source.mapInArrow(one_pass(centroids, group, drift, r > 0, r == rounds), STATE).write.parquet(folder)
        written = spark.read.schema(STATE).parquet(folder)
        sums = written.where("n IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("n").cast(WIDE)).alias("n"), F.sum(F.col("scanned").cast(WIDE)).alias("scanned"), *(F.sum(F.get("sums", F.lit(i)).cast(WIDE)).alias(f"s{i}") for i in range(width if r < rounds else 2)))
        got = {row["cluster"]: row for row in sums.collect()}
        scanned.append(int(got[-1]["scanned"]))
        if r < rounds:
            moved = [[int(got[i][f"s{j}"]) // int(got[i]["n"]) for j in range(width)] if i in got else c for i, c in enumerate(centroids)]
            drift = np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(c, m))) for c, m in zip(centroids, moved)])
            centroids, source = moved, written.where("n IS NULL").select("vec_id", "v", "cluster", "upper", "lower")
    return Clusters(written.where("n IS NULL").select("vec_id", "cluster", "distance"), centroids, [int(got[i]["s0"]) * HALF + int(got[i]["s1"]) if i in got else 0 for i in range(len(centroids))], scanned)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distances and the digest of the centroid of every usable vector of embeddings."""
    found = clustered(table(spark, sf_dir, "embeddings"))
    whole = min(sum(found.inertia), LONGEST)
    # one row for each centroid
    facts = [(i, min(found.inertia[i], LONGEST), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.members.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds one after the other; vectors whose products fit a HUGEINT."""
    parts = ["kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"]
    parts.append("c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS i, v AS c FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT 16))")
    for r in range(4):
        parts.append(f"a{r} AS (SELECT row, vec_id, v, arg_min(i, (d, i)) AS cluster, min(d) AS d FROM (SELECT row, vec_id, v, i, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM kept, c{r}) GROUP BY row, vec_id, v)")
        if r < 3:
            parts.append(f"s{r} AS (SELECT cluster, pos, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM a{r}) GROUP BY cluster, pos)")
            parts.append(f"m{r} AS (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY pos) AS c FROM s{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS (SELECT i, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON cluster = i)")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, cluster::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::VARCHAR), ',')) AS centroid_sha256 FROM a3 JOIN c3 ON cluster = i"


OP11_SQL = _sql()

"""Exactness of the threshold search, where it stops, and rows that share an id."""

import numpy as np
import pytest

from loomrail.llm import topk_search


def brute(ids, x, row, k=20):
    s = x @ x[row]
    return [(i, -a) for a, i in sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if j != row)[:k]]


def unit(z):
    return np.floor(64 * z / np.linalg.norm(z, axis=1, keepdims=True)).astype(np.int64)


@pytest.mark.parametrize("kind", ("ties", "random", "clusters"))
def test_exact_with_and_without_floor(kind):
    rng = np.random.default_rng(2)
    x = {"ties": lambda: rng.integers(-3, 4, (1500, 5)), "random": lambda: unit(rng.normal(size=(1500, 64))), "clusters": lambda: unit(np.repeat(rng.normal(size=(40, 64)), 50, axis=0) + 0.05 * rng.normal(size=(2000, 64)))}[kind]()
    ids = rng.permutation(len(x)) // 2
    lists = topk_search.Lists(np.arange(len(x)), ids, x)
    rows = rng.choice(len(x), 12, replace=False)
    floors = []
    for r in rows:
        i, s = lists.top(r, x[r], 20)
        assert list(zip(i.tolist(), s.tolist())) == brute(ids, x, r)
        floors.append(float(s[-1]))
    lists.read = lists.there = 0
    for r, got in zip(rows, lists.tops(rows, x[rows], 20, np.array(floors))):
        assert list(zip(*(a.tolist() for a in got))) == brute(ids, x, r)
    # with clusters the lists are left long before their ends
    assert lists.read < (0.6 if kind == "clusters" else 1.01) * lists.there


def test_bound_is_the_largest_product_allowed():
    rng = np.random.default_rng(4)
    for _ in range(200):
        u, t = rng.random(5) + 0.1, rng.normal(size=5)
        square = float(rng.random() * 3 + (np.minimum(t, 0) ** 2).sum())
        low, high = 0.0, 1e6
        for _ in range(200):
            s = (low + high) / 2
            low, high = (s, high) if (np.minimum(t, s * u) ** 2).sum() <= square else (low, s)
        assert topk_search.most(u, t, square) == pytest.approx(np.minimum(t, low * u) @ u, rel=1e-6, abs=1e-9)


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-9, 10, (300, 4)), np.tile([[3, -4, 5, 0]], (200, 1))]) / 64
    ids = [i % 150 for i in range(len(x))]
    data = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, b int, floor int")
    rows = topk_search.usable(data)
    got = topk_search.top_matches(rows, rows.where("vec_id % 20 = 0"), k=7, block=64, group=5).toPandas()
    v = np.floor(64 * x).astype(np.int64)
    want = sorted((ids[r], rank, *m) for r in range(len(x)) if ids[r] % 20 == 0 for rank, m in enumerate(brute(ids, v, r, 7), 1))
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == want


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = topk_search.usable(spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [inf, 1.0]), (4, [nan, 0.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk_search.top_matches(rows, rows.where("vec_id % 20 = 0")).collect()] == [(0, 1, 5, 64 * 32 + 128 * 32)]


def test_no_vectors_and_a_long_one(spark):
    none = topk_search.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk_search.top_matches(none, none).count() == 0
    odd = topk_search.usable(spark.createDataFrame([(0, []), (1, [0.0] * 5000 + [1.0]), (2, [1.0] * 5001)], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk_search.top_matches(odd, odd.where("vec_id = 2")).collect()] == [(2, 1, 1, 4096), (2, 2, 0, 0)]


def test_sorted_access_decides_where_it_can(spark):
    rng = np.random.default_rng(3)
    clusters = unit(np.repeat(rng.normal(size=(40, 64)), 50, axis=0) + 0.05 * rng.normal(size=(2000, 64)))
    lists = topk_search.Lists(np.arange(2000), np.arange(2000), clusters)
    lists.tops(np.arange(0, 2000, 20), clusters[::20], 20, np.full(100, -np.inf))
    assert lists.stopped > 90 and lists.read < 0.6 * lists.there
    # a floor out of reach ends a query before any access
    lists.read = lists.there = lists.stopped = 0
    lists.tops(np.arange(5), clusters[:5], 20, np.full(5, 1e6))
    assert (lists.stopped, lists.read) == (5, 0)
    # of random directions nearly all come up before the threshold falls below the kth score
    given = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()], np.float64)
    lists = topk_search.Lists(np.arange(len(given)), np.arange(len(given)), np.floor(64 * given).astype(np.int64))
    lists.tops(np.arange(0, 400, 20), lists.x[:400:20], 20, np.full(20, -np.inf))
    assert lists.read > topk_search.REST * lists.there


def test_blocks_out_of_reach_are_skipped(spark):
    rng = np.random.default_rng(6)
    # the longest vectors share their largest component, so the other blocks cannot reach their queries' floors
    x = np.concatenate([rng.integers(-2, 3, (400, 3)), rng.integers(60, 65, (40, 1)) * [[1, 0, 0]]])
    rows = topk_search.usable(spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = topk_search.top_matches(rows, rows.where("vec_id >= 400"), k=5, block=40, group=7).toPandas()
    want = sorted((r, rank, *m) for r in range(400, 440) for rank, m in enumerate(brute(np.arange(440), x, r, 5), 1))
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == want

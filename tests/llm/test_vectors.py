import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import maxscore, vector_neardup
from lodestone.llm.common import components, join_heavy, local_forest


def brute_top(items, queries, k):
    out = {}
    for q, qv in queries.items():
        scores = [(-sum(w * v.get(t, 0) for t, w in qv.items()), i) for i, v in items if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, list(map(int, v)), [int(x) for x in v.values()]) for i, v in rows], "id long, terms array<long>, weights array<long>")


@pytest.mark.parametrize("density", [0.1, 0.9])
def test_top_k_equals_brute_force(spark, density):
    rng = np.random.default_rng(5)
    rows = [(i, {int(t): int(rng.integers(-9, 9)) for t in np.flatnonzero(rng.random(20) < density)}) for i in range(300)]
    rows[7] = (7, {})
    rows[8] = (8, dict(rows[9][1]))
    got = {}
    found = maxscore.top_k(frame(spark, rows), frame(spark, [r for r in rows if r[0] % 10 == 0]), 5, shard=64, block=16)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == brute_top(rows, {i: v for i, v in rows if i % 10 == 0}, 5)


def test_top_k_edges(spark):
    rows = [(0, {1: 2}), (1, {1: -3}), (2, {}), (3, {2: 5})]
    found = sorted(tuple(r) for r in maxscore.top_k(frame(spark, rows), frame(spark, rows[:1]), 5).collect())
    assert found == [(0, 1, 2, 0), (0, 2, 3, 0), (0, 3, 1, -6)]
    empty = frame(spark, [])
    assert maxscore.top_k(empty, empty, 5).count() == 0
    assert maxscore.top_k(frame(spark, rows), empty, 5).count() == 0


def test_top_k_of_repeated_ids_and_large_weights(spark):
    """Rows are known by their number: each query of one id has its own candidates, the other row included."""
    numbered = lambda rows: frame(spark, rows).withColumn("row", F.monotonically_increasing_id())
    rows = numbered([(50, {1: 2}), (50, {1: 3}), (1, {1: 1})])
    found = sorted((r.query_id, r.rank, r.id, r.score) for r in maxscore.top_k(rows, rows.filter("id = 50"), 5).collect())
    assert found == [(50, 1, 50, 6), (50, 1, 50, 6), (50, 2, 1, 2), (50, 2, 1, 3)]
    big = 2**62
    rows = numbered([(0, {1: big, 2: big}), (1, {1: big, 2: -big + 7}), (2, {1: 5, 2: 5}), (3, {1: -big, 2: -big}), (4, {1: big, 2: big})])
    found = [(r.id, r.score) for r in maxscore.top_k(rows, rows.filter("id = 0"), 5).orderBy("rank").collect()]
    assert found == [(1, 2**63 - 1), (2, 2**63 - 1), (4, 2**63 - 1), (3, -(2**63))]


def test_vectors_with_bad_components_take_no_part(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, []), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS w", "1 AS id")
    got = {r.id: (r.terms, r.weights) for r in maxscore.from_vectors(df, "vec_id", "embedding").collect()}
    assert got == {1: ([1, 2], [128, -1]), 6: ([], []), 7: ([], [])}


def brute_links(rows, threshold):
    usable = {}
    for k, (i, v, lab) in enumerate(rows):
        if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[k] = np.array(v) / np.linalg.norm(v)
    parent, n = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in usable:
        for b in usable:
            if a < b and rows[a][2] == rows[b][2] and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= threshold:
                n[a] += 1
                n[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for k, r in enumerate(rows):
        low[root(k)] = min(low.get(root(k), r[0]), r[0])
    return sorted((r[0], n[k], low[root(k)], r[0] == low[root(k)]) for k, r in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    rng, rows = np.random.default_rng(2), []
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + 0.03 * rng.standard_normal(16) * np.linalg.norm(base) / 4).tolist(), g % 3))
    rows += [(1000 + i, rows[0][1], 0) for i in range(50)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [None] + [1.0] * 15, 1), (2003, [float("nan")] * 16, 1), (2004, rows[0][1], None), (2005, rows[0][1][:8], 0), (5, rows[5][1], rows[5][2]), (2006, [x * 1e-200 for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS cls", "'a' AS unit", "2 AS keys")
    got = vector_neardup.near_duplicates(df, block=16)
    assert sorted(map(tuple, got.collect())) == brute_links(rows, 0.98)
    assert vector_neardup.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_standard_parameters():
    assert vector_neardup.recall(0.98) > 0.99
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = (vector_neardup.hash_keys(x) == vector_neardup.hash_keys(y)).any(axis=1).mean()
    assert met > 0.99


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 400)] + [(7, 7), (900, 800), (800, 850)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 400)} | {900: 800, 850: 800}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_forest():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    v, r = local_forest(a, b)
    label = dict(zip(v.tolist(), r.tolist()))
    parent = {i: i for i in range(200)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        lo, hi = sorted((root(x), root(y)))
        parent[hi] = lo
    assert all(label.get(i, i) == root(i) for i in range(200))


def test_hot_keys_are_broadcast(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(i, i) for i in range(2, 100)] + [(None, 0)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(1, 50)], "k long, w long")
    assert join_heavy(left, right, "k").count() == 500 + 48
    assert join_heavy(left, right, "k", "left").filter("w IS NULL").count() == 50 + 1

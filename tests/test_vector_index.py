"""The inverted-file index against the exact leg."""

import numpy as np
import pytest

from lodestone.config import Settings
from lodestone.operators import vector_index as V
from lodestone.operators.search import dense_leg


def table(spark, x, kbs=2):
    return spark.createDataFrame([(i % kbs, i, f"h{i}", [float(v) for v in row]) for i, row in enumerate(x)], "kb_id int, item_id long, hash string, vector array<double>")


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    return centres[rng.integers(40, size=3000)] + 0.6 * rng.normal(size=(3000, 24)), centres[rng.integers(40, size=30)] + 0.6 * rng.normal(size=(30, 24))


def test_recall_and_what_is_read(spark, tmp_path, clusters, monkeypatch):
    x, q = clusters
    monkeypatch.setattr(V, "PART", 20)  # so that lists have several parts
    index = V.VectorIndex.build(str(tmp_path / "v"), table(spark, x), sample=500)
    asked = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(q)], "query_id long, vector array<double>")
    scope = spark.createDataFrame([(i, k, k) for i in range(30) for k in (0, 1)], "query_id long, kb_id int, kb_pos int")
    s = Settings(cross_kb="global")
    assert index.lists().count() == 3000 and index.centres().count() == 2 * 39
    assert index.lists().select("part").distinct().count() > 1
    assert index.recall(asked, scope, s, probes=10) >= 0.95
    found = index.candidates(asked, scope, s.pool * V.RERANK, 10)
    assert found.groupBy("query_id", "kb_id").count().agg({"count": "max"}).head()[0] <= s.pool * V.RERANK
    assert found.select("query_id", "kb_id", "list").distinct().count() <= 30 * 2 * 10
    # With all lists the scores of common hits are those of the exact leg.
    vectors = table(spark, x)
    exact = {(r.query_id, r.hash): (r.rank, r.score) for r in dense_leg(asked, vectors, scope, s).collect()}
    mine = {(r.query_id, r.hash): (r.rank, r.score) for r in index.leg(asked, scope, s, probes=39).collect()}
    assert len(exact.keys() & mine.keys()) >= 0.99 * len(exact)
    assert all(abs(exact[k][1] - mine[k][1]) < 2e-6 for k in exact.keys() & mine.keys())


def test_copies_odd_vectors_and_dimensions(spark, tmp_path):
    rows = [(0, i, f"h{i}", [1.0, 0.0]) for i in range(50)] + [(0, 60, "z", [0.0, 0.0]), (0, 61, "n", None), (0, 62, "x", [float("nan"), 1.0]), (1, 63, "y", [0.0, 2.0]), (None, 64, "k", [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "kb_id int, item_id long, hash string, vector array<double>")
    index = V.VectorIndex.build(str(tmp_path / "v"), vectors)
    assert sorted(r.item_id for r in index.lists().collect()) == [*range(50), 63]
    scope = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 7, 0)], "query_id long, kb_id int, kb_pos int")
    asked = lambda v: spark.createDataFrame([(1, v), (2, v)], "query_id long, vector array<double>")
    got = index.leg(asked([3.0, 0.0]), scope, Settings(), probes=8).orderBy("rank").collect()
    assert {r.query_id for r in got} == {1} and len(got) == 25 and got[0].score == 1.0 and got[-1].hash == "y"
    with pytest.raises(Exception, match="dimension"):
        index.leg(asked([1.0, 0.0, 0.0]), scope, Settings()).collect()
    empty = V.VectorIndex.build(str(tmp_path / "e"), vectors.limit(0))
    assert empty.leg(asked([1.0, 0.0]), scope, Settings()).count() == 0

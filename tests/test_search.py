import math
import random

import pytest

from lodestone.config import Settings
from lodestone.operators import search
from lodestone.operators.index import EXACT, SPARSE


def model(dense, sparse, exact, s, k):
    """Fusion over lists of (hash, rank), kept in order of insertion."""
    found, order = {}, []
    for i, leg in enumerate((dense, sparse, exact)):
        for h, rank in leg:
            if h not in found:
                found[h] = [None] * 3
                order.append(h)
            found[h][i] = rank
    weights = (s.dense_weight, s.sparse_weight, s.exact_weight)

    def score(h):
        out = 0.0
        for w, r in zip(weights, found[h]):
            out += 0.0 if r is None else w / (s.rrf_k + r)
        return out

    return sorted(order, key=score, reverse=True)[:k]


def test_fusion_equals_a_list_model(spark):
    rng, s = random.Random(3), Settings()
    legs, want = {"dense": [], "sparse": [], "exact": []}, {}
    for q in range(60):
        lists = []
        for name in legs:
            ranks = [(f"h{i}", r) for r, i in enumerate(rng.sample(range(20), rng.randint(0, 12)))]
            lists.append(ranks)
            legs[name] += [(q, h, int(h[1:]), 0, r) for h, r in ranks]
        want[q] = model(*lists, s, s.top_k)
    frames = {n: spark.createDataFrame(r, "query_id long, hash string, item_id long, kb_id int, rank int") for n, r in legs.items()}
    got = {}
    for r in search.rrf_merge(frames, s).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.hash)
    assert got == {q: w for q, w in want.items() if w}


@pytest.fixture
def corpus(spark):
    rows = [(0, 1, "h1", "apple pie apple"), (0, 2, "h2", "apple tart"), (1, 3, "h1", "apple pie apple"), (1, 4, "h4", "cold soup"), (1, 5, "h5", "")]
    return spark.createDataFrame(rows, "kb_id int, item_id long, hash string, text string")


def scope(spark, pairs):
    return spark.createDataFrame(pairs, "query_id long, kb_id int, kb_pos int")


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, text string, vector array<double>")


def test_exact_scores_use_the_whole_table_and_leave_gaps(spark, corpus):
    ix = search.Index(corpus)
    s = scope(spark, [(1, 0, 0), (1, 1, 1), (2, 0, 0), (3, 0, 0)])
    q = queries(spark, [(1, "Apple pie?", None), (2, "  ", None), (3, "nothing", None)])
    leg = search.exact_leg(ix.text_hits(q, s, 24, [EXACT]), Settings()).collect()
    idf = {t: math.log10(5 / n) for t, n in (("apple", 3), ("pie", 2))}
    got = {(r.query_id, r.hash): (r.rank, r.score, r.item_id) for r in leg}
    assert set(got) == {(1, "h1"), (1, "h2")}
    assert got[1, "h1"] == (0, pytest.approx(2 * idf["apple"] ** 2 + idf["pie"] ** 2, abs=1e-6), 1)
    assert got[1, "h2"][0] == 2  # the copy of h1 takes rank 1


def test_sparse_ranks_by_knowledge_base_first(spark, corpus):
    s = scope(spark, [(1, 1, 0), (1, 0, 1)])
    q, ix = queries(spark, [(1, "apple tart", None)]), search.Index(corpus)
    hits = ix.text_hits(q, s, 24, [SPARSE])
    leg = search.sparse_leg(hits, s, Settings()).orderBy("rank").collect()
    assert [(r.hash, r.rank, r.item_id) for r in leg] == [("h1", 0, 3), ("h2", 1, 2)]
    leg = search.sparse_leg(hits, s, Settings(cross_kb="global")).orderBy("rank").collect()
    assert [r.hash for r in leg] == ["h2", "h1"]


def test_dense_dedups_by_text_and_rejects_dimensions(spark):
    v = spark.createDataFrame([(0, 1, "a", [1.0, 0.0]), (0, 2, "a", [0.9, 0.1]), (0, 3, "b", [0.0, 1.0])], "kb_id int, item_id long, hash string, vector array<double>")
    s = scope(spark, [(1, 0, 0)])
    leg = search.dense_leg(queries(spark, [(1, "", [1.0, 0.0])]), v, s, Settings()).orderBy("rank").collect()
    assert [(r.hash, r.item_id, r.rank) for r in leg] == [("a", 1, 0), ("b", 3, 1)]
    with pytest.raises(Exception, match="dimension"):
        search.dense_leg(queries(spark, [(1, "", [1.0, 0.0, 0.0])]), v, s, Settings()).collect()


def test_index_switches_and_limits(spark, corpus):
    v = corpus.selectExpr("kb_id", "item_id", "hash", "array(double(item_id), 1.0D) vector")
    ix, s = search.Index(corpus, v), scope(spark, [(1, 0, 0), (1, 1, 1)])
    q = queries(spark, [(1, "apple", [1.0, 0.0])])
    assert ix.search(q, s).count() == 4
    assert ix.test_retrieval(q, s, 10).count() == 4
    assert ix.search(q, s, Settings(dense_enabled=False)).count() == 2
    assert ix.search(queries(spark, [(1, " ", None)]), s).count() == 0
    with pytest.raises(ValueError):
        ix.search(q, s, Settings(dense_enabled=False, sparse_enabled=False, exact_enabled=False))


def test_a_stored_index_gives_the_same_results(spark, data, tmp_path):
    from lodestone.plans import queries as Q
    from lodestone.sources import tables as S

    own = Q.index(spark, data)
    search.Index(S.items(spark, data), S.vectors(spark, data), str(tmp_path / "index"))
    stored = search.Index.open(spark, str(tmp_path / "index"))
    asked, scope = S.search_queries(spark, data), Q.scope_own(spark, data)
    pick = lambda ix: sorted(map(str, Q.ranked(ix.search(asked, scope)).collect()))
    assert pick(stored) == pick(own)

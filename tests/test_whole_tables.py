from lodestone.config import Settings
from lodestone.operators import records, search
from lodestone.plans.queries import QUERIES
from lodestone.sources import tables as S


def test_every_document_is_counted(spark, data):
    docs = S.documents(spark, data)
    want = {r.knowledge_base_id: r["count"] for r in docs.groupBy("knowledge_base_id").count().collect()}
    assert {r.id: r.documents for r in QUERIES["kb_doc_counts"](spark, data).collect()} == want


def test_every_document_is_fused(spark, data):
    rows = QUERIES["rrf_merge"](spark, data).collect()
    ids = [r.doc_id for r in S.table(spark, data, "documents").select("doc_id").collect()]
    assert {(r.query_id, r["rank"]) for r in rows} == {(q, k) for q in range(7) for k in range(min(24, sum(i % 7 == q for i in ids)))}
    part = lambda w, k: w / (60 + k)
    for r in rows:
        k = r.item_id // 7
        assert (r.dense_rank, r.sparse_rank, r.exact_rank) == (k, k ^ 1, k ^ 2)
        assert abs(r.score - part(0.5, k) - part(0.3, k ^ 1) - part(0.2, k ^ 2)) < 1e-8


def test_every_document_is_found(spark, data):
    ids = {r.id for r in S.documents(spark, data).select("id").collect()}
    rows = QUERIES["document_or_upload"](spark, data).collect()
    assert {r.id for r in rows if r.origin == "document"} == ids & {r.item_id for r in S.table(spark, data, "benchmark").select("item_id").collect()}


def test_missing_rows(spark):
    """A knowledge base without documents, an id that only uploads have, and a hit of one list only."""
    kbs = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, name string, user_id int")
    docs = spark.createDataFrame([(5, 1, "x", "kb/x")], "id long, knowledge_base_id int, file_name string, file_path string")
    assert {r.id: r.documents for r in records.kb_document_counts(kbs, docs).collect()} == {1: 1, 2: 0}
    up = spark.createDataFrame([(5, "u", "tmp/u"), (6, "v", "tmp/v")], "id long, file_name string, temp_path string")
    got = records.document_or_upload(spark.range(5, 8), docs.drop("knowledge_base_id"), up).select("id", "path", "origin")
    assert sorted(map(tuple, got.collect())) == [(5, "kb/x", "document"), (6, "tmp/v", "upload")]
    leg = lambda *ids: spark.createDataFrame([(0, str(i), i, 0, k) for k, i in enumerate(ids)], "query_id int, hash string, item_id long, kb_id int, rank int")
    fused = search.rrf_merge({"dense": leg(1, 2), "sparse": leg(2), "exact": leg(3)}, Settings(), 24)
    assert {r.item_id: (r.dense_rank, r.sparse_rank, r.exact_rank) for r in fused.collect()} == {1: (0, None, None), 2: (1, 0, None), 3: (None, None, 0)}

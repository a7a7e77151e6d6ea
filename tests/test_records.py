import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, records
from lodestone.operators.chunking import chunk_fixed, with_ids
from lodestone.operators.incremental import ChunkStore, cascade_kb, deleted_chunks, new_chunks
from lodestone.schema import TABLES, migrate
from lodestone.sources.files import FileStore, load_files
from lodestone.streaming import jobs


def chunks(spark, files):
    df = spark.createDataFrame([(kb, f, t) for kb, f, t in files], "kb_id int, file_name string, text string")
    return with_ids(chunk_fixed(df, size=10, overlap=2)), df


def state(store):
    return sorted((r.kb_id, r.file_name, r.chunk_index, r.chunk_text) for r in store.read().collect())


def test_store_follows_versions(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.read() is None
    v1, f1 = chunks(spark, [(1, "a", "abcdefghijklmnopqrst"), (1, "b", "hello"), (2, "a", "hello")])
    v2, f2 = chunks(spark, [(1, "a", "abcdefghij-CHANGED"), (1, "b", "")])
    assert store.apply(v1, f1) == (v1.count(), 0)
    before = state(store)
    assert store.apply(v1, f1) == (0, 0) and state(store) == before
    added, gone = store.apply(v2, f2)
    assert added > 0 and gone > 0
    fresh = ChunkStore(spark, str(tmp_path / "t"))
    both, files = chunks(spark, [(1, "a", "abcdefghij-CHANGED"), (2, "a", "hello")])
    fresh.apply(both, files)
    assert state(store) == state(fresh)
    store.delete_kb(2)
    assert {r[0] for r in state(store)} == {1}
    store.vacuum()
    assert {r[0] for r in state(store)} == {1}


def test_differences(spark):
    old, _ = chunks(spark, [(1, "a", "same"), (1, "b", "gone")])
    new, files = chunks(spark, [(1, "a", "same"), (1, "b", "")])
    assert new_chunks(new, old).count() == 0
    assert [r.file_name for r in deleted_chunks(new, old, files).collect()] == ["b"]


def test_scoping_paging_and_updates(spark):
    kb = spark.createDataFrame([(i, f"k{i}", None, i % 2) for i in range(10)], "id int, name string, description string, user_id int")
    assert [r.id for r in records.paged(records.scoped(kb, 1), 1, 2).collect()] == [3, 5]
    assert records.get(kb, 3, 0).count() == 0
    got = {r.id: (r.name, r.description) for r in records.updated(kb, 3, {"name": "new", "description": None}, 1).collect()}
    assert got[3] == ("new", None) and got[5] == ("k5", None)
    with pytest.raises(ValueError):
        records.check_chat_scope([1, 1], kb, 1)
    records.check_chat_scope([1, 3], kb, 1)


def test_statuses_and_expiry(spark):
    t = datetime.datetime(2024, 1, 2)
    up = spark.createDataFrame([(1, t), (2, t - datetime.timedelta(hours=25)), (3, None)], "id int, created_at timestamp")
    assert [r.id for r in records.expired(up, t).collect()] == [2]
    tasks = spark.createDataFrame([(1, "completed"), (1, "failed"), (2, "processing")], "kb int, status string")
    assert sorted(tuple(r) for r in records.batch_outcome(tasks, ["kb"]).collect()) == [(1, True, True), (2, False, False)]


def test_cascade_keeps_unowned_rows(spark):
    docs = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, knowledge_base_id int")
    gone = spark.createDataFrame([(1,)], "id int")
    assert sorted(r.id for r in cascade_kb(gone, {"documents": docs})["documents"].collect()) == [2, 3]


def test_nested_tree(spark):
    kb = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    docs = spark.createDataFrame([(5, 1, "f", 3)], "id int, knowledge_base_id int, file_name string, file_size int")
    tasks = spark.createDataFrame([(9, 5, "completed", None)], "id int, document_id int, status string, error_message string")
    got = {r.id: r.documents for r in records.kb_tree(kb, docs, tasks).collect()}
    assert got[2] == [] and got[1][0].processing_tasks[0].task_id == 9


def test_answer_flow(spark):
    """Citation lookups happen once for each distinct pair, and the envelope survives its round trip."""
    cites = spark.createDataFrame([(i, f"Citation {i}", {"kb_id": "1", "document_id": "1"}) for i in range(50)] + [(50, "none", {}), (51, "half", {"kb_id": "1"})], "id int, text string, metadata map<string,string>")
    assert [tuple(r) for r in answers.lookups(cites).collect()] == [("1", "1")]
    items = spark.createDataFrame([(1, 'say "é"', {"kb_id": "1", "document_id": "7"}), (2, "two", {})], "item_id long, text string, metadata map<string,string>")
    packed = answers.context(spark.createDataFrame([(3, 0, 1), (3, 1, 2)], "query_id long, rank int, item_id long"), items)
    row = packed.withColumn("e", answers.envelope(F.col("passages"), F.lit("q"))).withColumn("o", answers.opened(F.col("e"))).head()
    assert row.context == '[1] say "é"\n\n[2] two'
    assert row.o.context[0].page_content == 'say "é"' and row.o.rewritten_query == "q"
    full = packed.select(F.col("query_id").alias("answer_id"), F.concat(answers.envelope(F.col("passages"), F.lit("q")), F.lit("__LLM_RESPONSE__x [citation:1] [citation:2] [citation:9]")).alias("content"))
    kb, docs = spark.createDataFrame([(1, "KB")], "id int, name string"), spark.createDataFrame([(7, "f.pdf")], "id int, file_name string")
    got = sorted((r.number, r.kb_name, r.file_name) for r in answers.citations(full, kb, docs).collect())
    assert got == [(1, "KB", "f.pdf"), (2, None, None)]
    assert spark.createDataFrame([("no base64!",)], "e string").select(answers.opened(F.col("e"))).head()[0] is None


def test_frames_round_trip(spark):
    body = '0:"a\\n\\"b\\""\n0:" c"\nnoise\n3:bad\nd:{}\n'
    df = spark.createDataFrame([(1, body)], "body_id long, body string")
    rows = answers.parsed_frames(df)
    assert sorted((r.seq, r.kind, r.payload) for r in rows.collect()) == [(0, "0", 'a\n"b"'), (1, "0", " c"), (3, "3", "bad"), (4, "d", "{}")]
    assert answers.joined_frames(rows).head().text == 'a\n"b" c'


def test_history_and_routes(spark):
    m = spark.createDataFrame([(1, 1, "user", "u"), (2, 1, "system", "s"), (3, 1, "assistant", "e__LLM_RESPONSE__a"), (4, 1, "user", "last")], "id long, chat_id long, role string, content string")
    assert [(t.role, t.content) for t in answers.history(m).head().history] == [("user", "u"), ("assistant", "a")]
    q = spark.createDataFrame([(1, "who are you?"), (2, "x"), (3, "y")], "query_id long, text string")
    got = {r.query_id: r.route for r in answers.routed(q, spark.createDataFrame([(1,), (2,)], "query_id long")).collect()}
    assert got == {1: "identity", 2: "search", 3: "no_kb"}


def test_loaders_and_store(spark, tmp_path):
    store = FileStore(spark, str(tmp_path / "store"))
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:p/></w:body></w:document>')
    store.save("user_1/kb_1/a.docx", doc.getvalue())
    store.save("user_1/kb_1/b.md", b"# T")
    store.save("user_1/kb_1/bad.docx", b"no zip")
    store.save("user_1/kb_2/c.txt", b"\xff\xfe")
    got = {r.file_name: (r.text, r.status) for r in load_files(spark, str(tmp_path / "store")).collect()}
    assert got["a.docx"] == ("Hello\tyou\n\n", "completed") and got["b.md"] == ("# T", "completed")
    assert got["bad.docx"] == (None, "failed") and got["c.txt"][1] == "failed"
    assert {r.path for r in store.list("user_1/kb_1").collect()} == {"user_1/kb_1/a.docx", "user_1/kb_1/b.md", "user_1/kb_1/bad.docx"}
    store.move("user_1/kb_1/b.md", "user_1/kb_3/b.md")
    store.delete("user_1/kb_1/b.md")
    store.delete_kb(1, 1)
    assert store.list("user_1/kb_1").count() == 0 and store.list("user_1/kb_3").count() == 1
    with pytest.raises(ValueError):
        store.save("../x", b"")


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first text")
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    run = lambda: jobs.ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), 1).awaitTermination(120)
    run()
    assert [r[3] for r in state(store)] == ["first text"]
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "a.txt").write_text("second text")
    run()
    assert [r[3] for r in state(store)] == ["second text"]


def test_streaming_states(spark, tmp_path):
    rows = [(i, i % 3, datetime.datetime(2024, 1, 1, 0, i), s) for i, s in enumerate(["pending", "pending", "pending", "processing", "failed", "completed"])]
    spark.createDataFrame(rows, "event_id long, task_id long, ts timestamp_ntz, status string").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("event_id long, task_id long, ts timestamp_ntz, status string").parquet(str(tmp_path / "ev"))
    q = jobs.task_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.task_id: r.status for r in spark.table("states").collect()} == {0: "processing", 1: "failed", 2: "completed"}
    q = jobs.upload_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").head().uploads == 6


def test_migration_round_trip(spark):
    old = spark.createDataFrame([("1", '{"page_content":"t","chunk_index":3,"source":"s"}')], "id string, chunk_metadata string")
    new = migrate(old, 0, 1)
    assert tuple(new.select("chunk_text", "chunk_index", "chunk_metadata").head()) == ("t", 3, '{"source":"s"}')
    back = migrate(new, 1, 0).select(F.from_json("chunk_metadata", "map<string,string>")).head()[0]
    assert back == {"page_content": "t", "chunk_index": "3", "source": "s"}
    with pytest.raises(ValueError):
        migrate(old, 0, 9)


def test_schemas_parse(spark):
    for ddl in TABLES.values():
        assert spark.createDataFrame([], ddl).columns

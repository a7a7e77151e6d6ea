"""The chunk store's versions: untouched folders, conflicts, dead writers, compaction."""

import pytest

from lodestone.operators.chunking import chunk_fixed, with_ids
from lodestone.operators.incremental import ChunkStore
from lodestone.operators.versions import Conflict, Versions


def chunks(spark, files):
    df = spark.createDataFrame(files, "kb_id int, file_name string, text string")
    return with_ids(chunk_fixed(df, size=10, overlap=2)), df


def texts(store, **how):
    return sorted((r.kb_id, r.file_name, r.chunk_text) for r in store.read(**how).collect())


@pytest.fixture
def store(spark, tmp_path):
    out = ChunkStore(spark, str(tmp_path / "store"))
    out.apply(*chunks(spark, [(k, f"f{i}", f"text {k} {i}") for k in range(5) for i in range(3)]))
    return out


def test_untouched_knowledge_bases_keep_their_folders(spark, store):
    before = store.folders()
    assert store.apply(*chunks(spark, [(1, "f0", "new text")])) == (1, 1)
    after = store.folders()
    assert {k for k in before if before[k] != after[k]} == {"1"}
    assert store.apply(*chunks(spark, [(1, "f0", "new text"), (2, "f0", "text 2 0")])) == (0, 0)
    assert store.folders() == after
    store.upsert(store.read([3]).limit(1))
    assert {k for k in after if after[k] != store.folders()[k]} == {"3"}
    assert len(texts(store)) == 15
    store.delete_kb(4)
    assert set(store.folders()) == {"0", "1", "2", "3"} and store.read([4]).count() == 0
    assert store.read(number=0).count() == 15


def test_a_write_reads_only_what_it_touches(spark, store):
    """A folder of another knowledge base may be gone: no write notices."""
    store.versions.remove(f"data/{store.folders()['2']}")
    assert store.apply(*chunks(spark, [(1, "f0", "new text")])) == (1, 1)
    assert texts(store, kb_ids=[1])[0] == (1, "f0", "new text")


def test_a_dead_writer_leaves_the_old_version(spark, store, monkeypatch):
    before = texts(store)
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.apply(*chunks(spark, [(1, "f0", "half written")]))
    assert texts(store) == before and len(store.versions.names("data")) == 2
    store.vacuum()
    assert texts(store) == before and len(store.versions.names("data")) == 1
    assert store.apply(*chunks(spark, [(1, "f0", "written")])) == (1, 1)


def test_two_writers(spark, store):
    """Of one knowledge base the second fails and changes nothing; of different ones both count."""
    other = ChunkStore(spark, store.path)
    number, content = other.versions.newest()
    rows = {k: other._rows(content, [k]) for k in (1, 2)}
    store.apply(*chunks(spark, [(1, "f0", "first")]))
    now = texts(store)
    with pytest.raises(Conflict):
        other._write(number, rows[1], [1])
    assert texts(store) == now
    other._write(number, rows[2].filter("file_name = 'f1'"), [2])
    assert [t for t in texts(store) if t[0] == 2] == [(2, "f1", "text 2 1")] and (1, "f0", "first") in texts(store)
    with pytest.raises(Conflict):
        store.versions.commit(store.versions.newest()[0], {})


def test_compaction_and_old_versions(spark, store):
    rows = store.read([0])
    rows.repartition(12, "id").write.parquet(f"{store.path}/data/many/kb__=0")
    store.versions.change(store.versions.newest()[0], lambda _, newest: newest | {"folders": newest["folders"] | {"0": "many/kb__=0"}})
    before = texts(store)
    assert store.compact(files=1) == [0] and texts(store) == before
    assert len([n for n in store.versions.names(f"data/{store.folders()['0']}") if n.endswith(".parquet")]) == 1
    store.vacuum(versions=2)
    assert store.read(number=1).count() == 15
    store.vacuum()
    assert texts(store) == before and store.versions.numbers() == [2]

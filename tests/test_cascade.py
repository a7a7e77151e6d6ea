"""Deletions that stop after any step and go on."""

import pytest

from lodestone.operators.cascade import Cascade
from lodestone.operators.incremental import ChunkStore
from lodestone.operators.search import Index
from lodestone.sources.files import FileStore


@pytest.fixture
def stores(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"{k}-{i}") for k in (1, 2) for i in range(3)], "kb_id int, id string")
    tables = {n: ChunkStore(spark, str(tmp_path / n)) for n in ("document_chunks", "documents", "knowledge_bases")}
    for t in tables.values():
        t.write(rows)
    items = spark.createDataFrame([(k, 10 * k + i, f"h{k}{i}", "some words") for k in (1, 2) for i in range(3)], "kb_id int, item_id long, hash string, text string")
    files = FileStore(spark, str(tmp_path / "files"))
    for k in (1, 2):
        files.save(f"user_7/kb_{k}/a.txt", b"x")
    return tables, Index(items, path=str(tmp_path / "index")), files


def state(stores):
    tables, index, files = stores
    held = {n: sorted(r.id for r in t.read().collect()) for n, t in tables.items()}
    return held | {"index": index.refresh().items, "df": {r.term: r.df for r in index.frequencies().collect()}, "files": sorted(r.path for r in files.list().collect())}


WANT = {n: ["2-0", "2-1", "2-2"] for n in ("document_chunks", "documents", "knowledge_bases")} | {"index": 3, "df": {"some": 3, "words": 3}, "files": ["user_7/kb_2/a.txt"]}


def test_a_stop_after_any_step_and_a_rerun(spark, tmp_path, stores):
    """The first run ends within the first step, the next within the second, and so on: before its work, or behind it."""
    names = ["index", "files", "document_chunks", "documents", "knowledge_bases"]
    for n, name in enumerate(names):
        cascade = Cascade.over(spark, str(tmp_path / "journal"), *stores)
        step = cascade.steps[name]

        def stops(kb, owner, step=step, behind=n % 2):
            if behind:
                step(kb, owner)
            raise KeyboardInterrupt

        cascade.steps[name] = stops
        with pytest.raises(KeyboardInterrupt):
            cascade.delete(1, 7) if n == 0 else cascade.resume()
        assert cascade.open() == [(1, 7)]
    last = Cascade.over(spark, str(tmp_path / "journal"), *stores)
    assert last.resume() == [] and last.open() == [] and state(stores) == WANT
    assert last.delete(1, 7) == [] and state(stores) == WANT


def test_failures_of_outer_stores_are_warnings(spark, tmp_path, stores, monkeypatch):
    cascade = Cascade.over(spark, str(tmp_path / "journal"), *stores)
    with monkeypatch.context() as m:
        m.setattr(stores[2], "delete_kb", lambda *_: (_ for _ in ()).throw(OSError("no answer")))
        assert cascade.delete(1, 7) == [("files", "OSError: no answer")]
    assert [tuple(r) for r in cascade.warnings().collect()] == [(1, "files", "OSError: no answer")] and cascade.open() == [(1, 7)]
    assert state(stores) == WANT | {"files": ["user_7/kb_1/a.txt", "user_7/kb_2/a.txt"]}
    assert cascade.resume() == [] and cascade.warnings().count() == 0 and state(stores) == WANT


def test_a_table_that_fails_stops_the_deletion(spark, tmp_path, stores, monkeypatch):
    cascade = Cascade.over(spark, str(tmp_path / "journal"), *stores)
    with monkeypatch.context() as m:
        m.setattr(stores[0]["documents"], "delete_kb", lambda *_: (_ for _ in ()).throw(OSError("down")))
        with pytest.raises(OSError):
            cascade.delete(1, 7)
    assert len(state(stores)["knowledge_bases"]) == 6 and cascade.open() == [(1, 7)]
    assert cascade.resume() == [] and state(stores) == WANT

"""The file sink: all files of a write or none."""

import os

import pytest

from lodestone.sources import sink
from lodestone.sources.files import load_files


def held(base):
    return sorted(os.path.relpath(os.path.join(d, f), base) for d, _, names in os.walk(base) for f in names)


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string").repartition(3)


def test_files_are_written_replaced_and_read(spark, tmp_path):
    base = str(tmp_path / "out")
    sink.write_files(frame(spark, [("kb_1/a.txt", "one"), ("kb_1/b/c.md", "two"), ("d.txt", None)]), base)
    assert held(base) == ["d.txt", "kb_1/a.txt", "kb_1/b/c.md"] and os.listdir(base) == [x for x in os.listdir(base) if not x.startswith(".")]
    sink.write_files(frame(spark, [("kb_1/a.txt", "new")]), base)
    assert {r.file_name: r.text for r in load_files(spark, base).collect()} == {"a.txt": "new", "c.md": "two"}  # Spark leaves empty files out
    assert os.path.getsize(f"{base}/d.txt") == 0
    sink.write_files(frame(spark, []), base)
    assert len(held(base)) == 3


@pytest.mark.parametrize("bad", [[("x.txt", "1"), ("../y.txt", "2")], [("x.txt", "1"), ("x.txt", "2")], [("x.txt", "1"), (None, "2")]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    base = str(tmp_path / "out")
    sink.write_files(frame(spark, [("kept.txt", "k")]), base)
    with pytest.raises(Exception, match="no name|one path"):
        sink.write_files(frame(spark, [(f"f{i}", "v") for i in range(20)] + bad), base)
    assert held(base) == ["kept.txt"] and os.listdir(base) == ["kept.txt"]


def test_a_driver_that_ends_amid_the_renames(tmp_path, monkeypatch):
    base = str(tmp_path)
    writer = sink._Writer(base)
    row = lambda p: type("Row", (), {"path": p, "content": b"x"})
    messages = [writer.write(iter([row("a"), row("b/c")])), None, writer.write(iter([row("d")]))]
    writer.write(iter([row("e")]))  # a task that was repeated: its message counts nowhere
    with monkeypatch.context() as m:
        m.setattr(sink, "_finish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            writer.commit(messages)
    os.rename(f"{base}/{messages[0].moves[0][0]}", f"{base}/a")  # the first rename was done
    other = sink._Writer(base)
    other.write(iter([row("f")]))  # ended before its commit
    assert len(sink.recover(base)) == 2
    assert held(base) == ["a", "b/c", "d"] and sink.recover(base) == []

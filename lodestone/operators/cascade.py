"""Deletion of knowledge bases over stored tables, a text index and files, that can stop anywhere and go on.

A journal says which steps of a deletion are done. Steps are idempotent, so one that ended between its work and its entry is
simply done again. Stores outside the tables (index, files) may fail: that becomes a warning, the deletion goes on, and
resume() tries the step again; a table that fails stops the deletion, which resume() takes up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.incremental import ChunkStore
from lodestone.operators.index import TextIndex
from lodestone.operators.versions import Versions
from lodestone.sources.files import FileStore

Step = Callable[[int, int], None]


class Cascade:
    """path: the journal's. Steps (kb_id, owner) are taken in order; those named in soft give warnings."""

    def __init__(self, spark: SparkSession, path: str, steps: dict[str, Step], soft: set[str] = frozenset()):
        self.spark, self.steps, self.soft = spark, steps, set(soft)
        self.journal = Versions(spark, path)

    @classmethod
    def over(cls, spark: SparkSession, path: str, tables: dict[str, ChunkStore], index: TextIndex | None = None, files: FileStore | None = None) -> Cascade:
        """The steps over stored tables, in their order, after those over an index and files, if there are any."""
        steps: dict[str, Step] = {}
        if index is not None:
            steps["index"] = lambda kb, _: index.refresh().delete_kb(kb) and None
        if files is not None:
            steps["files"] = lambda kb, owner: files.delete_kb(owner, kb)
        steps |= {name: (lambda kb, _, t=table: t.delete_kb(kb)) for name, table in tables.items()}
        return cls(spark, path, steps, {"index", "files"})

    def _note(self, kb_id: int, **entry: object) -> None:
        """Set an entry of the journal; others may note theirs meanwhile."""
        self.journal.change(self.journal.newest()[0], lambda _, newest: newest | {str(kb_id): newest.get(str(kb_id), {}) | entry})

    def delete(self, kb_id: int, owner: int) -> list[tuple[str, str]]:
        """Delete a knowledge base, or go on with its deletion; the warnings (step, message)."""
        entry = self.journal.newest()[1].get(str(kb_id), {})
        done, warnings = list(entry.get("done", [])), []
        if not entry:
            self._note(kb_id, owner=owner, done=[], warnings=[])
        for name, step in self.steps.items():
            if name in done:
                continue
            try:
                step(kb_id, owner)
            except Exception as e:
                if name not in self.soft:
                    raise
                warnings.append((name, f"{type(e).__name__}: {e}"[:500]))
                continue
            done.append(name)
            self._note(kb_id, done=done)
        self._note(kb_id, warnings=[list(w) for w in warnings])
        return warnings

    def open(self) -> list[tuple[int, int]]:
        """(kb_id, owner) of the deletions that have steps left."""
        return [(int(k), e["owner"]) for k, e in self.journal.newest()[1].items() if set(self.steps) - set(e["done"])]

    def resume(self) -> list[tuple[str, str]]:
        """Go on with all deletions that have steps left; their warnings."""
        return [w for kb_id, owner in self.open() for w in self.delete(kb_id, owner)]

    def warnings(self) -> DataFrame:
        """(kb_id, step, message) of the steps that failed when they were last tried."""
        rows = [(int(k), *w) for k, e in self.journal.newest()[1].items() for w in e["warnings"]]
        return self.spark.createDataFrame(rows, "kb_id int, step string, message string")

"""Incremental maintenance of chunk tables: change detection, upserts, deletions, cascades."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.versions import Conflict, Versions


def new_chunks(current: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks of current whose (kb_id, file_name, hash) isn't in existing."""
    return current.join(existing.select("kb_id", "file_name", "hash"), ["kb_id", "file_name", "hash"], "left_anti")


def deleted_chunks(current: DataFrame, existing: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of existing in the files (kb_id, file_name) that were processed, whose hash is gone; a file
    without a chunk loses all."""
    return existing.join(files.select("kb_id", "file_name").distinct(), ["kb_id", "file_name"], "left_semi").join(current.select("kb_id", "file_name", "hash"), ["kb_id", "file_name", "hash"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new put in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def without(df: DataFrame, keys: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows of df whose column isn't among the keys; rows where it is null stay."""
    return df.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def cascade_kb(kb_ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after the deletion of knowledge bases (id): what belongs to them goes too."""
    out = dict(tables)
    for name, column in (("knowledge_bases", "id"), ("documents", "knowledge_base_id"), ("document_uploads", "knowledge_base_id"), ("processing_tasks", "knowledge_base_id"), ("document_chunks", "kb_id"), ("points", "kb_id"), ("chat_knowledge_bases", "knowledge_base_id")):
        if name in out:
            out[name] = without(out[name], kb_ids, column)
    return out


def cascade_chat(chat_ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = dict(tables)
    for name, column in (("chats", "id"), ("messages", "chat_id"), ("chat_knowledge_bases", "chat_id")):
        if name in out:
            out[name] = without(out[name], chat_ids, column)
    return out


class ChunkStore:
    """A chunk or point table on disk, in folders of knowledge bases, with a manifest for each version.

    A write puts new folders beside the old ones for the knowledge bases that it touches, and then commits a manifest that names
    them; all others keep their folders, which are neither read nor written. What a writer leaves that dies before the
    commit is no part of any version, until vacuum() removes it. Writers of different knowledge bases don't disturb each
    other; of two that touch the same one, the second gets Conflict and has changed nothing. A manifest has an entry for
    each knowledge base, which the driver holds. Rows need a kb_id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, path)

    def folders(self, number: int | None = None) -> dict[str, str]:
        """The folder of each knowledge base in a version, or in the newest."""
        content = self.versions.newest()[1] if number is None else self.versions.read(number)
        return dict(content.get("folders", {}))

    def read(self, kb_ids: list[int] | None = None, number: int | None = None) -> DataFrame | None:
        """The rows of a version, or of the newest, of all or of some knowledge bases. None before the first version."""
        content = self.versions.newest()[1] if number is None else self.versions.read(number)
        return self._rows(content, kb_ids) if content else None

    def _rows(self, content: dict, kb_ids: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(content["schema"])
        held = content["folders"]
        names = [f for k, f in held.items() if kb_ids is None or int(k) in set(kb_ids)]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in names)) if names else self.spark.createDataFrame([], schema)

    def _write(self, based_on: int, df: DataFrame, kb_ids: list[int], clear: bool = False) -> int:
        """Commit df as the rows of kb_ids, which are all that it has; clear: no other knowledge base stays."""
        name = uuid.uuid4().hex
        rows = df.withColumn("kb__", F.col("kb_id")).hint("rebalance", "kb__")  # whole files for small ones, several for large ones
        rows.write.partitionBy("kb__").option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        made = {n[5:]: f"{name}/{n}" for n in self.versions.names(f"data/{name}") if n.startswith("kb__=") and n[5:].lstrip("-").isdigit()}

        def edit(base: dict, newest: dict) -> dict:
            mine = {str(k) for k in kb_ids} | made.keys() | (newest.get("folders", {}).keys() if clear else set())
            if any(base.get("folders", {}).get(k) != newest.get("folders", {}).get(k) for k in mine):
                raise Conflict("another writer has changed a knowledge base of this one")
            rest = {k: v for k, v in newest.get("folders", {}).items() if k not in mine}
            return {"schema": df.schema.jsonValue(), "folders": rest | made}

        return self.versions.change(based_on, edit)

    def write(self, df: DataFrame) -> int:
        """Replace all rows."""
        return self._write(self.versions.newest()[0], df, [], clear=True)

    def upsert(self, new: DataFrame, key: str = "id") -> int:
        """Put new in place of the rows with the same keys. A key belongs to one knowledge base."""
        number, content = self.versions.newest()
        if not content:
            return self._write(number, new, [])
        touched = _kb_ids(new)
        return self._write(number, upserted(self._rows(content, touched).select(*new.columns), new, key), touched)

    def apply(self, current: DataFrame, files: DataFrame) -> tuple[int, int]:
        """Bring the processed files to their current chunks; how many chunks were added and deleted. Knowledge bases in which
        nothing changes keep their folders."""
        number, content = self.versions.newest()
        if not content:
            self._write(number, current, [])
            return self.read().count(), 0
        old = self._rows(content, _kb_ids(files.select("kb_id").unionByName(current.select("kb_id")))).select(*current.columns)
        added, gone = new_chunks(current, old), deleted_chunks(current, old, files)
        flagged = added.select("kb_id", F.lit(1).alias("a"), F.lit(0).alias("g")).unionByName(gone.select("kb_id", F.lit(0).alias("a"), F.lit(1).alias("g")))
        counts = flagged.groupBy("kb_id").agg(F.sum("a"), F.sum("g")).collect()
        if counts:
            touched = [r[0] for r in counts]
            old, new = self._rows(content, touched).select(*current.columns), current.filter(F.col("kb_id").isin(touched))
            kept = without(old, deleted_chunks(new, old, files.filter(F.col("kb_id").isin(touched))), "id")
            self._write(number, upserted(kept, new_chunks(new, old)), touched)
        return sum(r[1] for r in counts), sum(r[2] for r in counts)

    def delete_kb(self, kb_id: int) -> None:
        """Take a knowledge base out of the manifest; no data is read or written."""
        number, content = self.versions.newest()
        if str(kb_id) not in content.get("folders", {}):
            return

        def edit(base: dict, newest: dict) -> dict:
            if base["folders"].get(str(kb_id)) != newest["folders"].get(str(kb_id)):
                raise Conflict("another writer has changed this knowledge base")
            return newest | {"folders": {k: v for k, v in newest["folders"].items() if k != str(kb_id)}}

        self.versions.change(number, edit)

    def compact(self, files: int = 8) -> list[int]:
        """Rewrite the knowledge bases that have more than so many files; returns which."""
        number, content = self.versions.newest()
        many = [int(k) for k, f in content.get("folders", {}).items() if sum(n.endswith(".parquet") for n in self.versions.names(f"data/{f}")) > files]
        if many:
            self._write(number, self._rows(content, many), many)
        return many

    def vacuum(self, versions: int = 1) -> None:
        """Remove all but the newest versions, and data of none of them. No writer may be at work."""
        numbers = sorted(self.versions.numbers())
        for n in numbers[:-versions]:
            self.versions.remove(f"versions/{n:010d}.json")
        used = {f for n in numbers[-versions:] for f in self.folders(n).values()}
        for write in self.versions.names("data"):
            for folder in self.versions.names(f"data/{write}"):
                if folder.startswith("kb__=") and f"{write}/{folder}" not in used:
                    self.versions.remove(f"data/{write}/{folder}")
            if not any(f.startswith(f"{write}/") for f in used):
                self.versions.remove(f"data/{write}")


def _kb_ids(df: DataFrame) -> list[int]:
    """The knowledge bases of a batch: as many as the manifest gets entries for."""
    return [r[0] for r in df.select("kb_id").distinct().collect() if r[0] is not None]

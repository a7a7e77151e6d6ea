"""Files as a data source's sink: a write makes all of its files visible, or none.

Tasks write below a pending folder under names of their own. Only when all have ended, the driver notes the moves in one file
and renames; what a failed or repeated task has left goes with the pending folder. If the driver ends amid the renames, recover()
finishes them by the note; if it ends before, recover() removes what is pending."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "lodestone_files"
_PENDING = ".pending-"


def _store(base: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, by its URI or as a local path that all machines share, and the folder in it."""
    where, path = fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (fs.LocalFileSystem(), base)
    return where, path.rstrip("/")


def checked(name: str | None) -> str:
    """A file's name below the sink's folder."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts) or parts[0].startswith(_PENDING):
        raise ValueError(f"no name of a file: {name!r}")
    return name


@dataclass
class Moves(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, base: str):
        self.base, self.pending = base, f"{_PENDING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[T.Row]) -> Moves:
        where, base = _store(self.base)
        own, moves = f"{self.pending}/{uuid.uuid4().hex}", []
        where.create_dir(f"{base}/{own}")
        for n, row in enumerate(iterator):
            with where.open_output_stream(f"{base}/{own}/{n}") as out:
                out.write(bytes(row.content or b""))
            moves.append((f"{own}/{n}", checked(row.path)))
        return Moves(moves)

    def commit(self, messages: list[Moves | None]) -> None:
        moves = [m for got in messages if got for m in got.moves]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows have one path")
        where, base = _store(self.base)
        with where.open_output_stream(f"{base}/{self.pending}/note") as out:
            out.write(json.dumps(moves).encode())
        where.move(f"{base}/{self.pending}/note", f"{base}/{self.pending}/moves.json")
        _finish(where, base, self.pending)

    def abort(self, messages: list[Moves | None]) -> None:
        where, base = _store(self.base)
        if where.get_file_info(f"{base}/{self.pending}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/{self.pending}")


def _finish(where: fs.FileSystem, base: str, pending: str) -> None:
    """Do the moves that a note holds, those that are done left out, and remove what is pending."""
    with where.open_input_stream(f"{base}/{pending}/moves.json") as note:
        moves = json.loads(note.read())
    for temp, to in moves:
        if where.get_file_info(f"{base}/{temp}").type == fs.FileType.File:
            if "/" in to:
                where.create_dir(f"{base}/{to.rpartition('/')[0]}")
            where.move(f"{base}/{temp}", f"{base}/{to}")
    where.delete_dir(f"{base}/{pending}")


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_files(df: DataFrame, base: str, path: str = "path", content: str = "content") -> None:
    """Write each row's content to the file that path names below base, in place of one of that name. Two rows of one path
    fail, as does a name that leads out of base. The driver holds the names of all files."""
    df.sparkSession.dataSource.register(Files)
    df.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).write.format(NAME).option("path", base).mode("append").save()


def recover(base: str) -> list[str]:
    """Finish or remove what ended writers have left; returns the pending folders. No writer may be at work."""
    where, root = _store(base)
    if where.get_file_info(root).type != fs.FileType.Directory:
        return []
    left = [i.base_name for i in where.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(_PENDING)]
    for pending in left:
        if where.get_file_info(f"{root}/{pending}/moves.json").type == fs.FileType.File:
            _finish(where, root, pending)
        else:
            where.delete_dir(f"{root}/{pending}")
    return left

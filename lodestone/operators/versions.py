"""Numbered manifests in a folder: what a stored table consists of, changed by one atomic step.

A manifest is a small JSON file. The newest number counts; a commit writes a file under another name and renames it to the
next number, which fails if that exists. So readers see a whole version or the one before, a writer that dies leaves
nothing that is read, and of two writers who began from one version the second learns of the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has changed the same part since."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self.at(self.path).getFileSystem(self._conf())

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        """What a folder below path holds."""
        where = self.at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(f"{self.path}/{name}"), True)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def read(self, number: int) -> dict:
        stream = self._fs.open(self.at(f"{self.path}/versions/{number:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """The newest version's number and content: -1 and an empty one before the first."""
        numbers = self.numbers()
        return (max(numbers), self.read(max(numbers))) if numbers else (-1, {})

    def commit(self, number: int, content: dict) -> None:
        """Make content version `number`, or raise Conflict where there is one."""
        own = self.at(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(own, True)
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        options = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        target = self._fs.makeQualified(self.at(f"{self.path}/versions/{number:010d}.json"))
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf()).rename(self._fs.makeQualified(own), target, options)
        except (Py4JJavaError, PySparkException) as e:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e) or self._fs.exists(target):
                raise Conflict(f"version {number} exists") from e
            raise

    def change(self, based_on: int, edit: Callable[[dict, dict], dict], tries: int = 20) -> int:
        """Commit edit(base, newest) behind the newest version, again if others commit meanwhile; returns its number. edit raises
        Conflict where what it would replace differs between the version that the work was based on and the newest one."""
        base = self.read(based_on) if based_on >= 0 else {}
        for _ in range(tries):
            number, newest = self.newest()
            try:
                content = edit(base, newest)
                self.commit(number + 1, content)
                return number + 1
            except Conflict:
                if self.newest()[0] == number:  # not a lost race, but edit's own
                    raise
        raise Conflict(f"no commit in {tries} tries")

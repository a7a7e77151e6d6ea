"""Tables of a relational database as a data source: partitions by ranges of a key, filters that run in the database, and a
stream of the rows that were changed.

Any DB-API module that the executors have can connect: option `module` names it (sqlite3 by default), `connect` is what its
connect() gets. Values reach the database as parameters; names of tables and columns are quoted."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not

NAME = "lodestone_relational"
#: Rows that are fetched from the database at once.
FETCH = 10_000
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def where(f: Filter) -> tuple[str, list] | None:
    """A filter as a condition with parameters, or None if it stays with Spark."""
    if isinstance(f, Not):
        inner = where(f.child)
        return (f"NOT ({inner[0]})", inner[1]) if inner else None
    attribute = getattr(f, "attribute", ())
    if len(attribute) != 1:
        return None
    column = quoted(attribute[0])
    if isinstance(f, IsNull | IsNotNull):
        return f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
    if not values or not all(isinstance(v, int | str | float) and not isinstance(v, bool) for v in values):
        return None
    if isinstance(f, In):
        return f"{column} IN ({', '.join('?' * len(values))})", values
    return (f"{column} {_COMPARED[type(f)]} ?", values) if type(f) in _COMPARED else None


@dataclass
class Part(InputPartition):
    conditions: list[str]
    values: list

    def __init__(self, conditions: list[str], values: list):
        self.conditions, self.values = conditions, values


class _Table:
    """What both readers do: connect, ask, and fetch in pieces."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields]
        self.table, self.module, self.target = options["table"], options.get("module", "sqlite3"), options["connect"]
        self.key, self.parts = options.get("key"), int(options.get("partitions", "1"))

    def ask(self, select: str, conditions: list[str], values: list) -> Iterator[tuple]:
        connection = importlib.import_module(self.module).connect(self.target)
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT {select} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(f'({c})' for c in conditions)}" if conditions else ""), values)
            while rows := cursor.fetchmany(FETCH):
                yield from rows
        finally:
            connection.close()

    def ranges(self, conditions: list[str], values: list) -> list[Part]:
        """Parts of about equal width in an integer key, null keys with the first; one part without a key or a row."""
        if not self.key or self.parts < 2:
            return [Part(conditions, values)]
        key = quoted(self.key)
        low, high = next(self.ask(f"min({key}), max({key})", conditions, values))
        if low is None:
            return [Part(conditions, values)]
        step = max(1, -(-(high - low + 1) // self.parts))
        out = [Part([*conditions, f"{key} >= ? AND {key} < ?"], [*values, a, a + step]) for a in range(low, high + 1, step)]
        return [Part([*conditions, f"{key} IS NULL"], values), *out]

    def rows(self, part: Part) -> Iterator[tuple]:
        return self.ask(", ".join(map(quoted, self.columns)), part.conditions, part.values)


class _Reader(DataSourceReader, _Table):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        _Table.__init__(self, schema, options)
        self.pushed: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if found := where(f):
                self.pushed.append(found)
            else:
                yield f

    def partitions(self) -> list[Part]:
        return self.ranges([c for c, _ in self.pushed], [v for _, values in self.pushed for v in values])

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.rows(partition)


class _Changes(DataSourceStreamReader, _Table):
    """Rows whose `changed` column is beyond what was read. Rows that get the newest value later than a batch was
    planned would be missed, so a batch ends before the newest value unless `settled` says that it won't come again."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        _Table.__init__(self, schema, options)
        self.changed, self.settled, self.start = quoted(options["changed"]), options.get("settled", "false") == "true", options.get("since")

    def initialOffset(self) -> dict:
        return {"at": self.start}

    def latestOffset(self) -> dict:
        newest = next(self.ask(f"max({self.changed})", [], []))[0]
        if newest is not None and not self.settled:
            newest = next(self.ask(f"max({self.changed})", [f"{self.changed} < ?"], [newest]))[0]
        return {"at": self.start if newest is None else newest}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if end["at"] is None or end == start:
            return []
        after = ([f"{self.changed} > ?"], [start["at"]]) if start["at"] is not None else ([], [])
        return self.ranges([*after[0], f"{self.changed} <= ?"], [*after[1], end["at"]])

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Relational(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Changes(schema, self.options)


def _ready(spark: SparkSession) -> None:
    spark.dataSource.register(Relational)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_table(spark: SparkSession, connect: str, table: str, schema: str, key: str | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table; with an integer key read by so many tasks, each a range of it. Comparisons of a column with a number or a
    string, IN and null tests of a filter behind it run in the database."""
    _ready(spark)
    reader = spark.read.format(NAME).schema(schema).options(connect=connect, table=table, partitions=str(partitions), **options)
    return (reader.option("key", key) if key else reader).load()


def read_changes(spark: SparkSession, connect: str, table: str, schema: str, changed: str, key: str | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A stream of a table's rows as their column `changed` (text or a number that only grows) goes on, each version once."""
    _ready(spark)
    reader = spark.readStream.format(NAME).schema(schema).options(connect=connect, table=table, changed=changed, partitions=str(partitions), **options)
    return (reader.option("key", key) if key else reader).load()

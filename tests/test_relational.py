"""The relational source over an SQLite file."""

import sqlite3

import pytest
from pyspark.sql.datasource import EqualTo, In, IsNull, LessThan, Not, StringContains

from lodestone.sources import relational as R

SCHEMA = "id long, name string, size double, updated_at string"


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "data.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "up loads" (id INTEGER, name TEXT, size REAL, updated_at TEXT)')
        rows = [(i, f"n{i % 7}", i / 2, f"2024-01-{1 + i // 10:02d}") for i in range(100)] + [(None, "none", None, "2024-01-05"), (5000, "it's", 1.0, "2024-01-05")]
        c.executemany('INSERT INTO "up loads" VALUES (?, ?, ?, ?)', rows)
    return path


def table(spark, database, **how):
    return R.read_table(spark, database, "up loads", SCHEMA, **how)


def test_all_rows_by_ranges_of_the_key(spark, database):
    df = table(spark, database, key="id", partitions=4)
    assert df.rdd.getNumPartitions() >= 2 and df.count() == 102
    assert sorted(r.id for r in df.collect() if r.id is not None) == [*range(100), 5000]
    assert table(spark, database).count() == 102


def test_filters_run_in_the_database(spark, database, monkeypatch):
    reader = R._Reader(table(spark, database).schema, {"table": "up loads", "connect": database, "key": "id", "partitions": "3"})
    rest = list(reader.pushFilters([EqualTo(("name",), "n1"), LessThan(("id",), 50), Not(IsNull(("size",))), In(("id",), (1, 8, 15, 99)), StringContains(("name",), "n")]))
    assert [type(f) for f in rest] == [StringContains]
    parts = reader.partitions()
    assert all('"name" = ?' in p.conditions and p.values[:2] == ["n1", 50] for p in parts)
    assert sorted(r[0] for p in parts for r in reader.read(p)) == [1, 8, 15]
    df = table(spark, database, key="id", partitions=3).filter("name = 'it''s' OR id < 3").filter("id IS NOT NULL AND name IN ('n1', 'it''s')")
    assert sorted(r.id for r in df.collect()) == [1, 5000]
    asked = table(spark, database).filter("id = 8 AND name LIKE 'n%'")
    assert [r.name for r in asked.collect()] == ["n1"]
    left = [x for x in asked._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in x]
    assert not any("= 8" in x for x in left)  # Spark has nothing more to do for it


def test_changes_are_read_once(spark, database, tmp_path):
    def run():
        stream = R.read_changes(spark, database, "up loads", SCHEMA, "updated_at", key="id", partitions=2)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()

    first = run()
    assert {r.updated_at for r in first} == {f"2024-01-{d:02d}" for d in range(1, 10)} and len(first) == 92  # the newest day may go on
    with sqlite3.connect(database) as c:
        c.execute("UPDATE \"up loads\" SET updated_at = '2024-02-01' WHERE id = 3")
    second = run()
    assert len(second) == 102 and len([r for r in second if r.updated_at == "2024-01-10"]) == 10
    with sqlite3.connect(database) as c:
        c.execute("INSERT INTO \"up loads\" VALUES (7000, 'new', 1, '2024-02-02')")
    third = run()
    assert len(third) == 103 and [r.id for r in third if r.updated_at >= "2024-02"] == [3]

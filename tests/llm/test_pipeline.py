import os
import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import queries


def test_queries_and_stages_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram-jaccard-join", "mixing-sources", "sentencepiece"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    df = queries.QUERIES[name](spark, data)
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_stages_keep_columns_and_do_their_work(spark, data, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()
    shutil.copy(f"{data}/labels.parquet", folder)
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("size", F.lit("extra")).withColumn("toxicity__x", F.lit(1))
    for name in ("id__", "h__", "h3__", "same__", "copies__", "src__", "toxicity__", "score", "row", "h", "copies", "a.b"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    copies = docs.filter("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 10_000)
    docs.unionByName(copies).write.parquet(str(folder / "documents.parquet"))
    got, before = spark.read.parquet(str(folder / "documents.parquet")), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, got = got, stage(spark, got, str(folder))
        assert got.columns == before.columns, name
        assert got.select("id__", "h__", "toxicity__", "row", "copies").distinct().collect() == [("own id__", "own h__", "own toxicity__", "own row", "own copies")]
        if name == "ngram-jaccard-join":
            assert got.filter("doc_id >= 10000").count() == 0
            assert got.groupBy("doc_id").count().filter("count > 1").count() == 0
        got.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
    sizes = spark.read.parquet(str(tmp_path / "ngram-jaccard-join")).agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).head()[0]
    mixed = got.agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).head()[0]
    assert mixed == pytest.approx(1.5 * sizes, rel=0.1)
    last = corpus_pipeline.STAGES[-1][1](spark, got, str(folder))
    assert last.count() == got.count() and last.columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_stages_take_nulls_repeated_rows_and_empty_tables(spark, tmp_path):
    """Rows that share an id but no text are all kept by the join; null and empty texts pass; nothing gives nothing."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a"), (1, text, "a"), (1, text[::-1], None), (2, text + " more", "a"), (None, text, "b"), (3, None, "b"), (4, "", None), (4, "", None), (5, "x " * 300_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == len(rows)
    kept = sorted((r.doc_id or 0, (r.text or "")[:6]) for r in stages["ngram-jaccard-join"](spark, docs, str(tmp_path)).collect())
    assert kept == sorted([(1, "w0 w1 "), (1, text[::-1][:6]), (0, "w0 w1 "), (3, ""), (4, ""), (4, ""), (5, "x x x ")])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert stages["mixing-sources"](spark, docs, str(tmp_path)).columns == docs.columns
    assert stages["sentencepiece"](spark, docs, str(tmp_path)).count() == len(rows)

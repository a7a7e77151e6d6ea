"""The standard tables as the data model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational database."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()


def kb_of(source: str = "source"):
    return F.substr(F.col(source), F.lit(4)).try_cast("int")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kb_id, item_id, hash, text): documents as items of search."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(kb_of().alias("kb_id"), F.col("doc_id").alias("item_id"), content_hash(F.col("text")).alias("hash"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("id"), kb_of().alias("knowledge_base_id"), name.alias("file_name"), F.octet_length("text").cast("long").alias("file_size"), content_hash(F.col("text")).alias("file_hash"), "text")


def knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = table(spark, sf_dir, "documents").select("source").distinct().select(kb_of().alias("id"), F.col("source").alias("name"))
    return kb.withColumn("user_id", F.col("id") % 4)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kb_id, item_id, hash, vector) of the documents that have one."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return items(spark, sf_dir).drop("text").join(v, "item_id")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, vector): benchmark items, with the embedding of the same id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(v, "query_id", "left")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return conv.select(F.col("conv_id").alias("id"), F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title"), (F.col("conv_id") % 4).alias("user_id"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), "role", F.col("text").alias("content"))


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, task_id, kb_id, ts, status): the events as an append-only log of task states."""
    ev = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "processing").otherwise("pending")
    return ev.select("event_id", F.col("user_id").alias("task_id"), (F.col("user_id") % 20).alias("kb_id"), "ts", status.alias("status"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("knowledge_base_id"), F.concat(F.lit("up_"), F.col("event_id").cast("string")).alias("file_name"), F.col("ts").alias("created_at"), F.lit("pending").alias("status"))

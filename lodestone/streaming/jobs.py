"""Continuous ingestion of files, and running task states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.config import Settings
from lodestone.operators.chunking import chunk_recursive, with_ids
from lodestone.operators.incremental import ChunkStore


def ingest(spark: SparkSession, path: str, store: ChunkStore, checkpoint: str, kb_id: int | Column, settings: Settings | None = None, available_now: bool = True, max_files: int = 1000) -> StreamingQuery:
    """Chunk the text files that appear under path and bring the store up to date: a file that comes again
    replaces its changed chunks. A batch that is repeated after a failure changes nothing more."""
    s = settings or Settings()
    files = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).text(path)
    kb = F.lit(kb_id).cast("int") if isinstance(kb_id, int) else kb_id
    named = files.select(kb.alias("kb_id"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), F.col("_metadata.file_modification_time").alias("at"), F.col("value").alias("text"))

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        newest = batch.groupBy("kb_id", "file_name").agg(F.max_by("text", F.struct("at", "text")).alias("text"))
        store.apply(with_ids(chunk_recursive(newest, size=s.chunk_size, overlap=s.chunk_overlap)), newest)
        batch.unpersist()

    writer = named.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def task_states(events: DataFrame) -> DataFrame:
    """(task_id, status, events) of a stream of (event_id, task_id, ts, status), for the update or complete mode."""
    return events.groupBy("task_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


def upload_rates(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Uploads for each window of event time; what comes later than the watermark is left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width)).agg(F.count("*").alias("uploads"))

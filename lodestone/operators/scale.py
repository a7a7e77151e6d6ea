"""Joins whose plan depends on the size of a side, and tables that cut a plan's lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import BROADCAST_ROWS


def bounded(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df of narrow rows, marked for broadcast if a known bound of its rows is within the limit; nothing is counted."""
    return F.broadcast(df) if rows is not None and rows <= limit else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: `spark.checkpoint.dir` of the session. Where it is unset, a
    local session gets a folder under /tmp; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "/tmp/checkpoints/lodestone"
    return f"{path.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: nothing stays in memory, and no second use computes it anew."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

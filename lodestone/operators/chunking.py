"""Splitting texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodestone.functions.text import chunk_id, content_hash

SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursive(text: str | None, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that allows it.

    A text is cut at the first separator that it holds; pieces still too long are cut at the next ones. Pieces
    are then packed greedily, and a chunk begins with as many whole pieces of the one before as fit into overlap.
    Every chunk is stripped and not empty, chunks follow the text, and every character but white space is in one.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    def pieces(part: str, level: int) -> Iterator[str]:
        while level < len(separators) - 1 and separators[level] not in part:
            level += 1
        sep = separators[level]
        if not sep:  # cells of at most the overlap, so that neighbours can share them
            cell = max(1, min(size - overlap, overlap or size))
            yield from (part[i : i + cell] for i in range(0, len(part), cell))
            return
        for i, p in enumerate(part.split(sep)):
            p = sep + p if i else p  # a separator stays with what follows it
            if len(p) <= size:
                yield p
            else:
                yield from pieces(p, level + 1)

    if not text or not text.strip():
        return []
    if len(text) <= size:
        return [text.strip()]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for p in pieces(text, 0):
        if held and length + len(p) > size:
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    out.append("".join(held).strip())
    return [c for c in out if c]


def chunk_recursive(docs: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row for each chunk: docs' other columns, chunk_index and chunk_text. Batches go to Python by Arrow."""
    keep = [c for c in docs.columns if c not in (text, "chunk_index", "chunk_text")]
    source = docs.select(text, *keep)
    schema = source.select(*keep).schema.add("chunk_index", "integer", False).add("chunk_text", "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                row, index, chunk = [], [], []
                for i, t in enumerate(part.column(0).to_pylist()):
                    got = split_recursive(t, size, overlap)
                    row += [i] * len(got)
                    index += range(len(got))
                    chunk += got
                kept = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.array(index, pa.int32()), pa.array(chunk, pa.string())], names=[*keep, "chunk_index", "chunk_text"])

    return source.mapInArrow(run, schema)


class _Split:
    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_recursive(text, size, overlap))


def register_splitter(spark: SparkSession, name: str = "split_text") -> None:
    """Make the recursive splitter a table function of the session's SQL: name(text, size, overlap) gives
    (chunk_index, chunk_text) rows, for LATERAL joins with any table."""
    spark.udtf.register(name, udtf(_Split, returnType="chunk_index int, chunk_text string", useArrow=True))


def preview(requests: DataFrame, documents: DataFrame, uploads: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, file_name, chunk_index, chunk_text) of the requested ids: the chunks that a document would have, or else the upload
    of that id; neither ids nor a store. documents and uploads are (id, file_name, text); ids of neither give nothing."""
    spark = requests.sparkSession
    register_splitter(spark)
    asked = requests.select("id").distinct()
    found = asked.join(documents.select("id", "file_name", "text"), "id")
    rest = asked.join(documents.select("id"), "id", "left_anti").join(uploads.select("id", "file_name", "text"), "id")
    sql = "SELECT s.id, s.file_name, c.chunk_index, c.chunk_text FROM {sources} s, LATERAL split_text(s.text, {size}, {overlap}) c"
    return spark.sql(sql, sources=found.unionByName(rest), size=int(size), overlap=int(overlap))


def chunk_fixed(docs: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of size characters that begin every size - overlap characters, while they hold new text."""
    stride, n = size - overlap, F.coalesce(F.length(text), F.lit(0))
    last = F.when(n == 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.ceil((n - overlap) / stride).cast("int") - 1))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    keep = [c for c in docs.columns if c not in (text, "chunk_index", "chunk_text")]
    rows = docs.select(*keep, text, F.explode(starts).alias("chunk_index"))
    return rows.select(*keep, "chunk_index", F.substr(F.col(text), F.col("chunk_index") * stride + 1, F.lit(size)).alias("chunk_text"))


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks (kb_id, file_name, chunk_index, chunk_text) with content-addressed ids, one row for each id: the
    first chunk_index and the number of equal chunks in the file."""
    rows = chunks.withColumn("id", chunk_id(F.col("kb_id"), F.col("file_name"), F.col("chunk_text"))).withColumn("hash", content_hash(F.col("chunk_text")))
    first = [F.min_by(c, "chunk_index").alias(c) for c in rows.columns if c not in ("id", "chunk_index")]
    return rows.groupBy("id").agg(*first, F.min("chunk_index").alias("chunk_index"), F.count("*").alias("dup_count"))

"""Vector points: encoders behind small interfaces, and the points' ids and payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens, uuid5_oid

#: Makes an encoder on a worker; the encoder turns texts into vectors of one dimension, in order.
DenseEncoder = Callable[[], Callable[[list[str]], list[list[float]]]]
#: Keys that the payload has as columns of its own.
OWN_KEYS = ("kb_id", "document_id", "chunk_id", "file_name")


def encode_dense(chunks: DataFrame, make: DenseEncoder, text: str = "chunk_text", into: str = "dense", batch: int = 32, dimension: int | None = None) -> DataFrame:
    """chunks with a vector for each row. A worker makes its encoder once and calls it with batch texts at a
    time; vectors stay with their rows, so nothing is joined by position."""
    keep = [c for c in chunks.columns if c != into]
    source = chunks.select(*keep)
    schema, at = source.select("*", F.array().cast("array<float>").alias(into)).schema, keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for b in batches:
            texts, out = [t or "" for t in b.column(at).to_pylist()], []
            for i in range(0, len(texts), batch):
                out += encode(texts[i : i + batch])
            if len(out) != len(texts) or any(len(v) != (dimension or len(out[0])) for v in out):
                raise ValueError("an encoder must give one vector of the expected dimension for each text")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*keep, into])

    return source.mapInArrow(run, schema)


def unit(vector: Column) -> Column:
    """A vector scaled to unit length, so that an inner product is the cosine; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: (x / F.when(norm > 0, norm).otherwise(F.lit(1.0))).cast("float"))


def lexical_sparse(text: Column) -> Column:
    """A map from terms to ln(1 + tf), scaled to unit length: a stand-in for a learned sparse encoder."""
    t = tokens(text)
    counts = F.map_from_entries(F.transform(F.array_distinct(t), lambda x: F.struct(x, F.ln(1 + F.size(F.filter(t, lambda y: y == x))))))
    norm = F.sqrt(F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, x: a + x * x))
    return F.transform_values(counts, lambda k, v: v / norm)


def source_metadata(metadata: Column) -> Column:
    """A chunk's metadata without the keys that are columns."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(*OWN_KEYS))


def payload(own: Column, metadata: Column) -> Column:
    """A point's payload: metadata comes last and may replace a key of the point."""
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(metadata), k)), metadata)


def points(chunks: DataFrame) -> DataFrame:
    """(point_id, kb_id, dense, sparse, payload) of chunks (id, kb_id, document_id, file_name, chunk_index,
    chunk_text, metadata, dense, sparse)."""
    own = F.create_map(*[x for c in ("chunk_text", "kb_id", "document_id", "file_name", "chunk_index") for x in (F.lit(c), F.col(c).cast("string"))])
    return chunks.select(uuid5_oid(F.col("id")).alias("point_id"), "kb_id", "dense", "sparse", payload(own, F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("payload"))

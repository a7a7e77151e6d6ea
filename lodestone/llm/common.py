"""Shared pieces of the training-data operators: vectorised word splitting and hashing over UTF-8
buffers, staging in the cluster's shared folder, joins that survive hot keys, connected components.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 19

_M = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20240611).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Where it is
    unset, a local session (as in tests) gets a folder under /tmp; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "/tmp/checkpoints/lodestone"
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, and neither a
    lost executor nor a second use of the result computes it anew."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slim() -> None:
    """Give freed memory back to the system: a worker is kept between tasks, and the next ones may need little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slim(run: Callable) -> Callable:
    """A function over batches that leaves its worker slim when it has ended."""

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _slim()

    return over_batches


def slim_group(run: Callable[..., pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def over_group(t: pa.Table) -> pa.Table:
        out = run(t)
        _slim()
        return out

    return over_group


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a string column with about limit bytes each;
    nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        if n > 2 * CHUNK_BYTES:  # powers for a longer text aren't kept
            return out
        _powers[base] = have = out
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in data, and offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = word[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = word[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased if lower), and offsets of each text's words."""
    starts, ends, at = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_P, len(data)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _power(_P_INV, len(data))[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * _M(0xD6E8FEB86659FD93)), at


def heavy_keys(df: DataFrame, key: str, share: int = 256) -> list:
    """Keys that hold more than 1/share of df's rows: share - 1 at most."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n__"))
    total = df.count()
    return [r[0] for r in counts.filter(F.col("n__") > max(1, total // share)).collect()]


def join_heavy(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 256) -> DataFrame:
    """left ⋈ right on one key that is unique in right. Keys with more than 1/share of left's rows go
    through a broadcast of their rows of right (fewer than share rows); all others shuffle. Both sides
    should be staged, since they are read more than once."""
    hot = heavy_keys(left, key, share)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.filter(~F.coalesce(is_hot, F.lit(False))).join(right.filter(~is_hot), key, how)
    return left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how).unionByName(cold)


def join_checked(left: DataFrame, right: DataFrame, key: str, how: str = "inner", limit: int = 500_000) -> DataFrame:
    """left ⋈ right, right unique by key: right is broadcast if it has limit rows at most, else both
    sides shuffle. For narrow rows of right (a few numbers each)."""
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right.hint("merge"), key, how)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges: every vertex that isn't its component's smallest, and that smallest."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(ids))
    x, y = inv[: len(a)], inv[len(a) :]
    while len(x):  # hook larger roots onto smaller ones, then flatten
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        x, y = parent[x], parent[y]
        keep = x != y
        x, y = x[keep], y[keep]
    moved = parent != np.arange(len(ids))
    return ids[moved], ids[parent[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if got:
        a, b = local_forest(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (a long, b long): one row (id long, component long) for every
    vertex that isn't the smallest of its component.

    Each round hooks every vertex onto its smallest neighbour (an aggregate with map-side combine), follows
    the hooks to their roots, and contracts the edges, which at least halves the components that are still
    linked. Edges are first reduced to spanning forests within partitions. Hot vertices are joined by
    ``join_heavy``. Nothing is gathered on the driver but counts.
    """
    links = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(_contract, "a long, b long"), "edges")
    spark = edges.sparkSession
    known: DataFrame | None = None
    while links.head(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = staged(both.groupBy("a").agg(F.min("b").alias("b")).filter("b < a"), "hooks")  # a hooks onto b
        while True:  # to the roots: vertices without a hook
            step = up.select(F.col("a").alias("b"), F.col("b").alias("root"))
            new = staged(join_heavy(up, step, "b", "left").select("a", F.coalesce("root", "b").alias("b"), F.col("root").isNotNull().alias("moved")), "hooks")
            up, moved = new.select("a", "b"), new.filter("moved").head(1)
            if not moved:
                break
        roots = up.withColumnRenamed("b", "root")
        rest = staged(join_heavy(links, roots, "a", "left").select(F.coalesce("root", "a").alias("b2"), "b"), "links")
        rest = join_heavy(rest, roots.withColumnRenamed("a", "b"), "b", "left").select(F.col("b2").alias("a"), F.coalesce("root", "b").alias("b"))
        links = staged(rest.filter("a <> b").distinct().mapInArrow(_contract, "a long, b long"), "links")
        if known is None:
            known = roots
        else:
            moved = join_heavy(known.withColumnRenamed("root", "b"), roots.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("root"))
            known = staged(moved.unionByName(roots), "known")
    if known is None:
        return spark.createDataFrame([], "id long, component long")
    return known.select(F.col("a").alias("id"), F.col("root").alias("component"))

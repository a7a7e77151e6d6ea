"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

A table's key is made of several functions floor((a . x + b) / w) with normal a, of vectors of unit length, so
vectors at a small angle share a key with high probability in at least one of many tables. Vectors that share
a key (and a label) are compared by exact cosine. With the standard parameters a pair at cosine 0.98 shares a
key in one of the tables with probability 0.999 (0.98 ** L is never relied on: see ``recall``).

Equal vectors are one class, so copies are not compared with each other. Classes that share a key are
compared in blocks: a key with more classes than BLOCK is cut, and each pair of its blocks is one group. A
pair that meets in several tables counts in the first of them only, which both sides' keys tell; so links are
counted where they are found and pairs are never written out. A key whose vectors all share one key of an
earlier table has no new pair and isn't dealt at all, so a dense neighbourhood is compared once, not once for
each table. Only counts and, for components, spanning
forests leave a group.

Contract: null or zero vectors, vectors with a null or non-finite component and rows with a null label link
with nothing; each is returned as its own component. Vectors of different length don't link. A repeated
vec_id is a row of its own, linked like any other row; its component is still the smallest id. A row with a
null id links like any other; the component of rows that all have null ids is null, and so is kept of a row
whose id or component is null. An empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, join_checked, join_heavy, local_forest, mix64, staged

TABLES, FUNCTIONS, WIDTH = 24, 8, 1.0
#: Classes of one key that are compared in one task.
BLOCK = 2048


def recall(cosine: float, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH) -> float:
    """Probability that a pair at that cosine shares a key in a table (Datar et al., 2004)."""
    d = math.sqrt(max(0.0, 2 - 2 * cosine))
    if not d:
        return 1.0
    r = width / d
    p = 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return 1 - (1 - p**functions) ** tables


def _planes(dim: int, tables: int, functions: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    a, b = rng.standard_normal((dim, tables * functions)), rng.uniform(0, width, tables * functions)
    return a, b, rng.integers(1, 2**63, functions, dtype=np.uint64) | np.uint64(1)


def hash_keys(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, seed: int = 11) -> np.ndarray:
    """Keys of the rows of x (unit vectors): one column for each table."""
    a, b, odd = _planes(x.shape[1], tables, functions, width, seed)
    cell = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, functions)
    with np.errstate(over="ignore"):
        return mix64((cell * odd).sum(axis=2, dtype=np.uint64)).view(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.asarray(column.offsets)
    return np.asarray(column.values)[off[0] : off[-1]].reshape(-1, dim)


def _hashed(tables: int, functions: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = pc.list_value_length(b.column("v")).to_numpy()
            for dim in np.unique(lens).tolist():
                part = b.filter(pa.array(lens == dim))
                x = _matrix(part.column("v"), dim)
                unit = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square under- or overflows
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                keys = hash_keys(unit, tables, functions, width, seed)
                arrays = [part.column("cls"), part.column("size"), part.column("label"), *(pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel())) for m in (unit, keys))]
                yield pa.RecordBatch.from_arrays(arrays, names=["cls", "size", "label", "unit", "keys"])

    return run


def _compare(threshold: float):
    def run(g: pa.Table) -> pa.Table:
        table, two = g.column("t")[0].as_py(), g.column("i")[0].as_py() != g.column("j")[0].as_py()
        dims = pc.list_value_length(g.column("unit")).to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for dim in np.unique(dims).tolist():
            part = g.filter(pa.array(dims == dim))
            cls, size, own = part.column("cls").to_numpy(), part.column("size").to_numpy(), part.column("own").to_numpy()
            x, keys = _matrix(part.column("unit"), dim), _matrix(part.column("keys"), g.column("keys")[0].values.__len__())
            sides = [np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())] if two else [np.arange(len(cls))] * 2
            if two and own.min() == own.max():
                continue
            left, right = sides
            links = np.zeros(len(cls), np.int64)
            pa_, pb_ = [], []
            step = max(1, (1 << 20) // max(1, len(right)))
            for k in range(0, len(left), step):
                rows = left[k : k + step]
                r, c = np.nonzero(x[rows] @ x[right].T >= threshold)
                r, c = rows[r], right[c]
                if not two:
                    r, c = r[r < c], c[r < c]
                new = ~(keys[r, :table] == keys[c, :table]).any(axis=1) if table else np.ones(len(r), bool)
                r, c = r[new], c[new]
                np.add.at(links, r, size[c])
                np.add.at(links, c, size[r])
                pa_.append(cls[r])
                pb_.append(cls[c])
            a, b = local_forest(np.concatenate(pa_), np.concatenate(pb_))
            hit = np.flatnonzero(links)
            out[0] += [cls[hit], a]
            out[1] += [links[hit], np.zeros(len(a), np.int64)]
            out[2] += [cls[hit], b]
        names = ["cls", "links", "root"]
        return pa.table({n: np.concatenate(c) if c else pa.array([], pa.int64()) for n, c in zip(names, out, strict=True)})

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", threshold: float = 0.98, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of df: how many other rows it links with, the smallest
    key that links lead to, and whether that is its own."""
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    tag = F.col(label).cast("string") if label else F.lit("")
    v = F.when(F.coalesce(good & tag.isNotNull(), F.lit(False)), F.transform(x, lambda c: c + F.lit(0.0)))  # -0.0 and 0.0 are equal
    rows = staged(df.select(F.col(key).cast("long").alias("id"), tag.alias("label"), v.alias("v"), F.when(v.isNotNull(), F.md5(F.concat_ws(",", v.cast("array<string>")))).alias("h")), "vectors")
    sizes = rows.filter("v IS NOT NULL").groupBy("label", "h").agg(F.min("id").alias("cls"), F.count("*").alias("size"), F.first("v").alias("v"))
    # A class is known by a number of its own: ids may repeat.
    sizes = sizes.withColumn("low", F.col("cls")).withColumn("cls", F.xxhash64("label", "h"))
    hashed = "cls long, size long, label string, unit array<double>, keys array<long>"
    classes = staged(sizes, "vector-classes")
    keyed = staged(classes.select("cls", "size", "label", "v").mapInArrow(_hashed(tables, functions, width, seed), hashed), "vector-keys")
    slots = keyed.select("cls", F.posexplode("keys").alias("t", "k"), "label").select("cls", "t", F.xxhash64("t", "k", "label").alias("slot"))
    counts = slots.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = staged(counts.select("slot", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "slots")
    # Most classes are alone in a slot: the rows that meet others are few, and only those carry their vectors.
    met = staged(join_heavy(staged(slots, "vector-slots"), blocks, "slot"), "met")
    at = lambda f: F.array(*[f(F.get("keys", F.lit(i))) for i in range(tables)])
    shared = met.join(keyed.select("cls", "keys").hint("merge"), "cls").groupBy("slot").agg(F.min("t").alias("first"), at(F.min).alias("low"), at(F.max).alias("high"))
    old = F.exists(F.slice(F.zip_with("low", "high", lambda a, b: a == b), F.lit(1), F.col("first")), lambda same: same)
    met = join_heavy(met, staged(shared.filter(~old).select("slot"), "new-slots"), "slot", "left_semi")
    met = met.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cls", "t", "slot", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = met.join(keyed.select("cls", "size", "unit", "keys").hint("merge"), "cls").groupBy("slot", "i", "j").applyInArrow(_compare(threshold), "cls long, links long, root long")
    found = staged(found, "vector-links")
    roots = components(found.filter("links = 0").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    per = classes.select("cls", "size", "low", "label", "h").join(links.hint("merge"), "cls", "left").join(roots.withColumnRenamed("id", "cls").hint("merge"), "cls", "left")
    per = staged(per.select("label", "h", "size", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component")), "vector-components")
    lowest = per.groupBy("component").agg(F.min("low").alias("component_id"))
    per = staged(join_heavy(per, staged(lowest, "lowest"), "component").select(F.xxhash64("label", "h").alias("cls"), (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id"), "vector-results")
    linked = join_heavy(rows.filter("v IS NOT NULL").select("id", F.xxhash64("label", "h").alias("cls")), per, "cls").select("id", "n_links", "component_id")
    alone = rows.filter("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))

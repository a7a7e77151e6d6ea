"""An inverted-file index of vectors: lists around trained centres, residuals of one byte for each number, exact scores for
the best.

Centres are trained for each knowledge base on a sample of documented size; every vector goes to its nearest centre. A search
takes the lists of the nearest centres, scores their residual codes, and computes exact cosines for RERANK times as many
candidates as it returns; vectors themselves are read for those alone. So what a query reads of codes is bounded by its lists
and of vectors by its candidates. search.dense_leg stays the exact way; recall() measures one against the other.

Contract: vectors without a number, of zero length or with a non-finite number aren't indexed. All of one index have one
dimension; another one fails. Equal scores go by item_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators.search import dense_leg, ranked_by_kb, top

#: Vectors of a knowledge base that its centres are trained on, rounds of training, and vectors of a part of a list.
SAMPLE, ROUNDS, PART = 65_536, 8, 65_536
#: Candidates for each result that get an exact score.
RERANK = 4
_CENTRES = "kb_id int, list int, centre array<double>"
_ASSIGNED = "kb_id int, item_id long, hash string, v array<double>, list int, scale double, code binary"
_HIT = "query_id long, kb_id int, list int, part int, item_id long, score double"


def lists_of(n: Column) -> Column:
    """Lists of a knowledge base of n vectors: about the root of n."""
    return F.greatest(F.lit(1), F.least(F.lit(4096), F.ceil(F.sqrt(n)))).cast("int")


def unit(vector: Column) -> Column:
    """A vector as doubles at unit length; null if that can't be."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0)
    return F.when(fine, F.transform(v, lambda x: x / norm))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lens = np.unique(pc.list_value_length(column).to_numpy())
    if len(lens) > 1:
        raise ValueError("vectors differ in their dimension")
    return np.asarray(pc.list_flatten(column), np.float64).reshape(len(column), -1)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def train(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit length: every lists-th vector first, then means of what is nearest; an empty list keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def _centres(t: pa.Table) -> pa.Table:
    t = t.sort_by([("item_id", "ascending")])
    c = train(_matrix(t["v"]), t["lists"][0].as_py())
    return pa.table({"kb_id": pa.array([t["kb_id"][0].as_py()] * len(c), pa.int32()), "list": pa.array(np.arange(len(c)), pa.int32()), "centre": _vectors(c)})


def _assign(left: pa.Table, right: pa.Table) -> pa.Table:
    n = left.num_rows
    if not n:
        near, scale, codes = np.zeros(0, int), np.zeros(0), []
    else:
        right = right.sort_by([("list", "ascending")])
        x, c = _matrix(left["v"]), _matrix(right["centre"])
        if x.shape[1] != c.shape[1]:
            raise ValueError("vectors differ in their dimension")
        near = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, axis=1) for a in range(0, n, 4096)])
        rest = x - c[near]
        scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
        codes = [r.tobytes() for r in np.rint(rest / scale[:, None]).astype(np.int8)]
    return pa.table({"kb_id": left["kb_id"], "item_id": left["item_id"], "hash": left["hash"], "v": left["v"], "list": pa.array(near, pa.int32()), "scale": pa.array(scale, pa.float64()), "code": pa.array(codes, pa.binary())})


def _route(probes: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The nearest lists of each query of one knowledge base, and how near their centres are."""
        q, lists, near = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if left.num_rows and right.num_rows:
            right = right.sort_by([("list", "ascending")])
            x, c = _matrix(left["v"]), _matrix(right["centre"])
            if x.shape[1] != c.shape[1]:
                raise ValueError("a query's dimension differs from the vectors'")
            scores = x @ c.T
            k = min(probes, len(c))
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            q, lists, near = np.repeat(np.arange(len(x)), k), best.ravel(), np.take_along_axis(scores, best, 1).ravel()
        rows = left.take(pa.array(q, pa.int64()))
        return pa.table({"query_id": rows["query_id"], "kb_id": rows["kb_id"], "list": pa.array(lists, pa.int32()), "near": pa.array(near, pa.float64()), "v": rows["v"]})

    return run


def _scan(pool: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of a part of a list for each query, by the centre's score and the residual codes."""
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("item_id", "ascending")])
            raw = left["code"].combine_chunks()
            x, ids = _matrix(right["v"]), np.asarray(right["query_id"])
            codes = np.frombuffer(b"".join(raw.to_pylist()), np.int8).reshape(len(raw), x.shape[1])
            scale, near, items = np.asarray(left["scale"]), np.asarray(right["near"]), np.asarray(left["item_id"])
            for a in range(0, len(codes), 8192):
                part = slice(a, a + 8192)
                scores = near[:, None] + (x @ codes[part].astype(np.float64).T) * scale[part]
                k = min(pool, scores.shape[1])
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ties to the smaller id
                out.append((np.repeat(ids, k), items[part][best.ravel()], np.take_along_axis(scores, best, 1).ravel()))
        q, i, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        one = lambda c: pa.array([left[c][0].as_py() if len(q) else 0] * len(q), pa.int32())
        return pa.table({"query_id": pa.array(q, pa.int64()), "kb_id": one("kb_id"), "list": one("list"), "part": one("part"), "item_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


class VectorIndex:
    """An index stored under path: centres, and lists in folders of knowledge bases."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, path: str, vectors: DataFrame, sample: int = SAMPLE) -> VectorIndex:
        """Index vectors (kb_id, item_id, hash, vector), every one that can be. Centres of a knowledge base are trained on about
        sample of its vectors, chosen by a hash of their ids."""
        out = cls(vectors.sparkSession, path)
        own = vectors.select(F.col("kb_id").cast("int").alias("kb_id"), "item_id", "hash", unit(F.col("vector")).alias("v")).filter("v IS NOT NULL AND kb_id IS NOT NULL")
        sizes = own.groupBy("kb_id").agg(F.count("*").alias("n")).select("kb_id", "n", lists_of(F.col("n")).alias("lists"))
        chosen = own.join(sizes, "kb_id").filter(F.pmod(F.xxhash64("item_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / sample))) == 0)
        centres = chosen.select("kb_id", "item_id", "lists", "v").groupBy("kb_id").applyInArrow(_centres, _CENTRES)
        centres.write.parquet(f"{out.path}/centres")
        # Vectors in shards of bounded size meet their knowledge base's centres.
        shards = sizes.select("kb_id", F.ceil(F.col("n") / PART).alias("s"))
        left = own.join(shards, "kb_id").withColumn("shard", F.pmod(F.xxhash64("item_id"), F.col("s"))).drop("s")
        right = out.centres().join(shards, "kb_id").select(F.col("kb_id").alias("of_kb"), "list", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("of_shard"))
        rows = left.groupBy("kb_id", "shard").cogroup(right.groupBy("of_kb", "of_shard")).applyInArrow(_assign, _ASSIGNED)
        rows.write.parquet(f"{out.path}/assigned")
        rows = out.spark.read.schema(_ASSIGNED).parquet(f"{out.path}/assigned")
        parts = rows.groupBy("kb_id", "list").agg(F.ceil(F.count("*") / PART).alias("parts"))
        rows = rows.join(parts, ["kb_id", "list"]).withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")).drop("parts")
        rows.withColumn("kb", F.col("kb_id")).hint("rebalance", "kb").sortWithinPartitions("kb", "list").write.partitionBy("kb").parquet(f"{out.path}/lists")
        return out

    def centres(self) -> DataFrame:
        return self.spark.read.schema(_CENTRES).parquet(f"{self.path}/centres")

    def lists(self) -> DataFrame:
        return self.spark.read.schema(f"{_ASSIGNED}, part int, kb int").parquet(f"{self.path}/lists").drop("kb")

    def candidates(self, queries: DataFrame, scope: DataFrame, pool: int, probes: int) -> DataFrame:
        """(query_id, kb_id, list, part, item_id, score): at most pool of each query and knowledge base, by codes."""
        asked = queries.select("query_id", unit(F.col("vector")).alias("v")).filter("v IS NOT NULL").join(scope.select("query_id", "kb_id"), "query_id")
        routed = asked.groupBy("kb_id").cogroup(self.centres().withColumnRenamed("kb_id", "of_kb").groupBy("of_kb")).applyInArrow(_route(probes), "query_id long, kb_id int, list int, near double, v array<double>")
        codes = self.lists().select("kb_id", "list", "part", "item_id", "scale", "code")
        parts = codes.select("kb_id", "list", "part").distinct()
        right = routed.join(parts, ["kb_id", "list"]).select(F.col("kb_id").alias("of_kb"), F.col("list").alias("of_list"), F.col("part").alias("of_part"), "query_id", "near", "v")
        found = codes.groupBy("kb_id", "list", "part").cogroup(right.groupBy("of_kb", "of_list", "of_part")).applyInArrow(_scan(pool), _HIT)
        return top(found, ["query_id", "kb_id"], pool).drop("rank")

    def leg(self, queries: DataFrame, scope: DataFrame, s: Settings, probes: int = 16) -> DataFrame:
        """The dense leg by lists: (query_id, hash, item_id, kb_id, rank, score), scores being exact cosines."""
        found = self.candidates(queries, scope, s.pool * RERANK, probes).drop("score")
        asked = queries.select("query_id", unit(F.col("vector")).alias("q"))
        pairs = found.join(self.lists().select("kb_id", "list", "part", "item_id", "hash", "v"), ["kb_id", "list", "part", "item_id"]).join(asked, "query_id")
        cosine = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        hits = top(pairs.select("query_id", "kb_id", "item_id", "hash", F.round(cosine, 6).alias("score")), ["query_id", "kb_id"], s.pool).drop("rank")
        return ranked_by_kb(hits, scope, s.cross_kb)

    def recall(self, queries: DataFrame, scope: DataFrame, s: Settings, probes: int = 16) -> float:
        """The share of the exact leg's hits that the lists give, too."""
        vectors = self.lists().select("kb_id", "item_id", "hash", F.col("v").alias("vector"))
        exact = dense_leg(queries, vectors, scope, s).select("query_id", "hash")
        mine = self.leg(queries, scope, s, probes).select("query_id", "hash").withColumn("hit", F.lit(1))
        row = exact.join(mine, ["query_id", "hash"], "left").agg(F.count("*"), F.count("hit")).head()
        return row[1] / row[0] if row[0] else 1.0

"""Dense, sparse and exact legs of hybrid search, and their fusion by weighted reciprocal ranks.

All legs answer a batch of queries. Queries are (query_id, text, vector); their scope is a table (query_id, kb_id, kb_pos)
of the knowledge bases that each one searches, in order. Both text legs come from one pass over a stored index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.text import tokens
from lodestone.operators.index import EXACT, SEEN, SPARSE, TextIndex
from lodestone.operators.scale import shared_path, staged

#: Queries, and numbers in vectors, that a task of the dense leg holds at once.
QUERY_BLOCK, VECTOR_NUMBERS = 2048, 1 << 23
_LEG = "query_id long, kb_id int, item_id long, hash string, score double"


def postings(items: DataFrame, partitions: int | None = None) -> DataFrame:
    """(item_id, kb_id, term, tf) of (kb_id, item_id, text) items.

    Items are dealt by item_id first: the counts by (item, term) here and the scores by (item, query) of the
    legs then need no further shuffle. Only numbers are aggregated beside the keys, so all of it hashes."""
    dealt = items.repartition(partitions, "item_id") if partitions else items.repartition("item_id")
    rows = dealt.select("item_id", "kb_id", F.explode(tokens(F.col("text"))).alias("term"))
    return rows.groupBy("item_id", "kb_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def top(scored: DataFrame, keys: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The n best rows for each key with ranks from 0: by score, then item_id."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "item_id")
    return scored.withColumn(rank, F.row_number().over(order) - 1).filter(F.col(rank) < n)


def ranked_by_kb(hits: DataFrame, scope: DataFrame, cross_kb: str) -> DataFrame:
    """Consecutive ranks of a leg's hits, each text once: by the query's order of knowledge bases and then by
    score ("sequential"), or by score alone ("global")."""
    order = ["kb_pos", F.col("score").desc(), "item_id"] if cross_kb == "sequential" else [F.col("score").desc(), "item_id"]
    placed = hits.join(scope, ["query_id", "kb_id"])
    once = placed.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "hash").orderBy(*order))).filter("n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).select("query_id", "hash", "item_id", "kb_id", "rank", "score")


def exact_leg(hits: DataFrame, s: Settings) -> DataFrame:
    """Full-text hits over all of a query's knowledge bases, ranked over rows: copies of a text leave gaps. hits are those of
    TextIndex.text_hits. A query without a term finds nothing."""
    best = top(hits.filter(F.col("kind") == EXACT), ["query_id"], s.pool)
    return best.groupBy("query_id", "hash").agg(F.min("rank").alias("rank"), F.min_by("item_id", "rank").alias("item_id"), F.min_by("kb_id", "rank").alias("kb_id"), F.max("score").alias("score"))


def sparse_leg(hits: DataFrame, scope: DataFrame, s: Settings) -> DataFrame:
    """Hits by sparse vectors, the best for each query and knowledge base."""
    best = top(hits.filter(F.col("kind") == SPARSE), ["query_id", "kb_id"], s.pool)
    return ranked_by_kb(best.select("query_id", "kb_id", "item_id", "hash", "score"), scope, s.cross_kb)


def dense_leg(queries: DataFrame, vectors: DataFrame, scope: DataFrame, s: Settings) -> DataFrame:
    """Hits by cosine, the best for each query and knowledge base; vectors are (kb_id, item_id, hash, vector).

    Vectors are dealt to shards and queries to blocks of bounded size; a task multiplies one with the other and
    gives the best of its shard for each query and knowledge base."""
    asked = queries.select("query_id", "vector").filter("vector IS NOT NULL")
    asked = asked.join(scope.groupBy("query_id").agg(F.collect_list("kb_id").alias("kbs")), "query_id")
    usable = vectors.select("kb_id", "item_id", "hash", "vector").filter("vector IS NOT NULL")
    numbers = usable.agg(F.sum(F.size("vector").cast("long"))).head()[0] or 0
    blocks, shards = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-numbers // VECTOR_NUMBERS))
    shards = max(shards, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    dealt = lambda df, key, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = dealt(usable, "item_id", "s", shards, "b", blocks).groupBy("s", "b")
    right = dealt(asked, "query_id", "b", blocks, "s", shards).groupBy("s", "b")
    hits = top(left.cogroup(right).applyInArrow(_dense_scores(s.pool), _LEG), ["query_id", "kb_id"], s.pool).drop("rank")
    return ranked_by_kb(hits, scope, s.cross_kb)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column at unit length; all must have one dimension."""
    lens = np.unique(pc.list_value_length(column).to_numpy())
    if len(lens) > 1:
        raise ValueError("vectors differ in their dimension")
    x = np.asarray(pc.list_flatten(column), np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _dense_scores(pool: int):
    names = ["query_id", "kb_id", "item_id", "score"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        held: list[np.ndarray] = [np.zeros(0, np.int64)]  # rows of a
        if a.num_rows and b.num_rows:
            kb, item, x = a.column("kb_id").to_numpy(), a.column("item_id").to_numpy(), _units(a.column("vector"))
            ids, q = b.column("query_id").to_numpy(), _units(b.column("vector"))
            if x.shape[1] != q.shape[1]:
                raise ValueError("a vector's dimension differs from the queries'")
            asked: dict[int, list[int]] = {}
            for i, kbs in enumerate(b.column("kbs").to_pylist()):
                for k in set(kbs):
                    asked.setdefault(k, []).append(i)
            for k in np.unique(kb).tolist():
                here, rows = np.flatnonzero(kb == k), np.array(asked.get(k, []), int)
                here = here[np.argsort(item[here], kind="stable")]
                for at in range(0, len(rows), 256):
                    part = rows[at : at + 256]
                    scores = np.round(q[part] @ x[here].T, 6)
                    if len(here) > pool:  # all that reach the pool's last score stay: ties go by item
                        least = -np.partition(-scores, pool - 1, axis=1)[:, pool - 1 : pool]
                        r, c = np.nonzero(scores >= least)
                    else:
                        r, c = np.nonzero(np.ones(scores.shape, bool))
                    order = np.lexsort((c, -scores[r, c], r))
                    r, c = r[order], c[order]
                    nth = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c = r[nth < pool], c[nth < pool]
                    for o, v in zip(out, (ids[part[r]], np.full(len(r), k, np.int32), item[here[c]], scores[r, c]), strict=True):
                        o.append(v)
                    held.append(here[c])
        kinds = (np.int64, np.int32, np.int64, np.float64)
        found = {n: np.concatenate([np.zeros(0, t), *c]) for n, c, t in zip(names, out, kinds, strict=True)}
        return pa.table(found | {"hash": a.column("hash").take(pa.array(np.concatenate(held))) if a.num_rows else pa.array([], pa.string())})

    return run


def rrf_score(s: Settings) -> Column:
    """Weighted sum of reciprocal ranks, absent ranks adding nothing, in the order dense, sparse, exact."""
    part = lambda w, c: F.coalesce(F.lit(float(w)) / (F.lit(float(s.rrf_k)) + F.col(c)), F.lit(0.0))
    return F.lit(0.0) + part(s.dense_weight, "dense_rank") + part(s.sparse_weight, "sparse_rank") + part(s.exact_weight, "exact_rank")


def rrf_merge(legs: dict[str, DataFrame], s: Settings, top_k: int | None = None) -> DataFrame:
    """(query_id, rank, hash, item_id, kb_id, score, dense_rank, sparse_rank, exact_rank) of the top_k texts of
    each query. A text's item comes from the first leg that found it; equal scores go by the legs' ranks."""
    names = ("dense", "sparse", "exact")
    rows = reduce(DataFrame.unionByName, [legs[n].select("query_id", "hash", "item_id", "kb_id", "rank", F.lit(i).alias("leg")) for i, n in enumerate(names) if n in legs])
    ranks = [F.min(F.when(F.col("leg") == i, F.col("rank"))).alias(f"{n}_rank") for i, n in enumerate(names)]
    merged = rows.groupBy("query_id", "hash").agg(*ranks, F.min_by("item_id", "leg").alias("item_id"), F.min_by("kb_id", "leg").alias("kb_id"))
    merged = merged.withColumn("score", rrf_score(s))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *[F.col(f"{n}_rank").asc_nulls_last() for n in names])
    merged = merged.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < (top_k or s.top_k))
    return merged.select("query_id", "rank", "hash", "item_id", "kb_id", "score", "dense_rank", "sparse_rank", "exact_rank")


class Index(TextIndex):
    """Items and vectors in a stored index, searched by all legs."""

    def __init__(self, items: DataFrame, vectors: DataFrame | None = None, path: str | None = None):
        """An index of items (kb_id, item_id, hash, text) and vectors (kb_id, item_id, hash, vector) under path, where it can be
        opened and changed later; without one for this object's searches alone, in the shared folder."""
        super().__init__(items.sparkSession, path or shared_path(items.sparkSession, "index"), once=path is None)
        self.upsert(items, vectors)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index that is stored under path."""
        out = object.__new__(cls)
        TextIndex.__init__(out, spark, path)
        return out

    def search(self, queries: DataFrame, scope: DataFrame, s: Settings | None = None, top_k: int | None = None) -> DataFrame:
        """Hybrid search over the enabled legs. Blank queries find nothing by text."""
        s = s or Settings()
        legs: dict[str, DataFrame] = {}
        vectors = self.vectors() if s.dense_enabled else None
        if vectors is not None:
            legs["dense"] = dense_leg(queries, vectors, scope, s)
        kinds = [k for k, on in ((EXACT, s.exact_enabled), (SPARSE, s.sparse_enabled)) if on]
        if kinds:
            hits = self.text_hits(queries, scope, s.pool, kinds)
            hits = staged(hits.filter(F.col("kind") != SEEN), "hits") if len(kinds) > 1 else hits
            if s.sparse_enabled:
                legs["sparse"] = sparse_leg(hits, scope, s)
            if s.exact_enabled:
                legs["exact"] = exact_leg(hits, s)
        if not legs:
            raise ValueError("no leg is enabled")
        return rrf_merge(legs, s, top_k)

    def test_retrieval(self, queries: DataFrame, scope: DataFrame, top_k: int, s: Settings | None = None) -> DataFrame:
        """The first top_k of the usual results, which are Settings.top_k at most."""
        s = s or Settings()
        return self.search(queries, scope, s, min(top_k, s.top_k))

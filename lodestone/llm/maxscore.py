"""Exact top-k search by MaxScore over sharded inverted indexes.

Items are dealt to shards; a shard's index has, for every term, the items that hold it with their weights and
bounds of those weights. For a query, terms are ordered by the most that they can add to a score. The terms
whose bounds together stay below the k-th best score so far are non-essential: an item found in none of the
other, essential, posting lists can't get into the result. Essential postings are traversed, then the other
lists are probed for the items that can still compete, while their number falls with each list. Each shard
gives its k best items for each query, and these are merged.

Scores are inner products of integer weights, so they don't depend on the order of terms; terms that only
one side holds add nothing. Ties go to the smaller id. A query is never compared with the item that is the
same row, known by its number in a column "row"; without that column, by its id.

Contract: rows with a null id, null terms or weights, or a null among them take no part; rows without terms
have score 0. Repeated ids are separate items. With rows numbered, queries with one id are separate queries,
each with its own ranks; without, the smallest of them is taken. Sums that 64 bits can't hold are cut to their
ends, as are weights that from_vectors makes of very large components. Empty tables give no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of a shard and queries of a block: what one task holds.
SHARD, BLOCK = 8192, 1024
#: A list with this share of the shard's items is kept as a column, without ids.
DENSE = 0.25


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.asarray(column.offsets)
    return np.asarray(column.values)[off[0] : off[-1]], off - off[0]


class Shard:
    """Inverted index of a shard's items (rows of ragged terms and weights)."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, terms: np.ndarray, weights: np.ndarray, offsets: np.ndarray):
        order = np.argsort(ids, kind="stable")
        lens = np.diff(offsets)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.row, self.n = ids[order], row[order], len(ids)
        item = np.repeat(place, lens)
        by = np.lexsort((item, terms))
        terms, item, weights = terms[by], item[by], weights[by]
        self.terms, first = np.unique(terms, return_index=True)
        ends = np.append(first[1:], len(terms)) if len(first) else first
        self.lists, self.low, self.high = [], [], []
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            at, w = item[a:b], weights[a:b]
            self.low.append(int(w.min()))
            self.high.append(int(w.max()))
            if b - a >= DENSE * self.n and len(np.unique(at)) == b - a:
                column = np.zeros(self.n, np.int64)
                column[at] = w
                self.lists.append((None, column))
            else:
                self.lists.append((at, w))
        self.narrow = max([1, *map(abs, self.low), *map(abs, self.high)])

    def _search_wide(self, own: np.ndarray, lists: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """search() in integers of any size."""
        total = np.zeros(self.n, object)
        for t, w in zip(lists.tolist(), q.tolist(), strict=True):
            items, weights = self.lists[t]
            np.add.at(total, np.arange(self.n) if items is None else items, weights.astype(object) * w)
        total = [min(max(x, -(2**63)), 2**63 - 1) for x in total.tolist()]
        best = sorted(np.flatnonzero(~own).tolist(), key=lambda i: (-total[i], self.ids[i]))[:k]
        return np.array(best, np.int64), np.array([total[i] for i in best], np.int64)

    def search(self, query_row: int, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best items, best first."""
        at = np.searchsorted(self.terms, terms)
        hit = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weights != 0) if len(self.terms) else np.zeros(len(terms), bool)
        lists, q = at[hit], weights[hit]
        bound = np.array([max(0, int(w) * self.low[t], int(w) * self.high[t]) for t, w in zip(lists, q, strict=True)], object)
        order = np.array(sorted(range(len(q)), key=lambda i: -bound[i]), int)
        rest = [0] * (len(q) + 1)  # the most that the lists from i on can add
        for i in range(len(q) - 1, -1, -1):
            rest[i] = rest[i + 1] + bound[order[i]]
        own = self.row == query_row
        if sum(int(w) * self.narrow if w > 0 else -int(w) * self.narrow for w in q.tolist()) >= 2**62:
            return self._search_wide(own, lists, q, k)
        score = np.zeros(self.n, np.int64)
        alive: np.ndarray | None = None  # None: every item
        floor: int | None = None  # a score that k items are known to reach
        essential = True
        for i, j in enumerate(order.tolist()):
            essential = essential and (floor is None or rest[i] >= floor)
            if not essential and alive is None:
                # Lists from here on can't lift an item that no essential list holds.
                alive = np.flatnonzero((score + rest[i] >= floor) & ~own)
            items, w = self.lists[lists[j]]
            if alive is None:
                if items is None:
                    score += int(q[j]) * w
                else:
                    np.add.at(score, items, int(q[j]) * w)
            elif items is None:
                score[alive] += int(q[j]) * w[alive]
            else:
                lo, hi = np.searchsorted(items, alive, "left"), np.searchsorted(items, alive, "right")
                found = np.flatnonzero(hi > lo)
                for f, a, b in zip(found.tolist(), lo[found].tolist(), hi[found].tolist(), strict=True):
                    score[alive[f]] += int(q[j]) * int(w[a:b].sum())
            if i % 8 == 7 or i == len(order) - 1:
                floor = self._floor(score, own, alive, lists, q, order, i + 1, k, floor)
                if floor is not None and alive is not None:
                    alive = alive[score[alive] + rest[i + 1] >= floor]
                elif floor is not None and floor > 0 and rest[i + 1] < floor:
                    alive = np.flatnonzero((score + rest[i + 1] >= floor) & ~own)
        if alive is None:
            alive = np.flatnonzero(~own)
        if len(alive) > k:
            kth = np.partition(score[alive], len(alive) - k)[len(alive) - k]
            alive = alive[score[alive] >= kth]
        best = alive[np.lexsort((self.ids[alive], -score[alive]))][:k]
        return best, score[best]

    def _floor(self, score: np.ndarray, own: np.ndarray, alive: np.ndarray | None, lists: np.ndarray, q: np.ndarray, order: np.ndarray, done: int, k: int, floor: int | None) -> int | None:
        """A lower bound of the k-th best score: the whole scores of the k items that lead so far."""
        lead = np.flatnonzero(~own) if alive is None else alive
        if len(lead) < k:
            return floor
        top = lead[np.argpartition(score[lead], len(lead) - k)[len(lead) - k :]]
        full = score[top].copy()
        for j in order[done:].tolist():
            items, w = self.lists[lists[j]]
            if items is None:
                full += int(q[j]) * w[top]
            else:
                for n, t in enumerate(top.tolist()):
                    a, b = np.searchsorted(items, [t, t + 1])
                    full[n] += int(q[j]) * int(w[a:b].sum())
        low = int(full.min())
        return low if floor is None else max(floor, low)


def _clean(df: DataFrame) -> DataFrame:
    whole = ~F.exists("terms", lambda x: x.isNull()) & ~F.exists("weights", lambda x: x.isNull()) & (F.size("terms") == F.size("weights"))
    row = F.col("row" if "row" in df.columns else "id").cast("long").alias("row")
    return df.select(F.col("id").cast("long").alias("id"), row, F.col("terms").cast("array<long>").alias("terms"), F.col("weights").cast("array<long>").alias("weights")).filter(F.col("id").isNotNull() & whole)


def top_k(items: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k items with the highest inner product for each query. Items and
    queries have columns (id, terms array<long>, weights array<long>) and, as the number of a row, row.

    Items are dealt to shards and queries to blocks by a hash of their row, and each pair of them is one
    group: what a task holds is bounded, and each vector is sent once for each block or shard. Both sides are
    read twice, so they should be stored."""
    items = _clean(items)
    queries = _clean(queries) if "row" in queries.columns else _clean(queries).groupBy("id", "row").agg(F.min(F.struct("terms", "weights")).alias("q")).select("id", "row", "q.terms", "q.weights")
    shards, blocks = max(1, -(-items.count() // shard)), max(1, -(-queries.count() // block))
    if shards * blocks < 12:
        shards = -(-12 // blocks)
    dealt = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = dealt(items, "s", shards, "b", blocks).groupBy("s", "b")
    right = dealt(queries, "b", blocks, "s", shards).groupBy("s", "b")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        terms, off = _ragged(a.column("terms"))
        index = Shard(a.column("id").to_numpy(), a.column("row").to_numpy(), terms, _ragged(a.column("weights"))[0], off)
        qt, qoff = _ragged(b.column("terms"))
        qw = _ragged(b.column("weights"))[0]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for n, (row, query) in enumerate(zip(b.column("row").to_pylist(), b.column("id").to_pylist(), strict=True)):
            best, score = index.search(row, qt[qoff[n] : qoff[n + 1]], qw[qoff[n] : qoff[n + 1]], k)
            for part, x in zip(out, (np.full(len(best), row), np.full(len(best), query), index.ids[best], score), strict=True):
                part.append(x)
        return pa.table({n: np.concatenate(c) for n, c in zip(names, out, strict=True)})

    found = left.cogroup(right).applyInArrow(run, "query_row long, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def from_vectors(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, terms, weights) of vectors: component i, as floor(scale * x), is the weight of term i; zeros are
    left out. Vectors that are null or hold a null or a component that isn't finite are dropped."""
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    w = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    rows = df.select(F.col(key).cast("long").alias("id"), w.alias("w"), good.alias("good")).filter("good")
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.coalesce(F.get("w", i - 1), F.lit(0)) != 0)
    return rows.withColumn("terms", at.cast("array<int>")).select("id", "terms", F.transform("terms", lambda i: F.get("w", i - 1)).alias("weights"))

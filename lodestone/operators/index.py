"""A stored full-text index of immutable segments, searched by the largest impacts of blocks of items.

Items are dealt to shards of one knowledge base and bounded size. A shard has a row for each term: places of the items
that hold it, frequencies, and for every block of 256 places the largest frequency and the largest share of a unit
vector. A query gets from a block at most the sum of its terms' largest impacts there; so a shard takes its blocks
by falling bounds, and stops at the first that can't reach the worst of the best items so far. Rows lie in folders by
term hash: a search opens the folders of its terms, and the heads of shards (item ids, hashes, norms, lengths).

An upsert writes a segment of the new items alone, tombstones for the old ones, and how much each term's document
frequency falls; manifests (see versions) tell what counts. Segments of like size are merged, without a look at texts.
Results are those of an index built anew from the live items.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.scale import bounded
from lodestone.operators.versions import Versions

#: Places of a block; items and bytes of text that a shard holds; folders for term hashes.
BLOCK, SHARD_ITEMS, SHARD_BYTES, BUCKETS = 256, 8192, 8 << 20, 16
#: Queries that meet a shard in one group, and in one matrix.
QUERY_BLOCK, MATRIX_QUERIES = 2048, 128
#: Terms of a batch of queries up to which they reach the scan as a filter.
PUSHED_TERMS = 200
HEADS, FORWARD = -1, -2  # folders of shards' heads, and of items with their terms
EXACT, SPARSE, SEEN = 0, 1, 2  # kinds of result rows; SEEN: of item_id blocks of postings, score were read
#: A row is a term of a shard (term; numbers packed as little-endian bytes: at and tf for each item that holds it; block, first,
#: most and heaviest for each block), a shard's head (items, norms, lengths, hashes by place; tokens of all), or an item
#: with its terms (place, item_id, hash, tokens, terms, tf).
_ROW = "kb_id int, shard int, term string, n int, at binary, tf binary, block binary, first binary, most binary, heaviest binary, items binary, norms binary, lengths binary, hashes array<string>, place int, item_id long, hash string, tokens long, terms array<string>"
_HIT = "kind int, query_id long, kb_id int, item_id long, hash string, score double"
_SHARD = ("kb_id", "shard")


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _packed(ends: np.ndarray, values: np.ndarray, kind: str) -> pa.Array:
    """Bytes of values between neighbouring ends."""
    values = np.ascontiguousarray(values, kind)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((np.asarray(ends) * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed bytes, and the ends of each row's, 0 first."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    off = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    data = np.frombuffer(flat.buffers()[2], kind, (off[-1] - off[0]) // size, int(off[0])) if off[-1] > off[0] else np.zeros(0, kind)
    return data, (off - off[0]) // size


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends).astype(np.int32)), values.cast(pa.string()))


_BYTES = ("at", "tf", "block", "first", "most", "heaviest", "items", "norms", "lengths")
_TYPES = {"kb_id": pa.int32(), "shard": pa.int32(), "term": pa.string(), "n": pa.int32()} | {k: pa.binary() for k in _BYTES} | {"hashes": pa.list_(pa.string()), "place": pa.int32(), "item_id": pa.int64(), "hash": pa.string(), "tokens": pa.int64(), "terms": pa.list_(pa.string())}


def _rows(n: int, /, **columns: pa.Array) -> pa.Table:
    return pa.table({k: columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in _TYPES.items()})


def shard_rows(items: pa.Table, changeable: bool = True) -> pa.Table:
    """A shard's rows of its items (kb_id, shard, item_id, hash, terms, tf; tf null: once for each mention); changeable: with each
    item's terms."""
    items = items.take(pc.sort_indices(items, [("item_id", "ascending"), ("hash", "ascending")])).combine_chunks()
    n = items.num_rows
    lens = pc.fill_null(pc.list_value_length(items["terms"]), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(items["terms"])
    coded = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    times = _unpacked(items["tf"], "<i4")[0] if items["tf"].null_count < n else np.ones(len(code), np.int64)
    key = code * n + np.repeat(np.arange(n), lens)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    tf = np.add.reduceat(times[order], starts) if len(starts) else np.zeros(0, np.int64)
    code, at = np.divmod(key[order][starts], max(n, 1))
    w = np.log1p(tf)
    norms, lengths = np.sqrt(np.bincount(at, w * w, n)), np.bincount(at, tf, n).astype(np.int64)
    # Terms, and blocks of each.
    t0 = np.flatnonzero(np.diff(code, prepend=-1))
    new = np.diff(code, prepend=-1) != 0
    new |= np.diff(at // BLOCK, prepend=-1) != 0
    b0 = np.flatnonzero(new)
    of = np.searchsorted(t0, b0, "right") - 1
    most = np.maximum.reduceat(tf, b0) if len(b0) else tf
    heaviest = np.maximum.reduceat(w / norms[at], b0) if len(b0) else w
    per_term, per_block = np.append(t0, len(at)), np.append(np.searchsorted(b0, t0), len(b0))
    kb, shard = items["kb_id"][0].as_py(), items["shard"][0].as_py()
    same = lambda k: {"kb_id": pa.array([kb] * k, pa.int32()), "shard": pa.array([shard] * k, pa.int32())}
    postings = _rows(
        len(t0), **same(len(t0)), term=words.take(pa.array(code[t0])), n=pa.array(np.diff(per_term)), at=_packed(per_term, at, "<i4"), tf=_packed(per_term, tf, "<i4"),
        block=_packed(per_block, at[b0] // BLOCK, "<i4"), first=_packed(per_block, b0 - t0[of], "<i4"), most=_packed(per_block, most, "<i4"), heaviest=_packed(per_block, heaviest, "<f8"),
    )
    whole = np.array([0, n])
    ids, hashes = items["item_id"].combine_chunks(), items["hash"].combine_chunks()
    head = _rows(1, **same(1), n=pa.array([n]), items=_packed(whole, ids.to_numpy(), "<i8"), norms=_packed(whole, norms, "<f8"), lengths=_packed(whole, lengths, "<i8"), hashes=_lists(whole, hashes), tokens=pa.array([int(lengths.sum())]))
    if not changeable:
        return pa.concat_tables([postings, head])
    back, ends = np.argsort(at, kind="stable"), np.append(0, np.cumsum(np.bincount(at, minlength=n)))
    forward = _rows(n, **same(n), n=pa.array(np.diff(ends)), place=pa.array(np.arange(n)), item_id=ids, hash=hashes, tokens=pa.array(lengths), terms=_lists(ends, words.take(pa.array(code[back]))), tf=_packed(ends, tf[back], "<i4"))
    return pa.concat_tables([postings, head, forward])


class Shard:
    """A shard's postings of the terms that are asked for, in flat arrays. model: tfidf2 or bm25, with the mean length."""

    def __init__(self, rows: pa.Table, model: str = "tfidf2", mean: float = 1.0):
        rows = rows.combine_chunks()
        head, held = rows.filter(pc.is_valid(rows["items"])), rows.filter(pc.is_valid(rows["term"]))
        self.items, self.norms, self.lengths = (_unpacked(head[c], k)[0] for c, k in (("items", "<i8"), ("norms", "<f8"), ("lengths", "<i8")))
        self.hashes = pc.list_flatten(head["hashes"])
        self.live = np.ones(len(self.items), bool)
        if "dead" in rows.column_names:
            self.live[np.asarray(pc.list_flatten(rows["dead"])).astype(np.int64)] = False
        self.terms = held["term"]
        (self.at, p0), (self.tf, _), (block, b0) = (_unpacked(held[c], "<i4") for c in ("at", "tf", "block"))
        first, most = (_unpacked(held[c], "<i4")[0] for c in ("first", "most"))
        self.heaviest = _unpacked(held["heaviest"], "<f8")[0]
        self.model = model
        if model == "bm25":
            self.scale = 1.2 * (0.25 + 0.75 * self.lengths / mean)
            self.most = most * 2.2 / (most + 0.3)
        else:
            self.most = most.astype(float)
        # Pieces: a term's postings in a block, in the order of blocks.
        term = np.repeat(np.arange(len(b0) - 1), np.diff(b0))
        begin = p0[term] + first
        end = np.append(begin[1:], p0[-1])
        order = np.argsort(block, kind="stable")
        self.block, self.term, self.begin, self.end, self.piece = block[order], term[order], begin[order], end[order], order

    def best(self, weights: np.ndarray, pool: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of queries, the pool best items of each, ties to the smaller id: (query, place, rounded score) by query and rank; and
        how many pieces each query has read, and in all. weights has a row for each query and a column for each term.

        Blocks are taken by falling bounds, and only by the queries to which one can still give a better item."""
        queries, blocks = len(weights), -(-len(self.items) // BLOCK)
        impact = (self.heaviest if kind == SPARSE else self.most)[self.piece]
        asked = weights > 0
        at = np.searchsorted(self.block, np.arange(blocks + 1))
        bound = np.zeros((queries, blocks))
        for b in range(blocks):
            part = slice(at[b], at[b + 1])
            bound[:, b] = weights[:, self.term[part]] @ impact[part]
        least = np.full(queries, -np.inf)
        kept = np.full((queries, pool), -np.inf)
        read, found = np.zeros(queries, np.int64), []
        for b in np.argsort(-bound.sum(axis=0), kind="stable").tolist():
            active = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] + 1e-6 >= least))
            if not len(active):
                continue
            part = slice(at[b], at[b + 1])
            used = asked[np.ix_(active, self.term[part])]
            read[active] += used.sum(axis=1)
            mine = np.flatnonzero(used.any(axis=0)) + at[b]
            begin, size = self.begin[mine], (self.end - self.begin)[mine]
            ends = np.cumsum(size)
            k = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
            places, tf = self.at[k], self.tf[k]
            if kind == SPARSE:
                value = np.log1p(tf) / self.norms[places]
            else:
                value = tf * 2.2 / (tf + self.scale[places]) if self.model == "bm25" else tf
            matrix = np.zeros((len(mine), min(BLOCK, len(self.items) - b * BLOCK)))
            matrix[np.repeat(np.arange(len(mine)), size), places - b * BLOCK] = value
            scores = np.round(weights[np.ix_(active, self.term[mine])] @ matrix, 6)
            scores[:, ~self.live[b * BLOCK : b * BLOCK + matrix.shape[1]]] = -np.inf
            if kind == SPARSE:  # an item without a common term has no score, one with a tiny one has
                scores[(used[:, mine - at[b]].astype(np.float32) @ (matrix > 0).astype(np.float32)) == 0] = -np.inf
            else:
                scores[scores <= 0] = -np.inf
            q, p = np.nonzero((scores >= least[active, None]) & (scores > -np.inf))
            found.append((active[q], p + b * BLOCK, scores[q, p]))
            kept[active] = -np.partition(-np.concatenate([kept[active], scores], axis=1), pool - 1, axis=1)[:, :pool]
            least = kept.min(axis=1)
        query, place, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        stay = score >= least[query]
        query, place, score = query[stay], place[stay], score[stay]
        order = np.lexsort((place, -score, query))
        query, place, score = query[order], place[order], score[order]
        stay = np.arange(len(query)) - np.searchsorted(query, query) < pool
        return query[stay], place[stay], score[stay], read, asked @ np.bincount(self.term, minlength=weights.shape[1])


def _answer(pool: int, kinds: list[int], model: str, mean: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        hashes, kb = pa.array([], pa.string()), 0
        if left.num_rows and right.num_rows and pc.any(pc.is_valid(left["items"])).as_py():
            shard, kb = Shard(left, model, mean), left["kb_id"][0].as_py()
            hashes = shard.hashes
            for at in range(0, right.num_rows, MATRIX_QUERIES):
                part = right.slice(at, MATRIX_QUERIES).combine_chunks()
                ids = np.asarray(part["query_id"])
                asked = pc.list_flatten(part["terms"])
                own = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(part["terms"])))
                term = pc.index_in(pc.struct_field(asked, "term"), value_set=shard.terms.combine_chunks())
                there = np.flatnonzero(np.asarray(pc.is_valid(term)))
                term = np.asarray(term.drop_null())
                for kind in kinds:
                    weights = np.zeros((len(ids), len(shard.terms)))
                    weights[own[there], term] = np.asarray(pc.struct_field(asked, "sparse" if kind == SPARSE else "exact"))[there]
                    q, p, s, read, of = shard.best(weights, pool, kind)
                    found.append((np.full(len(q), kind), ids[q], shard.items[p], p, s))
                    found.append((np.full(len(ids), SEEN), ids, of, np.full(len(ids), -1), read.astype(float)))
        kind, query, item, place, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        hashes = hashes.take(pa.array(place, pa.int64(), mask=place < 0))
        return pa.table({"kind": pa.array(kind, pa.int32()), "query_id": pa.array(query, pa.int64()), "kb_id": pa.array(np.full(len(kind), kb), pa.int32()), "item_id": pa.array(item, pa.int64()), "hash": hashes, "score": pa.array(score, pa.float64())})

    return run


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of each query's distinct terms."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


class TextIndex:
    """The newest version of an index stored under path; refresh() looks for a newer one. buckets: folders of a new index, more
    of them for a larger one. once: a new index is for a few searches and can't be changed; it leaves out what changes need,
    and folders."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, once: bool = False):
        self.spark, self.path, self.new = spark, path.rstrip("/"), {"buckets": 1 if once else buckets, "once": once}
        self.versions = Versions(spark, path)
        self.refresh()

    def refresh(self) -> TextIndex:
        self.number, content = self.versions.newest()
        self.content = content or {"segments": [], "tombs": [], "items": 0, "tokens": 0} | self.new
        return self

    @property
    def items(self) -> int:
        return self.content["items"]

    def _read(self, kind: str, name: str) -> DataFrame:
        ddl = {"rows": f"{_ROW}, bucket int", "terms": "term string, df long, bucket int", "tombs": "segment string, kb_id int, shard int, item_id long, place int, tokens long", "deltas": "term string, df long, bucket int"}
        return self.spark.read.schema(ddl[kind]).parquet(f"{self.path}/{kind}/{name}")

    def _segment(self, items: DataFrame, name: str) -> tuple[int, int]:
        """Write a segment of (kb_id, item_id, hash, text), or of (kb_id, item_id, hash, tokens, terms, tf); its items and tokens."""
        known = "terms" in items.columns
        size = F.col("tokens") * 8 if known else F.octet_length("text")
        dealt = items.groupBy("kb_id").agg(F.greatest(F.ceil(F.count("*") / SHARD_ITEMS), F.ceil(F.sum(size) / SHARD_BYTES), F.lit(1)).alias("shards"))
        placed = items.alias("i").join(dealt.alias("d"), F.col("i.kb_id").eqNullSafe(F.col("d.kb_id")))
        own = [c for c in items.columns if c not in ("kb_id", "tokens")]
        placed = placed.select(F.col("i.kb_id").cast("int").alias("kb_id"), F.pmod(F.xxhash64("item_id"), F.col("shards")).cast("int").alias("shard"), *own).repartition(*_SHARD)
        if not known:  # behind the shuffle: texts are smaller than their words
            placed = placed.select(*_SHARD, "item_id", "hash", tokens(F.col("text")).alias("terms"), F.lit(None).cast("binary").alias("tf"))
        once, buckets = self.content["once"], self.content["buckets"]
        make = lambda t: shard_rows(t, not once)
        made = placed.select(*_SHARD, "item_id", "hash", "terms", "tf").groupBy(*_SHARD).applyInArrow(make, _ROW)
        where = F.when(F.col("term").isNotNull(), bucket(F.col("term"), buckets)).when(F.col("terms").isNotNull(), FORWARD).otherwise(HEADS)
        made = made.withColumn("bucket", where)
        made = made if once else made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        made.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/rows/{name}")
        if not once:
            terms = self._read("rows", name).filter(F.col("bucket") >= 0).groupBy("term", "bucket").agg(F.sum("n").alias("df"))
            terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/terms/{name}")
        heads = self._read("rows", name).filter(F.col("bucket") == HEADS).agg(F.sum("n"), F.sum("tokens")).head()
        return heads[0] or 0, heads[1] or 0

    def _forward(self, segment: str) -> DataFrame:
        """(segment, kb_id, shard, place, item_id, hash, tokens, terms, tf) of a segment's live items."""
        own = self._read("rows", segment).filter(F.col("bucket") == FORWARD)
        own = own.select(F.lit(segment).alias("segment"), "kb_id", "shard", "place", "item_id", "hash", "tokens", "terms", "tf")
        return own.join(self._tombs().filter(F.col("segment") == segment).select("item_id"), "item_id", "left_anti") if self.content["tombs"] else own

    def _tombs(self) -> DataFrame:
        empty = self.spark.createDataFrame([], "segment string, kb_id int, shard int, item_id long, place int, tokens long")
        return reduce(DataFrame.unionByName, [self._read("tombs", t) for t in self.content["tombs"]]) if self.content["tombs"] else empty

    def _names(self) -> list[str]:
        return [s["name"] for s in self.content["segments"]]

    def _bury(self, keys: DataFrame, name: str) -> tuple[int, int]:
        """Tombstones of the live items among keys (item_id), and what their terms lose; items and tokens that go."""
        if not self.content["segments"]:
            return 0, 0
        if self.content["once"]:
            raise ValueError("this index was built for a few searches and can't be changed")
        dead = reduce(DataFrame.unionByName, [self._forward(s) for s in self._names()]).join(keys.select("item_id").distinct(), "item_id", "left_semi")
        dead.select("segment", "kb_id", "shard", "item_id", "place", "tokens", "terms").write.parquet(f"{self.path}/tombs/{name}")
        dead = self.spark.read.parquet(f"{self.path}/tombs/{name}")
        less = dead.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")).withColumn("bucket", bucket(F.col("term"), self.content["buckets"]))
        less.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/deltas/{name}")
        return tuple(x or 0 for x in dead.agg(F.count("*"), F.sum("tokens")).head())

    def _commit(self, content: dict) -> TextIndex:
        self.versions.commit(self.number + 1, content)  # Conflict, if another writer came first
        return self.refresh()

    def upsert(self, items: DataFrame, vectors: DataFrame | None = None) -> TextIndex:
        """Put items (kb_id, item_id, hash, text), and their vectors, in place of those with the same item_id."""
        name = uuid.uuid4().hex
        gone = self._bury(items, name)
        new = self._segment(items.select("kb_id", "item_id", "hash", "text"), name)
        if vectors is not None:
            vectors.write.parquet(f"{self.path}/vectors/{name}")
        c = self.content
        tombs = c["tombs"] + ([name] if gone[0] else [])
        segments = c["segments"] + ([{"name": name, "items": new[0], "vectors": vectors is not None}] if new[0] else [])
        return self._commit(c | {"segments": segments, "tombs": tombs, "items": c["items"] + new[0] - gone[0], "tokens": c["tokens"] + new[1] - gone[1]})

    def delete(self, keys: DataFrame) -> TextIndex:
        """Take out the items with these ids (item_id)."""
        name = uuid.uuid4().hex
        gone = self._bury(keys, name)
        c = self.content
        return self._commit(c | {"tombs": [*c["tombs"], name], "items": c["items"] - gone[0], "tokens": c["tokens"] - gone[1]}) if gone[0] else self

    def delete_kb(self, kb_id: int) -> TextIndex:
        """Take out all items of a knowledge base."""
        if not self.content["segments"]:
            return self
        return self.delete(reduce(DataFrame.unionByName, [self._forward(s) for s in self._names()]).filter(F.col("kb_id") == kb_id).select("item_id"))

    def merge(self, at_least: int = 4, all: bool = False) -> list[str]:
        """Merge at_least segments or more whose sizes differ by less than four times, or all; returns which. Their tombstones and
        what these took from document frequencies are merged with them."""
        tiers: dict[int, list[dict]] = {}
        for s in self.content["segments"]:
            tiers.setdefault(0 if all else max(s["items"], 1).bit_length() // 2, []).append(s)
        chosen = [s for t in tiers.values() if len(t) >= (1 if all else at_least) for s in t]
        if not chosen:
            return []
        names, name = [s["name"] for s in chosen], uuid.uuid4().hex
        live = reduce(DataFrame.unionByName, [self._forward(s) for s in names])
        new = self._segment(live.select("kb_id", "item_id", "hash", "tokens", "terms", "tf"), name)
        has_vectors = [s["name"] for s in chosen if s["vectors"]]
        if has_vectors:
            self._vectors(has_vectors).write.parquet(f"{self.path}/vectors/{name}")
        c, rest = self.content, [s for s in self.content["segments"] if s["name"] not in names]
        tombs: list[str] = []
        if c["tombs"] and rest:  # of segments that stay
            left = self._tombs().filter(~F.col("segment").isin(names))
            if left.head(1):
                # Their terms are read again from the segments that they are of.
                whole = reduce(DataFrame.unionByName, [self._read("rows", s["name"]).filter(F.col("bucket") == FORWARD).select(F.lit(s["name"]).alias("segment"), "item_id", "terms") for s in rest])
                left.join(whole, ["segment", "item_id"]).write.parquet(f"{self.path}/tombs/{name}")
                less = self.spark.read.parquet(f"{self.path}/tombs/{name}").select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")).withColumn("bucket", bucket(F.col("term"), self.content["buckets"]))
                less.write.partitionBy("bucket").parquet(f"{self.path}/deltas/{name}")
                tombs = [name]
        self._commit(c | {"segments": rest + ([{"name": name, "items": new[0], "vectors": bool(has_vectors)}] if new[0] else []), "tombs": tombs})
        return names

    def _vectors(self, names: list[str]) -> DataFrame:
        tombs = self._tombs() if self.content["tombs"] else None
        parts = []
        for name in names:
            own = self.spark.read.parquet(f"{self.path}/vectors/{name}")
            parts.append(own.join(tombs.filter(F.col("segment") == name).select("item_id"), "item_id", "left_anti").select(*own.columns) if tombs is not None else own)
        return reduce(DataFrame.unionByName, parts)

    def vectors(self) -> DataFrame | None:
        """(kb_id, item_id, hash, vector) of the live items that have one."""
        names = [s["name"] for s in self.content["segments"] if s["vectors"]]
        return self._vectors(names) if names else None

    def frequencies(self, wanted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(term, df) over the live items, of all terms or of what wanted leaves of (term, df, bucket)."""
        if self.content["once"]:
            parts = [self._read("rows", s).filter(F.col("bucket") >= 0).select("term", F.col("n").cast("long").alias("df"), "bucket") for s in self._names()]
        else:
            parts = [self._read("terms", s) for s in self._names()]
        parts += [self._read("deltas", t) for t in self.content["tombs"]]
        if not parts:
            return self.spark.createDataFrame([], "term string, df long")
        every = reduce(DataFrame.unionByName, parts)
        return (wanted(every) if wanted else every).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def text_hits(self, queries: DataFrame, scope: DataFrame, pool: int, kinds: list[int], model: str = "tfidf2") -> DataFrame:
        """(kind, query_id, kb_id, item_id, hash, score): the pool best of each shard for each query (query_id, text) in its scope
        (query_id, kb_id). EXACT: the sum of tf * idf ** 2 over the query's distinct terms, with idf = log10(items / df) over all
        items, whatever the scope; or bm25 with k1 1.2 and b 0.75. SPARSE: the inner product of vectors with weights ln(1 + tf)
        at unit length. SEEN: of item_id blocks of postings, score were read."""
        asked = query_terms(queries)
        few = asked.select("query_id", "term", bucket(F.col("term"), self.content["buckets"]).alias("bucket")).limit(PUSHED_TERMS + 1).collect()
        blocks = 1
        if len(few) <= PUSHED_TERMS:
            words, folders = sorted({r.term for r in few}), sorted({r.bucket for r in few})
            wanted = lambda df: df.filter(F.col("bucket").isin(folders) & F.col("term").isin(words))
        else:
            pairs, count = asked.agg(F.count("*"), F.count_distinct("query_id")).head()
            blocks = -(-count // QUERY_BLOCK)
            wanted = lambda df: df.filter(F.col("bucket") >= 0).join(bounded(asked.select("term"), pairs), "term", "left_semi")
        qw = F.ln(1 + F.col("qtf"))
        asked = asked.withColumn("qw", qw / F.sqrt(F.sum(qw * qw).over(Window.partitionBy("query_id")))).join(self.frequencies(wanted), "term")
        n = float(self.items)
        idf = F.pow(F.log10(F.lit(n) / F.col("df")), 2) if model == "tfidf2" else F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("exact"), F.col("qw").alias("sparse"))).alias("terms"))
        rows = [self._read("rows", s).select("*", F.lit(i).alias("segment"), F.lit(None).cast("array<int>").alias("dead")) for i, s in enumerate(self._names())]
        if not rows:
            return self.spark.createDataFrame([], _HIT)
        every = reduce(DataFrame.unionByName, rows)
        heads = every.filter(F.col("bucket") == HEADS)
        place = ["segment", *_SHARD]
        right = weights.join(scope.select("query_id", "kb_id"), "query_id").join(heads.select(*place), "kb_id")
        right = right.select(*(F.col(c).alias(f"of_{c}") for c in place), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("of_b"), "query_id", "terms")
        own = [*place, "term", "at", "tf", "block", "first", "most", "heaviest", "items", "norms", "lengths", "hashes", "dead"]
        left = wanted(every).select(*own).unionByName(heads.select(*own))
        if self.content["tombs"]:
            names = F.array(*(F.lit(s) for s in self._names()))
            dead = self._tombs().groupBy((F.array_position(names, F.col("segment")) - 1).cast("int").alias("segment"), *_SHARD).agg(F.collect_list("place").alias("dead")).filter("segment >= 0")
            left = left.unionByName(dead, allowMissingColumns=True)
        left = left.join(scope.select("kb_id").distinct(), "kb_id", "left_semi").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        key = [*place, "b"]
        mean = self.content["tokens"] / self.items if self.items and self.content["tokens"] else 1.0
        return left.groupBy(*key).cogroup(right.groupBy(*(f"of_{c}" for c in key))).applyInArrow(_answer(pool, kinds, model, mean), _HIT)

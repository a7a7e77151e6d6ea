"""N-gram Jaccard join by prefix trees.

A document is the set of its word n-grams. All n-grams have one global order, rare ones first (by a hashed
count of documents over the whole corpus, a table of fixed size). Two sets that are similar enough share an
n-gram among their first few, so only those are compared over the network: sorted by n-gram and size, they form
runs of sets that may link; within a run, histograms of the sets' hashes bound the overlap of each pair, which
leaves few pairs but near copies. The connected components of these hold every pair that can link. The sets of
a component then meet in a prefix tree: it stores them in a common order, a depth-first traversal keeps the
overlap of each node's path with all other sets at once, so that sets below a node share it, and a set leaves
a subtree as soon as the lengths that remain can't reach the threshold.

Equal sets are one class from the start, so copies cost one row. A large candidate component is cut into
blocks of bounded size. Each block is joined in itself and with the class that has the most copies, and only
classes that aren't yet linked with the largest group meet all other blocks: no group is gathered in one task
and no pair is lost. Traversals end early for sets that are already linked, so pairs are never written out,
only spanning forests.

Contract: null and empty texts, and texts without a word, have an empty set and link with nothing. Fewer words
than n make one n-gram. A-Z are lower-cased. Rows with a null id get a size but no component (null) and link
with nothing. Repeated rows are equal sets. N-grams and classes are known by 64-bit hashes: two of m differing
sets are taken for equal with a probability of about m**2 / 2**65. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, join_checked, join_heavy, local_forest, mix64, slim, slim_group, staged, text_chunks, word_hashes

#: Cells of the table of hashed counts (a byte each once it is broadcast), and of one of its blocks.
CELLS_BITS, BLOCK_BITS = 21, 14
#: Bins of a set's histogram, bins of sets with more than LONG n-grams (few bins tell little of those), and the
#: longest run of sets with a common n-gram whose pairs are all bounded by histograms.
BINS, FINE, LONG, RUN = 64, 2048, 800, 512
#: N-grams of the sets that one task joins.
GROUP_TOKENS = 250_000
_M = np.uint64
_ODD = [_M(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    h, at = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            grams += h[k : k + len(grams)] * _ODD[k]
    grams = mix64(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix64((h[a:b] * np.array(_ODD[: b - a])).sum(keepdims=True, dtype=np.uint64) + _M(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a set of n-grams."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) + _M(len(s)) * _ODD[0]])).view(np.int64)[0])


def least_overlap(size: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The least overlap of two sets with size elements together for a similarity of num / den."""
    return -(-num * size // (num + den))


def _counted(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS_BITS, np.int64)
        for b in batches:
            for _, _, data, off in text_chunks(b.column(0)):
                sets = shingle_sets(data, off, n)
                np.add.at(cells, (np.concatenate(sets) >> _M(64 - CELLS_BITS)).astype(np.int64), 1)
        for k, part in enumerate(cells.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                part = np.minimum(part, 2**32 - 1).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "cells"])

    return run


def _summed(t: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK_BITS, np.float64)
    for c in t.column("cells"):
        total += np.frombuffer(c.as_py(), np.uint32)
    level = np.minimum(255, np.round(4 * np.log2(1 + total))).astype(np.uint8)
    return pa.table({"block": t.column("block")[:1], "cells": pa.array([level.tobytes()], pa.binary())})


def levels(texts: DataFrame, n: int) -> np.ndarray:
    """How frequent the n-grams of each cell are, on a logarithmic scale: 2 ** CELLS_BITS bytes, whatever the input."""
    out = np.zeros((1 << (CELLS_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for r in texts.mapInArrow(slim(_counted(n)), "block int, cells binary").groupBy("block").applyInArrow(slim_group(_summed), "block int, cells binary").collect():
        out[r.block] = np.frombuffer(r.cells, np.uint8)
    return out.ravel()


def _ordered(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """N-grams as keys in global order: 8 bits of frequency, 56 of hash."""
    return np.sort((level[(s >> _M(64 - CELLS_BITS)).astype(np.int64)].astype(np.uint64) << _M(56)) | (s >> _M(8)))


def _signed(n: int, num: int, den: int, table):
    """(id, n, class, first n-grams, n-grams in each bin of the hash) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(table.value, np.uint8)
        for b in batches:
            for lo, hi, data, off in text_chunks(b.column(2)):
                sizes, keys, first, bins = [], [], [], []
                for s in shingle_sets(data, off, n):
                    sizes.append(len(s))
                    keys.append(class_key(s) if len(s) else None)
                    k = _ordered(s, level)
                    first.append(k[: len(s) + 1 - -(-num * len(s) // den)] if len(s) else s)
                    width = BINS if len(s) <= LONG else FINE
                    bins.append(np.bincount((k & _M(width - 1)).astype(np.int64), minlength=width).astype("<u2").tobytes())
                at = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
                flat = np.concatenate(first).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(bins, pa.binary())], names=["id", "h", "n", "ck", "first", "bins"])

    return run


def _chained(num: int, den: int):
    """From rows (n-gram, size, class) in that order: the runs of sets that share an n-gram and whose sizes allow
    a link from each to the next (kind 3, one row for each member), links through longer runs (kind 0), and the
    outermost rows of the partition (kinds 1 and 2), whose n-grams are linked through as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part = ["kind", "part", "t", "a", "b"], TaskContext.get().partitionId()
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        runs: list[np.ndarray] = []
        seen: set[int] = set()
        head = carry = None

        def rows(kind: int, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(x), 50_000):
                m = len(x[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, part, np.int32)), pa.array(t[k : k + m]), pa.array(x[k : k + m]), pa.array(y[k : k + m])], names=names)

        def whole(t: np.ndarray, n: np.ndarray, ck: np.ndarray, edge: bool) -> Iterator[pa.RecordBatch]:
            """Rows of whole n-grams; edge: of the partition's first or last one."""
            nonlocal a, b, runs
            if edge:
                a.append(ck[:-1])
                b.append(ck[1:])
                return
            first = np.concatenate([[True], (t[1:] != t[:-1]) | (den * n[:-1] < num * n[1:])])
            at = np.flatnonzero(first)
            lens = np.diff(at, append=len(t))
            owner = np.repeat(np.arange(len(at)), lens)
            long = np.flatnonzero((lens[owner] > RUN) & ~first)
            a.append(ck[long - 1])
            b.append(ck[long])
            with np.errstate(over="ignore"):
                key = mix64(np.add.reduceat(mix64(ck.view(np.uint64)), at)).view(np.int64)
            good = [i for i, k in zip(np.flatnonzero((lens > 1) & (lens <= RUN)).tolist(), key[(lens > 1) & (lens <= RUN)].tolist(), strict=True) if k not in seen and not seen.add(k)]
            pick = np.zeros(len(at), bool)
            pick[good] = True
            keep = pick[owner]
            yield from rows(3, key[owner[keep]], ck[keep], ck[keep])
            if len(seen) > 500_000:
                seen.clear()
            if sum(map(len, a)) > 2_000_000:
                x, y = local_forest(np.concatenate(a), np.concatenate(b))
                a, b = [x], [y]
                if len(x) > 1_000_000:
                    yield from rows(0, np.zeros(len(x), np.int64), x, y)
                    a, b = [], []

        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not len(now[0]):
                continue
            if carry is not None:
                now = [np.concatenate([c, x]) for c, x in zip(carry, now, strict=True)]
            t = now[0]
            begin = int(np.searchsorted(t, t[-1]))
            if head is None and begin:
                head = int(np.searchsorted(t, t[0], "right"))
                yield from rows(1, t[:1], now[2][:1], now[2][:1])
                yield from whole(*(x[:head] for x in now), True)
                if head < begin:
                    yield from whole(*(x[head:begin] for x in now), False)
            elif begin:
                yield from whole(*(x[:begin] for x in now), False)
            carry = [x[begin:].copy() for x in now]
        if carry is not None:
            if head is None:
                yield from rows(1, carry[0][:1], carry[2][:1], carry[2][:1])
            yield from rows(2, carry[0][-1:], carry[2][-1:], carry[2][-1:])
            yield from whole(*carry, True)
        if a:
            x, y = local_forest(np.concatenate(a), np.concatenate(b))
            yield from rows(0, np.zeros(len(x), np.int64), x, y)

    return run


def _rows(fine: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate(fine[at]).reshape(len(at), FINE)


def _bounded(num: int, den: int):
    """From rows (run, size, class, bins) by run and size: links of pairs whose overlap may be large enough. It is
    at most the sum over all bins of what both hold, which unrelated sets of one size don't reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        carry = None

        def whole(r: np.ndarray, n: np.ndarray, ck: np.ndarray, fine: np.ndarray) -> None:
            bins = np.array([h if len(h) == BINS else h.reshape(-1, BINS).sum(axis=0) for h in fine], np.uint32).reshape(-1, BINS)
            for lag in range(1, len(r)):
                i = np.flatnonzero(r[lag:] == r[:-lag])
                if not len(i):
                    break
                j = i + lag
                fit = (den * n[i] >= num * n[j]) & (ck[i] != ck[j])
                i, j = i[fit], j[fit]
                for k in range(0, len(i), 50_000):
                    x, y = i[k : k + 50_000], j[k : k + 50_000]
                    most = np.minimum(bins[x], bins[y]).sum(axis=1, dtype=np.int64)
                    ok = most >= least_overlap(n[x] + n[y], num, den)
                    both = np.flatnonzero(ok & (n[x] > LONG) & (n[y] > LONG))
                    for c in range(0, len(both), 4096):
                        pair = both[c : c + 4096]
                        most = np.minimum(_rows(fine, x[pair]), _rows(fine, y[pair])).sum(axis=1, dtype=np.int64)
                        ok[pair] = most >= least_overlap(n[x[pair]] + n[y[pair]], num, den)
                    # Bins are 16 bits wide; a set that may overflow one isn't bounded.
                    ok |= (n[x] > 65_000) | (n[y] > 65_000)
                    a.append(ck[x[ok]])
                    b.append(ck[y[ok]])

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 5_000):
                part = whole_batch.slice(at, 5_000)
                bins = np.empty(part.num_rows, object)
                bins[:] = [np.frombuffer(h, "<u2") for h in part.column(3).to_pylist()]
                now = [*(part.column(k).to_numpy(zero_copy_only=False) for k in range(3)), bins]
                if carry is not None:
                    now = [np.concatenate([c, x]) for c, x in zip(carry, now, strict=True)]
                begin = int(np.searchsorted(now[0], now[0][-1]))
                whole(*(x[:begin] for x in now))
                carry = [x[begin:].copy() for x in now]
        if carry is not None:
            whole(*carry)
        if a:
            x, y = local_forest(np.concatenate(a), np.concatenate(b))
            for k in range(0, len(x), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]), pa.array(y[k : k + 50_000])], names=["a", "b"])

    return run


def _candidates(first: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links whose connected components hold every pair of classes that can link. Ranges of (n-gram, size,
    class) are dealt out, so an n-gram that many classes share is spread; the ends of the ranges, two rows for
    each, are linked on the driver."""
    order = ["t", "n", "ck"]
    tokens = first.select(F.explode("first").alias("t"), "n", "ck").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(tokens.mapInArrow(slim(_chained(num, den)), "kind int, part int, t long, a long, b long"), "chains")
    ends = sorted((r.part, r.kind, r.t, r.a) for r in rows.filter("kind IN (1, 2)").collect())
    seams = [(x[3], y[3]) for x, y in zip(ends, ends[1:], strict=False) if x[1] == 2 and y[1] == 1 and x[2] == y[2] and x[3] != y[3]]
    links = rows.filter("kind = 0").select("a", "b")
    runs = rows.filter("kind = 3").select(F.col("t").alias("run"), F.col("a").alias("ck"))
    known = runs.join(first.select("ck", "n", "bins").hint("merge"), "ck").select("run", "n", "ck", "bins")
    links = links.unionByName(known.repartition("run").sortWithinPartitions("run", "n", "ck").mapInArrow(slim(_bounded(num, den)), "a long, b long"))
    return links.unionByName(rows.sparkSession.createDataFrame(seams, "a long, b long")) if seams else links


class Tree:
    """A prefix tree of sets: their sequences in sorted order and the lengths of common prefixes."""

    def __init__(self, sets: list[np.ndarray], queries: list[np.ndarray]):
        both = np.concatenate([*sets, *queries])
        ids, inv, count = np.unique(both, return_inverse=True, return_counts=True)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(ids))  # what many sets share comes first
        seq = rank[inv]
        cut = np.cumsum([len(s) for s in (*sets, *queries)])[:-1]
        seqs = [np.sort(s) for s in np.split(seq, cut)]
        self.seqs, self.queries = seqs[: len(sets)], seqs[len(sets) :]
        self.order = sorted(range(len(sets)), key=lambda i: self.seqs[i].astype(">u4").tobytes())
        self.seqs = [self.seqs[i] for i in self.order]
        self.lens = np.array([len(s) for s in self.seqs])
        self.lcp = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            m = min(self.lens[i - 1], self.lens[i])
            ne = np.flatnonzero(self.seqs[i - 1][:m] != self.seqs[i][:m])
            self.lcp[i] = ne[0] if len(ne) else m
        self.size = np.array([len(q) for q in self.queries])
        self.start = np.cumsum(self.size) - self.size
        self.span = len(ids) + 1
        flat = np.concatenate(self.queries) if self.queries else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(self.queries)), self.size)
        self.keyed = who * self.span + flat  # sorted: who, then rank
        by = np.argsort(flat, kind="stable")
        self.posted, self.posts = who[by], np.searchsorted(flat[by], np.arange(len(ids) + 1))

    def overlap(self, label: np.ndarray, active: np.ndarray) -> np.ndarray:
        """How many n-grams of label each active query holds."""
        lens = self.posts[label + 1] - self.posts[label]
        total = int(lens.sum())
        if total > 8 * len(active) * len(label):
            key = (active[:, None] * self.span + label[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.keyed, key), len(self.keyed) - 1)
            return (self.keyed[at] == key).reshape(len(active), len(label)).sum(axis=1)
        ends = np.cumsum(lens)
        got = self.posted[np.arange(total) + np.repeat(self.posts[label] - (ends - lens), lens)]
        return np.bincount(got, minlength=len(self.queries))[active]

    def join(self, stored: np.ndarray, asked: np.ndarray, num: int, den: int, same: bool) -> np.ndarray:
        """Component labels after every link of a stored set with a query: stored and asked are the labels
        before, equal for sets that are linked (or one) already. With same, queries are the stored sets."""
        label = np.concatenate([stored[self.order], asked if not same else np.zeros(0, np.int64)])
        m = len(self.seqs)
        # same: query k is stored set order.index(k)
        place = np.argsort(self.order) if same else np.arange(len(self.queries)) + m
        every = np.arange(len(self.queries))
        stack = [(0, m, 0, every, np.zeros(len(every), np.int64))] if m and len(every) else []
        while stack:
            lo, hi, depth, active, got = stack.pop()
            here = label[lo:hi]
            if here[0] == here[-1] and (here == here[0]).all():  # all below are linked: so are queries with their label
                keep = label[place[active]] != here[0]
                active, got = active[keep], got[keep]
            if not len(active):
                continue
            to = int(self.lens[lo]) if hi - lo == 1 else int(min(self.lcp[lo + 1 : hi].min(), self.lens[lo]))
            path = self.seqs[lo][depth:to]
            if len(path):
                got = got + self.overlap(path, active)
                left = self.start[active] + self.size[active] - np.searchsorted(self.keyed, active * self.span + path[-1], "right")
                small, large = int(self.lens[lo:hi].min()), int(self.lens[lo:hi].max())
                keep = got + np.minimum(large - to, left) >= least_overlap(self.size[active] + small, num, den)
                active, got = active[keep], got[keep]
                if not len(active):
                    continue
            child = lo
            if self.lens[lo] == to:
                hit = active[got >= least_overlap(self.size[active] + to, num, den)]
                if len(hit):
                    old = np.unique(np.append(label[place[hit]], label[lo]))
                    if len(old) > 1:
                        label[np.isin(label, old)] = old[0]
                child = lo + 1
            if child < hi:
                cuts = [child, *(child + 1 + np.flatnonzero(self.lcp[child + 1 : hi] == to)).tolist(), hi]
                stack += [(a, b, to, active, got) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if same:
            out = np.empty(m, np.int64)
            out[self.order] = label
            return out
        out = np.empty(len(label), np.int64)
        out[self.order] = label[:m]
        out[m:] = label[m:]
        return out


def _sets(n: int, table):
    """(class, component, bin, block, label, role, set) of the classes' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(table.value, np.uint8)
        names = ["ck", "comp", "bin", "block", "grams"]
        for b in batches:
            col = {c: b.column(c).to_pylist() for c in ("ck", "comp", "bin", "blocks", "pivot")}
            for lo, _, data, off in text_chunks(b.column("text")):
                rows = []
                for i, s in enumerate(shingle_sets(data, off, n), lo):
                    if class_key(s) != col["ck"][i]:
                        continue  # another text under the same id
                    raw = _ordered(s, level).tobytes()
                    for block in range(col["blocks"][i]) if col["pivot"][i] else [col["ck"][i] % col["blocks"][i]]:
                        rows.append((col["ck"][i], col["comp"][i], col["bin"][i], block, raw))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    return run


def _unpack(t: pa.Table, rows: np.ndarray) -> list[np.ndarray]:
    column = t.column("grams")
    return [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in rows]


_EDGES = "a long, b long"


def _within(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        ck, comp = t.column("ck").to_numpy(), t.column("comp").to_numpy()
        _, keep = np.unique(ck, return_index=True)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = keep[np.argsort(comp[keep], kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            if len(rows) < 2:
                continue
            sets = _unpack(t, rows)
            label = Tree(sets, sets).join(np.arange(len(rows)), np.arange(len(rows)), num, den, True)
            moved = np.flatnonzero(label != np.arange(len(rows)))
            a.append(ck[rows[moved]])
            b.append(ck[rows[label[moved]]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _across(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        ck, label, probe = (t.column(c).to_numpy(zero_copy_only=False) for c in ("ck", "label", "probe"))
        rows = [np.flatnonzero(probe == p) for p in (False, True)]
        rows = [r[np.unique(ck[r], return_index=True)[1]] for r in rows]
        out = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}
        if len(rows[0]) and len(rows[1]):
            names, inv = np.unique(label[np.concatenate(rows)], return_inverse=True)
            m = len(rows[0])
            after = Tree(_unpack(t, rows[0]), _unpack(t, rows[1])).join(inv[:m], inv[m:], num, den, False)
            moved = np.flatnonzero(after != inv)
            out = {"a": names[inv[moved]], "b": names[after[moved]]}
        return pa.table(out)

    return run


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(key, h, n_shingles, component_id, component) of every row: the size of its n-gram set and the smallest
    key that links (Jaccard similarity of num / den or more) lead to, its own included; h is a hash of the text,
    component a number of all rows that are linked (null where component_id is the row's own for want of words)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))
    table = spark.sparkContext.broadcast(levels(docs.select("text"), n).tobytes())
    rows = staged(docs.mapInArrow(slim(_signed(n, num, den, table)), "id long, h long, n long, ck long, first array<long>, bins binary"), "ngram-rows")
    live = rows.filter("ck IS NOT NULL AND id IS NOT NULL")
    classes = staged(live.groupBy("ck").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")), "ngram-classes")
    first = staged(live.select("ck", "n", "first", "bins").dropDuplicates(["ck"]), "ngram-first")
    # Staged, so that no task holds two workers at once: each executor would keep them all.
    found = components(staged(_candidates(first, num, den), "ngram-candidates"))
    members = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()).select(F.col("id").alias("ck"), F.col("component").alias("comp"))
    members = staged(classes.join(members.hint("merge"), "ck"), "ngram-members")
    info = members.groupBy("comp").agg(F.sum("n").alias("tokens"), F.max_by("ck", F.struct("copies", "ck")).alias("top"))
    info = staged(info.withColumn("blocks", F.ceil(F.col("tokens") / GROUP_TOKENS)).drop("tokens"), "ngram-groups")
    bins = max(1, members.agg(F.sum("n")).head()[0] // GROUP_TOKENS if members.head(1) else 1)
    members = join_heavy(members, info, "comp").withColumn("pivot", (F.col("ck") == F.col("top")) & (F.col("blocks") > 1))
    # Small components share a group; a large one has groups of its own, one for each block.
    members = members.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.col("comp")))
    members = staged(members.select(F.col("rep").alias("id"), "ck", "comp", "bin", "blocks", "pivot", "n"), "ngram-members")
    texts = join_checked(docs.select("id", "text"), members.drop("n"), "id", limit=300_000)
    sets = staged(texts.mapInArrow(slim(_sets(n, table)), "ck long, comp long, bin long, block long, grams binary"), "ngram-sets")
    edges = staged(sets.groupBy("bin", "block").applyInArrow(slim_group(_within(num, den)), _EDGES), "ngram-links")
    roots = components(edges)
    roots, edges = _finish(members, sets, edges, roots, num, den)
    per = classes.join(roots.withColumnRenamed("id", "ck").hint("merge"), "ck", "left").select("ck", "rep", F.coalesce("component", "ck").alias("component"))
    per = staged(per, "ngram-components")
    lowest = staged(per.groupBy("component").agg(F.min("rep").alias("component_id")), "ngram-lowest")
    per = staged(join_heavy(per, lowest, "component").select("ck", "component", "component_id"), "ngram-results")
    out = join_heavy(live.select("id", "h", "n", "ck"), per, "ck").select("id", "h", "n", "component_id", "component")
    rest = rows.filter("ck IS NULL OR id IS NULL").select("id", "h", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return out.unionByName(rest).select(F.col("id").alias(key), "h", F.col("n").alias("n_shingles"), "component_id", "component")


def _finish(members: DataFrame, sets: DataFrame, edges: DataFrame, roots: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links between blocks of large candidate components: classes outside a component's largest linked
    group meet the sets of all blocks."""
    large = members.filter("blocks > 1").select("ck", "comp", "blocks", "n")
    if not large.head(1):
        return roots, edges
    large = staged(large.join(roots.withColumnRenamed("id", "ck").hint("merge"), "ck", "left").withColumn("label", F.coalesce("component", "ck")).drop("component"), "ngram-labels")
    groups = large.groupBy("comp", "label").agg(F.count("*").alias("m"))
    main = groups.groupBy("comp").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    main = staged(main, "ngram-main")
    if not main.head(1):
        return roots, edges
    open_ = staged(join_heavy(large, main, "comp"), "ngram-open")
    slices = open_.filter("label <> main").groupBy("comp").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("slices"))
    open_ = staged(join_heavy(open_, staged(slices, "ngram-slices"), "comp").select("ck", "blocks", "slices", "label", (F.col("label") != F.col("main")).alias("outside")), "ngram-open")
    full = sets.dropDuplicates(["ck"]).join(open_.hint("merge"), "ck")
    block, piece = F.pmod("ck", "blocks"), F.pmod(F.xxhash64("ck"), F.col("slices"))
    base = full.select("ck", "comp", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "label", F.lit(False).alias("probe"), "grams")
    probes = full.filter("outside").select("ck", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), piece.alias("slice"), "label", F.lit(True).alias("probe"), "grams")
    more = staged(base.unionByName(probes).groupBy("comp", "block", "slice").applyInArrow(slim_group(_across(num, den)), _EDGES), "ngram-across")
    edges = edges.unionByName(more)
    return components(edges), edges


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of linked documents: that with the smallest key (of rows equal in key,
    the one whose text has the smallest hash). Rows with a null key or an empty set link with nothing and stay;
    rows that share a key, but aren't linked, stay too. Columns of docs can have any names."""
    found = staged(ngram_components(docs, key, text, n, num, den), "ngram-found")
    firsts = found.filter(F.col("component").isNotNull() & (F.col(key) == F.col("component_id"))).groupBy("component", "h").agg(F.first(key).alias("id"), F.count("*").alias("same"))
    kept = staged(firsts.groupBy("component").agg(F.min(F.struct("h", "id", "same")).alias("k")).select(F.col("k.id").alias("kept_id"), F.col("k.h").alias("kept_h"), "k.same"), "ngram-kept")
    rest = staged(found.filter(F.col("component").isNull()).select(F.col(key).alias("kept_id"), F.col("h").alias("kept_h")).distinct(), "ngram-alone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("kept_id"), F.xxhash64(text).alias("h"))
    one = join_checked(rows, kept, "kept_id", limit=500_000).filter("h = kept_h")
    out = one.filter("same = 1").unionByName(one.filter("same > 1").dropDuplicates(["kept_id", "h"])).select("row.*")
    if rest.head(1):
        rest = rest.withColumnRenamed("kept_id", "id2")
        out = out.unionByName(rows.join(rest.hint("merge"), F.col("kept_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("kept_h")), "left_semi").select("row.*"))
    return out

"""A hashed maximum-entropy language model.

The vocabulary is a tree of classes: its leaves are the KNOWN most frequent words and CELLS cells of all other
words (by their first letters and a hash), every inner node has up to FAN classes of about equal mass. The
probability of a token is the product, from the root down, of the softmax over a node's classes, whose weights
are sums over the features of the context: bias, the last word, the last two, and skip features (second and
third last word alone, last with third last). A weight row belongs to a feature and a node, hashed into a table.
In a cell, the corpus counts over all training documents give the probability (with one unseen word in each),
so the model is normalised over the whole vocabulary.

Training is data-parallel: in each round, workers start from the same weights, take gradient steps over their
documents of that round, and the changes of a weight row are averaged over the workers that met it, in a tree
of sums over blocks of rows. Documents are dealt to workers and ordered by a hash of their content, so that a
model depends on the rows alone, not on files or partitions (scores agree to rounding of sums). Scoring is done
in numpy batches. Counts of rare words are joined, not broadcast.

What grows with the corpus: counts of all words, workers, and weight rows, one for every two tokens from
2**MIN_BITS to 2**MAX_BITS rows; beyond that, contexts share rows, since each worker holds the table.

Contract: null texts count as empty: one end token. Text is lower-cased in A-Z; tokens are the words
[^\\x20\\x09-\\x0D]+ and one end. Null ids belong to bucket 0. A repeated row is scored (and learned from)
again. Without training documents the base score of every token is log10(1). Words are known by 64-bit hashes.
An empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import mix64, staged, text_chunks, word_hashes, word_spans
from lodestone.llm.toxicity import bucket

#: Classes of a node of the vocabulary's tree, and the cells of rare words: by letters times by a hash.
FAN, LETTERS, CELLS = 16, 16, 4096
#: Words that are leaves of their own, whose counts every scorer holds; other words meet their counts in a join.
KNOWN = 200_000
#: Bounds of the hashed weight rows (as powers of two), each with FAN weights.
MIN_BITS, MAX_BITS = 16, 20
#: A row moves by STEP / (uses in the batch + DAMP + HOLD * uses before) times the sum of its gradients.
ROUNDS, STEP, DAMP, HOLD, BATCH = 2, 1.0, 8.0, 0.1, 4096
#: Tokens of a worker in a round, as a multiple of the weight rows (every worker sends its changes once a
#: round); weight rows of a block; workers summed at once.
WORKER_TOKENS, BLOCK, JOINT = 6, 2048, 32
_M = np.uint64
END, START = _M(0x5851F42D4C957F2D), _M(0x14057B7EF767814F)
_SALT = [_M(x) for x in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_LIMIT = np.float32(60)
_ONES = np.ones(FAN, np.float32)
#: Weight rows that one step works on: they stay in the processor's nearest caches.
NEAR = 2048


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and cells of all tokens, and offsets of each text's tokens; each text ends with END."""
    h, at = word_hashes(data, offsets)
    starts, ends, _ = word_spans(data, offsets)
    first = data[starts].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    second = np.where(ends - starts > 1, data[np.minimum(starts + 1, max(0, len(data) - 1))], 0) if len(starts) else first
    low = lambda c: np.where((c >= 65) & (c <= 90), c + 32, c)
    letters = (low(first) * 31 + low(second.astype(np.int64)) * 17) % LETTERS
    cell = letters * (CELLS // LETTERS) + (mix64(h) % _M(CELLS // LETTERS)).astype(np.int64)
    return np.insert(h, at[1:], END), np.insert(cell, at[1:], 0), at + np.arange(len(at))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def distinct(w: np.ndarray, c: np.ndarray | None, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Sorted by their first bits, with the position in the last ones. Two words that are alike in the first bits may leave
        # several rows of one word, which are summed later.
        bits = _M(max(1, (len(w) - 1).bit_length()))
        key = (w >> bits << bits) | np.arange(len(w), dtype=np.uint64)
        key.sort()
        order = (key & ((_M(1) << bits) - _M(1))).view(np.int64)
        w = w[order]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, int)
        sums = np.diff(first, append=len(w)) if c is None else np.add.reduceat(c[order], first) if len(w) else c
        return w[first], sums, t[order[first]]

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def rows() -> Iterator[pa.RecordBatch]:
        w, c, t = held[0]
        for i in range(0, len(w), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (w.view(np.int64), c, t)], names=["w", "c", "cell"])

    for b in batches:
        for _, _, data, off in text_chunks(b.column(0)):
            h, cell, _ = tokens(data, off)
            held.append(distinct(h, None, cell))
            size += len(held[-1][0])
            if size > 3_000_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield from rows()
                    held, size = [], 0
    if held:
        held[:] = [merged()]
        yield from rows()


def word_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(w, c, cell) of every token of all training texts."""
    got = train.select(text).mapInArrow(_counted, "w long, c long, cell long")
    return got.groupBy("w").agg(F.sum("c").alias("c"), F.min("cell").alias("cell"))


def class_tree(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths of leaves with these masses, in their order: offsets, and the nodes and classes on each path; and
    each node's share of mass in every class. A node's leaves are cut into FAN runs of about equal mass."""
    leaves = len(mass)
    cum = np.concatenate([[0.0], np.cumsum(mass)])
    low, high = np.array([0]), np.array([leaves])
    leaf, node, cls, shares, made = [], [], [], [], 0
    while len(low):
        size = high - low
        own = np.repeat(np.arange(len(low)), size)
        at = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
        total = cum[high] - cum[low]
        place = (cum[at] + mass[at] / 2 - cum[low][own]) / total[own]
        c = np.minimum((place * FAN).astype(np.int64), FAN - 1)
        # What fits into two levels keeps its first leaves here; the others go into as few runs as hold them.
        runs = np.maximum(0, -(-(size - FAN) // (FAN - 1)))
        alone, nth = (np.minimum(size, FAN) - runs)[own], at - low[own]
        flat = np.where(nth < alone, nth, alone + (nth - alone) * runs[own] // np.maximum(size[own] - alone, 1))
        c = np.where(size[own] <= FAN * FAN, flat, c)
        leaf.append(at)
        node.append(made + own)
        cls.append(c)
        shares.append(np.bincount(own * FAN + c, weights=mass[at], minlength=len(low) * FAN).reshape(-1, FAN) / total[:, None])
        made += len(low)
        run = own * FAN + c
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        last = np.append(first[1:], len(run)) - 1
        more = last > first
        low, high = at[first[more]], at[last[more]] + 1
    leaf, node, cls = np.concatenate(leaf), np.concatenate(node), np.concatenate(cls)
    order = np.argsort(leaf, kind="stable")
    return np.searchsorted(leaf[order], np.arange(leaves + 1)), node[order].astype(np.int32), cls[order].astype(np.int32), np.concatenate(shares)


class Model:
    """Vocabulary and weights; what a worker holds is bounded by KNOWN, CELLS and MAX_BITS."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, types: int, cell_mass: np.ndarray):
        """words: the KNOWN most frequent tokens, most frequent first; cell_mass: summed c + 0.5 of each cell's words."""
        self.total, self.types, self.cell_mass = total, types, cell_mass
        order = np.argsort(words)
        self.words, self.counts, self.rank = words[order], counts[order], order
        #: Where the words of each bucket (the hash's first bits) begin; a last word, above all others, ends every search.
        self.shift = _M(64 - max(1, len(words).bit_length()))
        self.begin = np.searchsorted(self.words, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)
        self.fence = np.append(self.words, _M(2**64 - 1))
        self.path_at, self.path_node, self.path_class, shares = class_tree(np.concatenate([counts + 0.5, cell_mass]))
        self.nodes = len(shares)
        self.bits = min(MAX_BITS, max(MIN_BITS, (total // 2).bit_length() - 1))
        with np.errstate(divide="ignore"):
            bias = np.maximum(np.log(shares), -30)
        #: Bias rows of all nodes, then hashed rows; kept in half precision, used in single.
        self.weights = np.concatenate([bias, np.zeros((1 << self.bits, FAN))]).astype(np.float16)
        self.met: np.ndarray | None = np.zeros(len(self.weights), np.float32)

    def look_up(self, h: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each token, and its count (-1: not among the known words)."""
        if not len(self.words):
            return cell, np.full(len(h), -1)
        at = self.begin[(h >> self.shift).astype(np.int64)].astype(np.int64)
        low = np.flatnonzero(self.fence[at] < h)
        while len(low):
            at[low] += 1
            low = low[self.fence[at[low]] < h[low]]
        at = np.minimum(at, len(self.words) - 1)
        found = self.words[at] == h
        return np.where(found, self.rank[at], len(self.words) + cell), np.where(found, self.counts[at], -1)

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every node on the leaves' paths: position of the leaf, node, class."""
        n = self.path_at[leaf + 1] - self.path_at[leaf]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.path_at[leaf] - ends + n, n)
        return np.repeat(np.arange(len(leaf)), n), self.path_node[at], self.path_class[at]

    def rows(self, features: np.ndarray, token: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Weight rows of (features + bias, tokens' nodes)."""
        out = np.empty((len(features) + 1, len(token)), np.int64)
        out[0] = node
        salt = node.astype(np.uint32) * np.uint32(0x9E3779B1)
        for k, f in enumerate(features):
            x = (f[token] ^ salt) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            out[k + 1] = x >> np.uint32(32 - self.bits)
            out[k + 1] += self.nodes
        return out

    def scorer(self) -> Model:
        """The model without what only training needs."""
        out = object.__new__(Model)
        out.__dict__ |= self.__dict__ | {"met": None}
        return out


def context(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature hashes of each token's context: one row for each feature, the bias left out."""
    since = np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))

    def back(k: int) -> np.ndarray:
        out = np.full(len(h), START)
        out[k:] = np.where(since[k:] >= k, h[:-k], START)
        return out

    a, b, c = back(1), back(2), back(3)
    with np.errstate(over="ignore"):
        features = (a * _SALT[0], a * _SALT[1] + b * _SALT[2], b * _SALT[3], c * _SALT[4], a * _SALT[3] + c * _SALT[0])
        return np.stack([(mix64(f) >> _M(32)).astype(np.uint32) for f in features])


def _table(weights: np.ndarray) -> np.ndarray:
    """Weights in single precision. A row fills a line of the processor's cache, and begins with one."""
    raw = np.empty(weights.size * 4 + 64, np.uint8)
    at = -raw.ctypes.data % 64
    out = raw[at : at + weights.size * 4].view(np.float32).reshape(weights.shape)
    out[:] = weights
    return out


def _whole(table: np.ndarray) -> np.ndarray:
    """The rows of a table as single items: numpy takes and puts these several times faster than rows."""
    return table.view(f"V{table.itemsize * FAN}")[:, 0]


def _take(table: np.ndarray, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.empty((len(rows), FAN), table.dtype) if out is None else out
    np.take(_whole(table), rows, out=_whole(out), mode="clip")
    return out


class _Scratch:
    """Arrays of weight rows that batches use one after another: new ones would cost more than what is done in them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < rows:
            self.held[name] = np.empty((rows + rows // 4, FAN), np.float32)
        return self.held[name][:rows]


def _exp_sums(table: np.ndarray, rows: np.ndarray, scratch: _Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed weights of each instance's classes, their exponentials, and the sums of these."""
    n = rows.shape[1]
    z, e, sums = scratch("z", n), scratch("exp", n), np.empty(n, np.float32)
    for i in range(0, n, NEAR):
        now, part = z[i : i + NEAR], e[i : i + NEAR]
        _take(table, rows[0, i : i + NEAR], now)
        for r in rows[1:]:
            now += _take(table, r[i : i + NEAR], part)
        np.clip(now, -_LIMIT, _LIMIT, out=now)
        np.exp(now, out=part)
        np.matmul(part, _ONES, out=sums[i : i + NEAR])
    return z, e, sums


def log_probability(model: Model, table: np.ndarray, features: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's leaf; table: the model's weights in single precision."""
    out, scratch = np.zeros(len(leaf)), _Scratch()
    for i in range(0, len(leaf), BATCH):
        part = leaf[i : i + BATCH]
        token, node, cls = model.paths(part)
        z, _, sums = _exp_sums(table, model.rows(features[:, i : i + BATCH], token, node), scratch)
        lp = z.ravel()[np.arange(len(cls)) * FAN + cls].astype(np.float64) - np.log(sums.astype(np.float64))
        out[i : i + BATCH] = np.bincount(token, weights=lp, minlength=len(part)) / math.log(10)
    return out


def _wide(x: np.ndarray) -> np.ndarray:
    return np.repeat(x.astype(np.float32), FAN).reshape(-1, FAN)


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (features, instances): the distinct ones in order, where each begins in the sorted rows and how often
    it occurs, and the instance of every sorted row."""
    n = rows.shape[1]
    bits = _M(max(1, (n - 1).bit_length()))
    key = rows.astype(np.uint64)
    key <<= bits
    key |= np.arange(n, dtype=np.uint64)
    key = key.ravel()
    key.sort()
    row, at = (key >> bits).view(np.int64), (key & ((_M(1) << bits) - _M(1))).view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return row[first], first, np.diff(first, append=len(row)), at


def _sums(g: np.ndarray, begin: np.ndarray, left: np.ndarray, at: np.ndarray, scratch: _Scratch) -> np.ndarray:
    """The sum of g over the instances at[begin : begin + left] of each row; rows come by falling left, all above 1."""
    held = _take(g, at[begin], scratch("held", len(begin)))
    for k in range(1, 6):  # most rows have few instances: these are added one by one, for all rows at once
        m = np.searchsorted(-left, -k)
        held[:m] += _take(g, at[begin[:m] + k], scratch("part", m))
    m = np.searchsorted(-left, -6)
    if m:
        more = left[:m] - 6
        ends = np.cumsum(more)
        rest = np.arange(ends[-1]) + np.repeat(begin[:m] + 6 - ends + more, more)
        held[:m] += np.add.reduceat(_take(g, at[rest], scratch("part", len(rest))), ends - more, axis=0)
    return held


def learn(model: Model, table: np.ndarray, met: np.ndarray, h: np.ndarray, cell: np.ndarray, offsets: np.ndarray, step: float = STEP) -> None:
    """Gradient steps over batches of tokens: table and met (uses of each row) change."""
    leaf, _ = model.look_up(h, cell)
    features, scratch = context(h, offsets), _Scratch()
    for i in range(0, len(h), BATCH):
        token, node, cls = model.paths(leaf[i : i + BATCH])
        rows = model.rows(features[:, i : i + BATCH], token, node)
        _, g, sums = _exp_sums(table, rows, scratch)
        g *= _wide(1 / sums)
        g.ravel()[np.arange(len(cls)) * FAN + cls] -= 1
        row, first, count, at = _grouped(rows)
        before = met[row]
        met[row] = before + count
        rate = (step / (count + DAMP + HOLD * before)).astype(np.float32)[:, None]
        one, many = np.flatnonzero(count == 1), np.flatnonzero(count > 1)
        many = many[np.argsort(-count[many], kind="stable")]
        held = _sums(g, first[many], count[many], at, scratch)
        for rows_at, change in ((one, None), (many, held)):
            for k in range(0, len(rows_at), NEAR):
                pick = rows_at[k : k + NEAR]
                move = _take(g, at[first[pick]], scratch("move", len(pick))) if change is None else change[k : k + NEAR]
                move *= rate[pick]
                own = _take(table, row[pick], scratch("own", len(pick)))
                own -= move
                np.put(_whole(table), row[pick], _whole(own), mode="clip")


_CHANGES = "block int, part int, change binary, scale binary, met binary"


def _packed(block: int, part: int, change: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    """A block of changes, each row as FAN signed bytes and a scale, and the uses of the rows."""
    scale = (np.abs(change).max(axis=1) / 127).astype(np.float32)
    small = np.rint(change / np.maximum(scale, 1e-30)[:, None]).astype(np.int8)
    raw = [pa.array([x.tobytes()], pa.binary()) for x in (small, scale, met.astype(np.float32))]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), *raw], names=["block", "part", "change", "scale", "met"])


def _unpacked(change: bytes, scale: bytes, met: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(change, np.int8).reshape(-1, FAN) * np.frombuffer(scale, np.float32)[:, None], np.frombuffer(met, np.float32)


def _worker(shared):
    """Changes of the weights and the uses of their rows, in blocks of rows, of one worker's documents."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        table, met = _table(model.weights), model.met.copy()
        for b in batches:
            for _, _, data, off in text_chunks(b.column(0)):
                learn(model, table, met, *tokens(data, off))
        for k in range(0, len(table), BLOCK):
            uses = met[k : k + BLOCK] - model.met[k : k + BLOCK]
            if uses.any():
                yield _packed(k // BLOCK, key[0].as_py(), table[k : k + BLOCK] - model.weights[k : k + BLOCK], uses)

    return run


def _averaged(t: pa.Table) -> pa.Table:
    """Changes of one block, averaged by uses; always summed in the order of the parts."""
    t = t.sort_by("part")
    total, uses = 0.0, 0.0
    for raw in zip(*(t.column(c).to_pylist() for c in ("change", "scale", "met")), strict=True):
        change, met = _unpacked(*raw)
        met = met.astype(np.float64)
        total, uses = total + change * met[:, None], uses + met
    return pa.Table.from_batches([_packed(t.column("block")[0].as_py(), t.column("part")[0].as_py() // JOINT, total / np.maximum(uses, 1)[:, None], uses)])


def vocabulary(counts: DataFrame) -> Model:
    """An untrained model of (w, c, cell) counts: weights give the corpus frequencies."""
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    # Words are taken down to a count (on a logarithmic scale), so that KNOWN rows at most come to the driver.
    level = F.floor(F.ln("c") * 64)
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    cut, held = math.inf, 0
    for at, n in sizes:
        held += n
        if held > KNOWN:
            break
        cut = at
    top = counts.filter(level >= F.lit(float(cut))).toPandas().sort_values(["c", "w"], ascending=[False, True])
    words, c, cell = top["w"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), top["cell"].to_numpy(np.int64)
    mass = np.full(CELLS, 0.5)
    for r in counts.groupBy("cell").agg((F.sum("c") + 0.5 * F.count("*")).alias("m")).collect():
        mass[r.cell] += r.m
    np.subtract.at(mass, cell, c + 0.5)
    return Model(words, c, int(total), int(types), mass)


def train(docs: DataFrame, counts: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> Model:
    """A model trained on all texts of docs: each takes part in one round. Rows are dealt to workers, and
    ordered, by a hash of key and text."""
    sc = docs.sparkSession.sparkContext
    model = vocabulary(counts)
    workers = max(2, -(-model.total // (rounds * WORKER_TOKENS << model.bits)))
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    rows = rows.select("text", "h", F.pmod("h", F.lit(rounds)).alias("round"), F.pmod(F.shiftright("h", 8), F.lit(workers)).cast("int").alias("worker"))
    for r in range(rounds):
        shared = sc.broadcast(model)
        part = rows.filter(F.col("round") == r).select("text", "h", "worker").repartitionByRange(workers, "worker").sortWithinPartitions("worker", "h", "text")
        found = part.groupBy("worker").applyInArrow(_worker(shared), _CHANGES)
        n = workers
        while True:
            found = found.groupBy("block", F.floor(F.col("part") / JOINT)).applyInArrow(_averaged, _CHANGES)
            n = -(-n // JOINT)
            if n == 1:
                break
        model = model.scorer()
        model.weights, model.met = model.weights.copy(), shared.value.met.copy()
        for row in found.toLocalIterator():
            k = row.block * BLOCK
            change, met = _unpacked(row.change, row.scale, row.met)
            model.weights[k : k + BLOCK] += change.astype(np.float16)
            model.met[k : k + BLOCK] += met
        shared.unpersist()
    return model.scorer()


def _scored(shared):
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times", "mass"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        table = _table(model.weights)
        below, rid = model.total + 0.5 * (model.types + 1), TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(2)):
                h, cell, at = tokens(data, off)
                leaf, count = model.look_up(h, cell)
                lp = log_probability(model, table, context(h, at), leaf)
                known = count >= 0
                base = np.where(known, np.log10((np.maximum(count, 0) + 0.5) / below), 0.0)
                start = at[:-1]
                sums = [np.add.reduceat(x, start) for x in (known.astype(np.int64), base, lp)]
                words, times, mass, ends = [], [], [], [0]
                far = np.flatnonzero(~known)
                cut = np.searchsorted(far, at)
                for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    w, pick, n = np.unique(h[far[i:j]], return_index=True, return_counts=True)
                    words.append(w.view(np.int64))
                    times.append(n)
                    mass.append(model.cell_mass[cell[far[i:j]][pick]])
                    ends.append(ends[-1] + len(w))
                ends = pa.array(np.array(ends, np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (words, times, mass)]
                m = hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(rid + np.arange(m)), batch.column(0).slice(lo, m), batch.column(1).slice(lo, m), pa.array(np.diff(at)), *map(pa.array, sums), *lists], names=names)
                rid += m

    return run


def scored(docs: DataFrame, held: int = 1, modulus: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs; rows whose
    bucket is held aren't learned from."""
    rows = docs.select(F.col(key).alias("doc_id"), (bucket(modulus, key) == held).alias("held_out"), F.col(text).alias("text"))
    train_rows = rows.filter(~F.col("held_out"))
    counts = staged(word_counts(train_rows), "word-counts")
    model = train(train_rows, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<long>, times array<long>, mass array<double>"
    near = staged(rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_scored(shared), schema), "lm-rows")
    far = near.select("rid", F.explode(F.arrays_zip("words", "times", "mass")).alias("z")).select("rid", F.col("z.words").alias("w"), F.col("z.times").alias("n"), F.col("z.mass").alias("mass"))
    far = far.join(counts.select("w", "c").hint("merge"), "w", "left")
    c = F.coalesce("c", F.lit(0)) + 0.5
    below = float(model.total + 0.5 * (model.types + 1))
    far = far.groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("k2"), F.sum(F.col("n") * F.log10(c / below)).alias("b2"), F.sum(F.col("n") * F.log10(c / F.col("mass"))).alias("s2"))
    out = near.drop("words", "times", "mass").join(far.hint("merge"), "rid", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    return out.select(F.col("doc_id").alias(key), "held_out", "n_tokens", plus("n_known", "k2", 0).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base", "b2", 0.0).alias("base_score"), plus("score", "s2", 0.0).alias("score"))

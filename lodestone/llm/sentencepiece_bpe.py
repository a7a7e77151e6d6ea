"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All new words of a chunk of texts lie in one flat numpy symbol array. A round finds each word's lowest pair
rank (a segmented minimum), merges that pair's leftmost non-overlapping occurrences in all words at once,
compacts the array, and looks up only the pairs that changed; words without a pair left leave the array.
A stretch of more than LONG symbols that pieces can span takes a heap of its pairs instead, since rounds could
be as many as its symbols: its time is n log n.

Contract: null texts count as empty and encode to the end id alone (or to nothing without it). Texts of any
length are whole; rows are independent, so repeated rows give repeated results and an empty table gives none.
Columns other than the text are passed through untouched, but for names that the outputs take.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import CHUNK_BYTES, slim

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.iinfo(np.int64).max
#: Words kept between chunks of a task; beyond it the table starts anew. A word takes about 600 bytes, and most words
#: beyond the frequent ones never come again.
TABLE_WORDS = 80_000
#: Symbols of a word that merge rounds take.
LONG = 512


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return n, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) pairs of a serialised protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if key & 7 == 2 else ((8, i) if key & 7 == 1 else (4, i))
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class Model:
    """Merge tables of a BPE model file. Only models with identity normalisation, which keep all white
    space and have byte fallback and no user-defined or unused pieces, are taken."""

    def __init__(self, serialized: bytes):
        pieces, kinds, scores, norm, trainer = [], [], [], {}, {}
        for f, v in _fields(serialized):
            if f == 1:
                q = dict(_fields(v))
                pieces.append(q[1].decode())
                scores.append(struct.unpack("<f", q[2])[0] if 2 in q else 0.0)
                kinds.append(q.get(3, NORMAL))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                norm = dict(_fields(v))
        if trainer.get(3) != 2 or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1) or not trainer.get(35) or {USER, UNUSED} & set(kinds):
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and byte fallback are supported")
        self.size = n = len(pieces)
        self.kinds = kinds
        self.end = next((i for i, p in enumerate(pieces) if p == "</s>" and kinds[i] == CONTROL), None)
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        self.base = n + 0x110000
        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(pieces):
            if kinds[i] == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        _, inv = np.unique(-np.asarray(scores, np.float32), return_inverse=True)
        sym = lambda s: self.ids.get(s, n + ord(s) if len(s) == 1 else None)
        keys, rank, merged, inside, one_word = [], [], [], set(), True
        for p, i in self.ids.items():
            inside.update((ord(a) << 21) | ord(b) for a, b in zip(p, p[1:], strict=False))
            one_word &= SPACE not in p.lstrip(SPACE)
            for k in range(1, len(p)):
                a, b = sym(p[:k]), sym(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    rank.append(inv[i])
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.rank, self.merged = (np.array(x, np.int64)[order] for x in (keys, rank, merged))
        self.inside = np.array(sorted(inside), np.int64)
        # A piece is calm if no pair with it outranks or ties the merge that made it: then all its leftmost merges can be done at once.
        best = np.full(self.base, _NONE)
        np.minimum.at(best, self.keys // self.base, self.rank)
        np.minimum.at(best, self.keys % self.base, self.rank)
        self.calm = best[:n] > inv
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if one_word else re.compile("(?s).+")
        char = np.arange(self.base - n) + n
        for p, i in self.ids.items():
            if len(p) == 1:
                char[ord(p)] = i
        self.char = char
        surface = [b"" if kinds[i] == CONTROL else " ⁇ ".encode() if kinds[i] == UNKNOWN else bytes([int(p[3:5], 16)]) if kinds[i] == BYTE else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.leads = np.array([kinds[i] == NORMAL and p[:1] == SPACE for i, p in enumerate(pieces)])
        self.silent = np.array([k == CONTROL for k in kinds])
        self._by_pair: dict[int, int] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the words met so far."""
        self.table: dict[str, int] = {}
        self.table_ids, self.table_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions in keys of the pairs (a, b), or -1."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _merge_long(self, symbols: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols, and where each begins, after all merges of one long word: the lowest rank first, the
        leftmost of equal ones. It holds about 60 bytes for each character."""
        if not self._by_pair:
            self._by_pair = dict(zip(self.keys.tolist(), range(len(self.keys)), strict=True))
        find, rank, merged, base = self._by_pair.get, self.rank, self.merged, self.base
        n = len(symbols)
        sym, pair, after, before = array("i"), array("i"), array("i"), array("i")
        for held, x in ((sym, symbols), (pair, pairs), (after, np.arange(1, n + 1)), (before, np.arange(-1, n - 1))):
            held.frombytes(x.astype(np.int32).tobytes())
        heap = [(int(rank[p]) << 40) | i for i, p in enumerate(pair) if p >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & ((1 << 40) - 1)
            p = pair[i]
            if p < 0 or int(rank[p]) != top >> 40:
                continue
            j = after[i]
            sym[i], sym[j], pair[j] = int(merged[p]), -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((i, k), (before[i], i)):
                if a >= 0:
                    pair[a] = find(sym[a] * base + sym[b], -1) if b < n else -1
                    if pair[a] >= 0:
                        heapq.heappush(heap, (int(rank[pair[a]]) << 40) | a)
        left = np.frombuffer(sym, np.int32).astype(np.int64)
        at = np.flatnonzero(left >= 0)
        return left[at], at

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and each word's offset."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lens)
        sym = self.char[code]
        first = np.zeros(len(sym), bool)
        first[np.cumsum(lens) - lens] = True
        bigram = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.inside, bigram), len(self.inside) - 1)
        first[1:] |= self.inside[at] != bigram  # no piece spans these two characters
        out_sym, out_pos = [], []
        pos = np.arange(len(sym))  # where the symbol begins: it orders the results
        pair = np.full(len(sym), -1)
        pair[:-1] = np.where(first[1:], -1, self._lookup(sym[:-1], sym[1:]))
        begin = np.flatnonzero(first)
        sizes = np.diff(begin, append=len(sym))
        for k in np.flatnonzero(sizes > LONG).tolist():
            lo, n = int(begin[k]), int(sizes[k])
            got, at = self._merge_long(sym[lo : lo + n], pair[lo : lo + n])
            out_sym.append(got)
            out_pos.append(at + lo)
            pos[lo : lo + n] = -1
        stay = pos >= 0
        if not stay.all():
            sym, pos, pair, first = sym[stay], pos[stay], pair[stay], first[stay]
        while len(sym):
            starts = np.flatnonzero(first)
            rank = np.where(pair >= 0, self.rank[pair], _NONE)
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(sym))
            done = low == _NONE
            if done.any():
                gone = np.repeat(done, sizes)
                out_sym.append(sym[gone])
                out_pos.append(pos[gone])
                stay = ~gone
                sym, pos, pair, first, rank = sym[stay], pos[stay], pair[stay], first[stay], rank[stay]
                low, sizes = low[~done], sizes[~done]
                if not len(sym):
                    break
                starts = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            seg = np.searchsorted(starts, hit, "right") - 1
            calm = np.ones(len(starts), bool)
            calm[seg[~self.calm[self.merged[pair[hit]]]]] = False
            head = np.ones(len(hit), bool)
            head[1:] = seg[1:] != seg[:-1]
            run = head.copy()
            run[1:] |= hit[1:] != hit[:-1] + 1  # occurrences that overlap: every second one merges
            n = np.arange(len(hit))
            even = (n - np.maximum.accumulate(np.where(run, n, 0))) % 2 == 0
            hit = hit[np.where(calm[seg], even, head)]
            sym[hit] = self.merged[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit = np.cumsum(keep)[hit] - 1
            sym, pos, pair, first = sym[keep], pos[keep], pair[keep], first[keep]
            near = np.zeros(len(sym), bool)
            near[hit] = True
            near[hit[hit > 0] - 1] = True
            fix = np.flatnonzero(near)
            pair[fix] = -1
            fix = fix[fix + 1 < len(sym)]
            fix = fix[~first[fix + 1]]
            pair[fix] = self._lookup(sym[fix], sym[fix + 1])
        if not out_sym:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym, pos = np.concatenate(out_sym), np.concatenate(out_pos)
        order = np.argsort(pos, kind="stable")
        sym, owner = sym[order], owner[pos[order]]
        if (odd := sym >= self.size).any():  # characters outside the vocabulary become their bytes
            wide = np.where(odd, np.searchsorted([0x80, 0x800, 0x10000], sym - self.size, "right") + 1, 1)
            flat = np.frombuffer("".join(map(chr, (sym[odd] - self.size).tolist())).encode(), np.uint8)
            out = np.repeat(sym, wide)
            out[np.repeat(odd, wide)] = self.bytes[flat]
            sym, owner = out, np.repeat(owner, wide)
        return sym.astype(np.int32), np.searchsorted(owner, np.arange(len(words) + 1))

    def encode(self, texts: list[str | None], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets of each text's ids; with end, the end id closes each."""
        if len(self.table) > TABLE_WORDS:
            self.reset()
        table, new, rows, sizes = self.table, [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            words = self.words.findall(SPACE + text.replace(" ", SPACE))
            at = list(map(table.get, words))
            if None in at:
                for k, w in enumerate(words):
                    if at[k] is None:
                        if w not in table:
                            table[w] = len(table)
                            new.append(w)
                        at[k] = table[w]
            sizes[i] = len(words)
            rows.append(np.array(at, np.int64))
        if new:
            ids, at = self._merge(new)
            self.table_at = np.concatenate([self.table_at, at[1:] + self.table_at[-1]])
            self.table_ids = np.concatenate([self.table_ids, ids])
        word = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        begin, lens = self.table_at[word], self.table_at[word + 1] - self.table_at[word]
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = self.table_ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], lens)]
        offsets = ends[np.concatenate([[0], np.cumsum(sizes)])]
        if end:
            flat = np.insert(flat, offsets[1:], self.end)
            offsets = offsets + np.arange(len(texts) + 1)
        return flat, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of flat ids: the first space of the first sounding piece goes, control ids are silent,
        every byte of an invalid UTF-8 sequence becomes U+FFFD."""
        begin, lens = self.surface_at[ids], self.surface_at[ids + 1] - self.surface_at[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        raw = self.surface[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], lens)].tobytes()
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            k = a
            while k < b and self.silent[ids[k]]:
                k += 1
            part = raw[ends[a] + (k < b and bool(self.leads[ids[k]])) : ends[b]]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(_lenient(part))
        return out


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_models: dict[bytes, Model] = {}


def load(serialized: bytes) -> Model:
    """The model of a worker, parsed once."""
    if serialized not in _models:
        _models.clear()
        _models[serialized] = Model(serialized)
    return _models[serialized]


def text_slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch with about limit bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _encoded(serialized: bytes, end: bool, decoded: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(serialized)
        item = pa.field("element", pa.int32(), False)
        try:
            for whole in batches:
                for b in text_slices(whole, 0):
                    flat, off = model.encode(b.column(0).to_pylist(), end)
                    cols = [*b.columns[1:], pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat), type=pa.list_(item))]
                    if decoded:
                        cols.append(pa.array(model.decode(flat, off), pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=names)
        finally:
            model.reset()  # a worker is kept between tasks, and others wait beside those that have one

    return run


def encode_decode(df: DataFrame, model_path: str, text: str = "text", end: bool = True, decoded: str | None = "decoded", ids: str = "ids") -> DataFrame:
    """df with the text column replaced by ids (array<int>) and, if decoded is a name, the text that
    these ids decode to. An existing column with one of these names is replaced."""
    with open(model_path, "rb") as f:
        serialized = f.read()
    keep = [c for c in df.columns if c not in (text, ids, decoded)]
    source = df.select(text, *keep)
    fields = [*source.schema.fields[1:], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])

    return source.mapInArrow(slim(_encoded(serialized, end, bool(decoded), [f.name for f in fields])), T.StructType(fields))

"""Byte-level BPE encoding and decoding by merge replay over the words of a corpus part.

The distinct new words of a slice of texts lie in one flat array of symbols, linked to their neighbours. An inverted
index leads from what a pair of neighbours would become to all positions, in all words, where such a pair stands.
Merges are replayed in rank order: each takes its index entry, joins its pairs left to right, and looks up only the pairs
that have a new neighbour, which enter the index under their own merge. A worker keeps the words that it has encoded,
so most of a corpus is looked up, and only words not seen before are replayed.

The words are those of the pattern of GPT-2's kind (contractions, letters, digits, other characters with one space in
front, white space). They are found by classes of code points; which code points are letters, digits and white space is
asked from the tiktoken library, once for each worker, so that both go by the same edition of Unicode.

Contract: null texts count as empty and encode to no id. Texts of any length are whole; rows are independent, so repeated
rows give repeated results and an empty table gives none. Columns of any names pass through; one that has an output's
name is replaced. An unbroken word takes about 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import CHUNK_BYTES
from lodestone.llm.sentencepiece_bpe import text_slices

LETTER, DIGIT, OTHER, WHITE, EDGE = range(5)
#: Words kept between slices by a worker; beyond it the table starts anew.
TABLE_WORDS = 300_000
#: Index entries up to this length are replayed one position at a time.
FEW = 96
_APOSTROPHE, _BLANK = 0x27, 0x20

_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of every code point, and EDGE for the one past the last."""
    if not _classes:
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([i]): i for i in range(256)}
        out = np.full(0x110001, OTHER, np.uint8)
        out[-1] = EDGE
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", WHITE)):
            asked = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})
            matched = bytes(asked.encode_ordinary(every)).decode()
            out[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = kind
        _classes.append(out)
    return _classes[0]


def word_starts(code: np.ndarray) -> np.ndarray:
    """Whether a word begins at each code point of texts that an EDGE (0x110000) follows each; edges begin words, too."""
    kind = character_classes()[code]
    start = np.ones(len(code), bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= kind == EDGE
    before = np.concatenate([[EDGE], kind[:-1]]).astype(np.uint8)
    solid = (kind == LETTER) | (kind == DIGIT) | (kind == OTHER)
    last_white = np.flatnonzero(solid[1:] & (kind[:-1] == WHITE))  # of a run that isn't at the text's end
    start[last_white] = True
    start[last_white[code[last_white] == _BLANK] + 1] = False  # a single space goes with what follows
    quote = np.flatnonzero((code == _APOSTROPHE) & (before != OTHER))
    quote = quote[(quote == 0) | (code[np.maximum(quote, 1) - 1] != _BLANK)]
    ahead = np.concatenate([code, [0x110000] * 2])
    one, two = ahead[quote + 1], ahead[quote + 2]
    is_ = lambda x, chars: np.isin(x, [ord(c) for c in chars])
    short = is_(one, "stmd")
    long = (is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 3] = True
    return start


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) > 0]


class Ranks:
    """A vocabulary of byte strings whose ids are the ranks of the merges that make them."""

    def __init__(self, serialized: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in serialized.splitlines() if line)}
        if any(bytes([i]) not in self.ids for i in range(256)):
            raise ValueError("every single byte must have an id")
        self.base = base = max(self.ids.values()) + 1
        self.bytes = np.array([self.ids[bytes([i])] for i in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    self.pairs[a * base + b] = i
        order = np.argsort(keys := np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self.keys, self.merged = keys[order], np.fromiter(self.pairs.values(), np.int32, len(keys))[order]
        #: Pieces that can make pairs of a lower rank than their own: a word in which they do can't be replayed by rank.
        self.rash = {x for pair, i in self.pairs.items() for x in divmod(pair, base) if i < x}
        surface = [b""] * base
        for piece, i in self.ids.items():
            surface[i] = piece
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self._reset()

    def _reset(self) -> None:
        self.table: dict[str, int] = {}
        self.table_ids, self.table_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _becomes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the pairs (a, b) merge into, or -1."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int32)
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1).astype(np.int32)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and each word's offset."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = len(flat)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        symbols, after, before, into = (array("i", bytes(4 * n)) for _ in range(4))
        sym, nxt, prv, pair = (np.frombuffer(x, np.int32) for x in (symbols, after, before, into)) if n else (np.zeros(0, np.int32),) * 4
        index: dict[int, array] = {}
        odd: set[int] = set()  # words in which a merge has made way for one of a lower rank
        note = lambda at: odd.update((np.searchsorted(starts, np.atleast_1d(at), "right") - 1).tolist())
        if n:
            sym[:] = self.bytes[flat]
            nxt[:] = np.arange(1, n + 1)
            prv[:] = np.arange(-1, n - 1)
            nxt[starts[1:] - 1] = -1
            prv[starts[:-1]] = -1
            pair[:-1] = self._becomes(sym[:-1], sym[1:])
            pair[nxt < 0] = -1
            self._enter(index, np.flatnonzero(pair >= 0).astype(np.int32), pair)
        ranks = list(index)
        heapq.heapify(ranks)
        find, base = self.pairs.get, self.base
        while ranks:
            rank = heapq.heappop(ranks)
            held = index.pop(rank)
            rash = rank in self.rash
            if len(held) > FEW:
                hit = _distinct(np.frombuffer(held, np.int32))
                hit = hit[pair[hit] == rank]
                if not len(hit):
                    continue
                head = np.ones(len(hit), bool)
                head[1:] = nxt[hit[:-1]] != hit[1:]  # else it overlaps the pair before it
                k = np.arange(len(hit))
                hit = hit[(k - np.maximum.accumulate(np.where(head, k, 0))) % 2 == 0]
                gone = nxt[hit]
                if rash:  # pairs with what follows, which may itself be joined below
                    follow = nxt[gone]
                    low = np.where(follow >= 0, self._becomes(np.full(len(hit), rank), sym[follow]), -1)
                    note(hit[(low >= 0) & (low < rank)])
                sym[hit], sym[gone], pair[gone] = rank, -1, -1
                nxt[hit] = right = nxt[gone]
                prv[right[right >= 0]] = hit[right >= 0]
                left = prv[hit]
                fix = _distinct(np.concatenate([hit, left[left >= 0]]))
                follow = nxt[fix]
                pair[fix] = np.where(follow >= 0, self._becomes(sym[fix], sym[follow]), -1)
                fix = fix[pair[fix] >= 0]
                if rash:
                    note(fix[pair[fix] < rank])
                for r in self._enter(index, fix, pair):
                    heapq.heappush(ranks, r)
            else:
                for i in sorted(held):
                    if into[i] != rank:
                        continue
                    j = after[i]
                    k = after[j]
                    symbols[i], symbols[j], into[j], after[i] = rank, -1, -1, k
                    if k >= 0:
                        before[k] = i
                    for a, b in ((before[i], i), (i, k)):
                        if a < 0:
                            continue
                        into[a] = r = find(symbols[a] * base + symbols[b], -1) if b >= 0 else -1
                        if r >= 0:
                            if r < rank:
                                note(a)
                            if r not in index:
                                index[r] = array("i")
                                heapq.heappush(ranks, r)
                            index[r].append(a)
        at = np.flatnonzero(sym >= 0)
        ids, offsets = sym[at].copy(), np.searchsorted(at, starts)
        # Whole words of the vocabulary are their own ids even where merges don't lead to them.
        whole = [(i, [self.ids[words[i]]]) for i in np.flatnonzero(np.diff(offsets) > 1).tolist() if words[i] in self.ids]
        fixed = dict([(i, self.one_by_one(words[i])) for i in odd] + whole)
        if fixed:
            kept = [ids[offsets[i] : offsets[i + 1]] if i not in fixed else np.array(fixed[i], np.int32) for i in range(len(words))]
            ids, offsets = np.concatenate(kept), np.concatenate([[0], np.cumsum([len(k) for k in kept])])
        return ids, offsets

    @staticmethod
    def _enter(index: dict[int, array], at: np.ndarray, pair: np.ndarray) -> list[int]:
        """Enter positions under what their pairs become; returns the entries that are new."""
        order = np.argsort(pair[at], kind="stable")
        at, kinds = at[order], pair[at][order]
        cut = [*np.flatnonzero(np.diff(kinds, prepend=-1)).tolist(), len(at)]
        new = []
        for a, b in zip(cut, cut[1:], strict=False):
            rank = int(kinds[a])
            if rank not in index:
                index[rank] = array("i")
                new.append(rank)
            index[rank].frombytes(at[a:b].astype(np.int32).tobytes())
        return new

    def one_by_one(self, word: bytes) -> list[int]:
        """Ids of one word by its own lowest ranks, whatever their order: for vocabularies in which a merge can open one of
        a lower rank."""
        sym = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(sym)), -1], list(range(-1, len(sym) - 1))
        find, base = self.pairs.get, self.base
        heap = [(r, i) for i in range(len(sym) - 1) if (r := find(sym[i] * base + sym[i + 1], -1)) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j < 0 or find(sym[i] * base + sym[j], -1) != rank:
                continue
            after[i] = k = after[j]
            sym[i], sym[j] = rank, -1
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (r := find(sym[a] * base + sym[b], -1)) >= 0:
                    heapq.heappush(heap, (r, a))
        return [s for s in sym if s >= 0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets of each text's ids."""
        if len(self.table) > TABLE_WORDS:
            self._reset()
        texts = [t or "" for t in texts]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        edges = np.cumsum(lens)
        code = np.insert(np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64), edges, 0x110000)
        start = word_starts(code)[code < 0x110000]
        at = np.flatnonzero(start)
        counts = np.diff(np.searchsorted(at, np.concatenate([[0], edges])))
        at = [*at.tolist(), len(joined)]
        words = [joined[a:b] for a, b in zip(at, at[1:], strict=False)]
        table = self.table
        found = list(map(table.get, words))
        if None in found:
            new = []
            for k, w in enumerate(words):
                if found[k] is None:
                    if w not in table:
                        table[w] = len(table)
                        new.append(w.encode())
                    found[k] = table[w]
            ids, off = self.replay(new)
            self.table_at = np.concatenate([self.table_at, off[1:] + self.table_at[-1]])
            self.table_ids = np.concatenate([self.table_ids, ids])
        word = np.array(found, np.int64)
        begin, sizes = self.table_at[word], self.table_at[word + 1] - self.table_at[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.table_ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes)]
        return flat, ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of flat ids, flat, and offsets of each text's bytes. Ids that the vocabulary lacks have none."""
        ids = np.where((ids < 0) | (ids >= self.base), self.base, ids)
        known = np.append(self.surface_at, self.surface_at[-1])
        begin, sizes = known[ids], known[ids + 1] - known[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.surface[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes)], ends[offsets]


_loaded: dict[bytes, Ranks] = {}


def load(serialized: bytes) -> Ranks:
    """The vocabulary of a worker, parsed once."""
    if serialized not in _loaded:
        _loaded.clear()
        _loaded[serialized] = Ranks(serialized)
    return _loaded[serialized]


def _by_place(df: DataFrame, first: str, kept: list[str]) -> DataFrame:
    """first and kept as c0, c1, ...: names such as "a.b" can't be passed to mapInArrow."""
    return df.select(*(F.col(f"`{c}`") for c in (first, *kept))).toDF(*(f"c{i}" for i in range(1 + len(kept))))


def encode_decode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """df with the text column replaced by ids (array<int>) and, if decoded is a name, the bytes that these ids decode to
    (binary). ranks_path: a file of lines of base64 and rank, which the driver reads."""
    with open(ranks_path, "rb") as f:
        serialized = f.read()
    kept = [c for c in df.columns if c not in (text, ids, decoded)]
    source = _by_place(df, text, kept)
    fields = [*source.schema.fields[1:], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.BinaryType(), False)] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(serialized)
        for whole in batches:
            for b in text_slices(whole, 0, CHUNK_BYTES):
                flat, off = model.encode(b.column(0).to_pylist())
                cols = [*b.columns[1:], pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat), type=pa.list_(pa.field("element", pa.int32(), False)))]
                if decoded:
                    raw, at = model.decode(flat, off)
                    cols.append(pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())]))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields)).toDF(*kept, *(f.name for f in fields[len(kept) :]))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with its ids (array<int>, null: empty) replaced by the bytes that they decode to."""
    with open(ranks_path, "rb") as f:
        serialized = f.read()
    kept = [c for c in df.columns if c not in (ids, decoded)]
    source = _by_place(df.withColumn(ids, F.col(f"`{ids}`").cast("array<int>")), ids, kept)
    fields = [*source.schema.fields[1:], T.StructField(decoded, T.BinaryType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(serialized)
        for b in batches:
            column = b.column(0)
            sizes = np.array(column.value_lengths().fill_null(0), np.int64)
            off = np.concatenate([[0], np.cumsum(sizes)])
            raw, at = model.decode(np.array(column.flatten().fill_null(-1), np.int64), off)
            made = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], made.cast(pa.binary())], names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields)).toDF(*kept, decoded)

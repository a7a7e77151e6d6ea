"""Token ids in a fixed-width bit-packed file format.

An id takes the fewest bits that hold every id of the vocabulary. A file is a run of blocks and a footer;
each ends with one newline byte, which the text writer of Spark adds (so that files commit like any other
Spark output and reach every store that Spark reaches)::

    block   "TIDB", bits u8, 3 zero bytes, documents u32, ids u64, doc ids i64[], null flags u8[], lengths u64[], packed ids
    footer  "TIDF", blocks u32, then for each block: byte offset u64, first id u64; footer bytes u32

Id i of a block stands at bit i * bits, so a range of ids is found by the footer and unpacked by numpy alone.

A file has FILE_BLOCKS blocks at most; a partition begins new files as it needs them. Distinct words of a slice are
encoded once, and a worker keeps a bounded number of them, fewer between tasks; each text's ids are put together from
its words'.

Contract: files hold documents in ascending order of doc_id (nulls last, equal ids by the first 64 characters of their texts, null first, and then by a hash), file after file
by the numbers in their names. Null texts count as empty; a repeated row is a document of its own; an empty table gives no document.
Documents longer than a block get a block of their own. Other columns take no part.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, SPACE, join_checked, shared_path, slim, staged, word_spans
from lodestone.llm.sentencepiece_bpe import text_slices

#: Ids in a block, but for a single longer document.
BLOCK_IDS = 1 << 18
#: Text bytes that are encoded at once: the more, the fewer words are distinct.
ENCODE_BYTES = 1 << 20
#: Blocks of a file: about 64 MB at 16 bits, so that a file can be read as one row.
FILE_BLOCKS = 127
#: Words kept between slices by a worker; beyond them, and after a task, those met in most slices stay.
TABLE_WORDS, KEPT_WORDS = 250_000, 100_000
_BEFORE, _AFTER = np.zeros(256, bool), np.zeros(256, bool)
_BEFORE[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_AFTER[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
#: Letters that every normal form and lower-casing leaves alone.
_LETTERS = re.compile("[a-zà-öø-ÿ]+")
_LETTER_BYTES = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+").fullmatch
#: Texts that go to the library as they are: those that may hold a special token, and those in which a mark follows a capital,
#: with which it may compose where it does not with the small letter, or the other way round.
_WHOLE = r"<\||[A-Z]\pM"
_HEAD = struct.Struct("<4sB3xIQ")


def width(vocabulary: int) -> int:
    """Bits of an id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()


def unpack(raw: np.ndarray, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block's packed bytes, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        w = bits // 8
        return raw[start * w : stop * w].view(f"<u{w}").astype(np.uint32)
    at = np.arange(start, stop, dtype=np.int64) * bits
    low = int(at[0]) >> 3 if stop > start else 0
    window = np.concatenate([raw[low : (stop * bits + 7) // 8], np.zeros(8, np.uint8)]).astype(np.uint64)
    byte = (at >> 3) - low
    out = np.zeros(stop - start, np.uint64)
    for k in range((bits + 14) // 8):
        out |= window[byte + k] << np.uint64(8 * k)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space between every ASCII letter or digit and the punctuation that follows it."""
    at = np.flatnonzero(_BEFORE[data[:-1]] & _AFTER[data[1:]]) + 1
    return (np.insert(data, at, 0x20), offsets + np.searchsorted(at, offsets)) if len(at) else (data, offsets)


class WordEncoder:
    """Ids of whole texts by the tokenizers library. White space ends a word for that tokenizer's pattern,
    so each distinct word is given to the library once and texts are put together from words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        # A control character that is one id stands between words that are encoded together.
        mark = self._ids("\x01")
        alone = self._ids("a. \x01 b") == [*self._ids("a."), *mark, *self._ids("b")]
        self.mark, self.mark_id = (b"\x01", mark[0]) if len(mark) == 1 and alone else (b"", -1)
        # Only a tokenizer that lower-cases and drops white space, and whose special tokens begin with "<|", gets words in that form.
        told = "the CAT, sat 2.5 times!? ok& it's (3)-fold"
        self.plain = all(self._ids(a) == self._ids(b) for a, b in ((told, "the cat , sat 2 .5 times !? ok & it 's (3 )-fold"), ("a9 'S", "a9 's"))) and all(t.startswith("<|") for _, t in special)
        self._letters_alone(path)
        self._reset()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters_alone(self, path: str) -> None:
        """self.bare: the same tokenizer without normalisation and pattern, which words of _LETTERS don't
        need, if a probe of all these letters agrees; self.last tells ids that end a word."""
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.bare, self.last = None, np.zeros(0, bool)
        with open(path) as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        if spec["model"]["type"] != "BPE" or not suffix:
            return
        bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(bare.get_vocab_size(), bool)
        self.last[[i for t, i in bare.get_vocab().items() if t.endswith(suffix)]] = True
        letters = [c for c in map(chr, range(0x61, 0x100)) if _LETTERS.fullmatch(c)]
        probe = [*letters, *(f"{a}{b}" for a, b in zip(letters, letters[1:], strict=False)), *(f"th{c}ing" for c in letters), "".join(letters)]
        got = bare.encode(" ".join(probe), add_special_tokens=False).ids
        if got == self._ids(" ".join(probe)) and np.array_equal(np.flatnonzero(self.last[got]) + 1, np.cumsum([len(self._ids(w)) for w in probe])):
            self.bare = bare

    def _reset(self) -> None:
        self.table: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.uint32)  # slices that each word was met in

    def trim(self, n: int = KEPT_WORDS) -> None:
        """Keep the n words that were met in most slices; what was met lately counts twice as much as what was before."""
        if len(self.table) <= n:
            return
        keep = np.zeros(len(self.met), bool)
        keep[np.argpartition(self.met, len(self.met) - n)[len(self.met) - n :]] = True
        lens = np.diff(self.at)
        self.ids = self.ids[np.repeat(keep, lens)]
        self.at = np.concatenate([[0], np.cumsum(lens[keep])])
        self.met = self.met[keep] >> 1
        self.table = dict(zip(compress(self.table, keep.tolist()), range(n), strict=True))

    def _marked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and each word's number of ids. Words go to the library many at a time, with a
        mark between them that tells where each ends; words that hold it go alone."""
        odd = [i for i, w in enumerate(words) if self.mark in w] if self.mark else range(len(words))
        alone = {i: self._ids(words[i].decode()) for i in odd}
        plain = [w for w in words if self.mark not in w] if self.mark else []
        between = b" " + self.mark + b" "
        texts = [(between.join(plain[i : i + 512]) + between).decode() for i in range(0, len(plain), 512)]
        flat = self._batch(self.tokenizer, texts)
        ends = np.flatnonzero(flat == self.mark_id)
        lens = np.diff(ends, prepend=-1) - 1
        flat = flat[flat != self.mark_id]
        if alone:
            parts = iter(np.split(flat, np.cumsum(lens)[:-1]) if len(lens) else [])
            parts = [np.array(alone[i], np.uint32) if i in alone else next(parts) for i in range(len(words))]
            flat, lens = np.concatenate(parts), np.array([len(p) for p in parts])
        return flat, lens

    @staticmethod
    def _batch(tokenizer, texts: list[str]) -> np.ndarray:
        got = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *got])

    def _add(self, words: list[bytes]) -> None:
        """Put new words into the table: those of letters alone first, as they need least of the library."""
        easy, hard = [], []
        for w in words:
            (easy if self.bare is not None and (w.isalpha() and w.islower() or _LETTER_BYTES(w)) else hard).append(w)
        flat = self._batch(self.bare, [b" ".join(easy[i : i + 512]).decode() for i in range(0, len(easy), 512)]) if easy else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.last[flat]) + 1 if easy else np.zeros(0, np.int64)
        rest, lens = self._marked(hard)
        n = len(self.table)
        self.table.update(zip(easy, range(n, n + len(easy)), strict=True))
        n = len(self.table)
        self.table.update(zip(hard, range(n, n + len(hard)), strict=True))
        self.at = np.concatenate([self.at, ends + self.at[-1], np.cumsum(lens) + len(flat) + self.at[-1]])
        self.ids = np.concatenate([self.ids, flat, rest])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.uint32)])

    def _words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Words of all texts, and offsets of each text's words. A-Z are lower-cased (as the tokenizer does)
        and punctuation is cut off letters and digits (where its pattern cuts, too): that leaves fewer
        distinct words. White space carries no id."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n, (_, off, data) = len(texts), texts.buffers()
        offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if self.plain:
            data, offsets = _cut(LOWER[data], offsets)
        starts, ends, at = word_spans(data, offsets)
        index = np.concatenate([[0], np.cumsum(ends - starts)])
        letters = data[~SPACE[data]]
        flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(index.astype(np.int64)), pa.py_buffer(letters)])
        return flat.dictionary_encode(), at

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets of each text's ids; end, if given, closes each."""
        odd = pc.match_substring_regex(pc.fill_null(texts, ""), _WHOLE) if self.plain else pa.array([False] * len(texts))
        whole = [(i, np.array(self._ids(texts[i].as_py()), np.uint32)) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()]
        if whole:
            texts = pc.if_else(odd, "", texts)
        if len(self.table) > TABLE_WORDS:
            self.trim()
        words, at = self._words(texts)
        _, ends, raw = words.dictionary.buffers()
        ends, raw = np.frombuffer(ends, np.int64)[: len(words.dictionary) + 1].tolist(), raw.to_pybytes() if raw is not None else b""
        distinct = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        place = np.fromiter(map(self.table.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            self._add(new)
            place[missing] = np.fromiter(map(self.table.__getitem__, new), np.int64, len(new))
        self.met[place] += 1
        word = place[words.indices.to_numpy()]
        begin, lens = self.at[word], self.at[word + 1] - self.at[word]
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], lens)]
        offsets = ends[at]
        if whole:
            spots = np.repeat([offsets[i] for i, _ in whole], [len(x) for _, x in whole])
            flat = np.insert(flat, spots, np.concatenate([x for _, x in whole]))
            more = np.zeros(len(offsets), np.int64)
            more[[i + 1 for i, _ in whole]] = [len(x) for _, x in whole]
            offsets = offsets + np.cumsum(more)
        if end is not None:
            flat = np.insert(flat, offsets[1:], end)
            offsets = offsets + np.arange(len(texts) + 1)
        return flat, offsets


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """The worker's own encoder. A function that is sent to tasks takes the globals that it names along by value, so
    that _encoders, named there, would be empty in each task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _block(bits: int, docs: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    null = np.array([d is None for d in docs], np.uint8)
    keys = np.array([d or 0 for d in docs], "<i8")
    return _HEAD.pack(b"TIDB", bits, len(docs), len(ids)) + keys.tobytes() + null.tobytes() + lens.astype("<u8").tobytes() + pack(ids, bits)


class _FileWriter:
    """Blocks and footers of files: a footer follows every FILE_BLOCKS blocks and the last one."""

    def __init__(self, bits: int, file_blocks: int):
        self.bits, self.file_blocks, self.bytes, self.total, self.index = bits, file_blocks, 0, 0, []
        self.docs, self.parts, self.lens = [], [], []
        self.held = 0

    def add(self, docs: list[int | None], flat: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
        for k, d in enumerate(docs):
            n = int(off[k + 1] - off[k])
            if self.held and self.held + n > BLOCK_IDS:
                yield from self._flush()
            self.docs.append(d)
            self.lens.append(n)
            self.parts.append(flat[off[k] : off[k + 1]])
            self.held += n

    def _flush(self) -> Iterator[bytes]:
        out = _block(self.bits, self.docs, np.array(self.lens), np.concatenate(self.parts))
        self.index.append((self.bytes, self.total))
        self.bytes += len(out) + 1
        self.total += self.held
        self.docs, self.parts, self.lens, self.held = [], [], [], 0
        yield out
        if len(self.index) == self.file_blocks:
            yield self._footer()

    def _footer(self) -> bytes:
        body = b"TIDF" + struct.pack("<I", len(self.index)) + np.array(self.index, "<u8").tobytes()
        self.bytes, self.total, self.index = 0, 0, []
        return body + struct.pack("<I", len(body) + 4)

    def close(self) -> Iterator[bytes]:
        if self.docs:
            yield from self._flush()
        if self.index:
            yield self._footer()


def footer(content: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and first ids of a file's blocks."""
    (n,) = struct.unpack("<I", content[-5:-1])
    body = content[-1 - n : -5]
    if body[:4] != b"TIDF":
        raise ValueError("no file of packed ids")
    index = np.frombuffer(body, "<u8", offset=8).reshape(-1, 2).astype(np.int64)
    return index[:, 0], index[:, 1]


def _read_block(content: bytes | memoryview, at: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    magic, bits, n, ids = _HEAD.unpack_from(content, at)
    if magic != b"TIDB":
        raise ValueError("no block of packed ids")
    at += _HEAD.size
    keys = np.frombuffer(content, "<i8", n, at)
    null = np.frombuffer(content, np.uint8, n, at + 8 * n)
    lens = np.frombuffer(content, "<u8", n, at + 9 * n).astype(np.int64)
    raw = np.frombuffer(content, np.uint8, (ids * bits + 7) // 8, at + 17 * n)
    return bits, keys, null, lens, raw, ids


def read_range(content: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a file: only the blocks that hold them are looked at."""
    at, first = footer(content)
    out = [np.zeros(0, np.uint32)]
    for k in range(max(0, int(np.searchsorted(first, start, "right")) - 1), int(np.searchsorted(first, stop))):
        bits, _, _, _, raw, n = _read_block(content, int(at[k]))
        out.append(unpack(raw, bits, max(0, start - int(first[k])), max(0, min(n, stop - int(first[k])))))
    return np.concatenate(out)


def write_ids(df: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end: int | None = 2, file_blocks: int = FILE_BLOCKS) -> None:
    """Encode df's texts and write them to files under path, ordered by key, each of file_blocks blocks at
    most: the writer begins a file after as many rows as there are blocks and a footer."""
    import json

    with open(tokenizer_path) as f:
        spec = json.load(f)
    bits = width(1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end or 0]))
    del spec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = _encoder(tokenizer_path), _FileWriter(bits, file_blocks)
        row = lambda b: pa.RecordBatch.from_arrays([pa.array([b], pa.binary())], names=["value"])
        for whole in batches:
            for b in text_slices(whole, 1, ENCODE_BYTES):
                flat, off = encoder.encode(b.column(1), end)
                for x in out.add(b.column(0).to_pylist(), flat, off):
                    yield row(x)
        for x in out.close():
            yield row(x)
        encoder.trim()

    # Whole texts would be too large as bounds of ranges. Equal rows are split between ranges, too.
    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text), F.substring(text, 1, 64).alias("p__"), F.xxhash64(text).alias("h__"), F.monotonically_increasing_id().alias("n__"))
    order = [F.col(key).asc_nulls_last(), F.col("p__").asc_nulls_first(), F.col("h__"), F.col("n__")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(key, text)
    dealt.mapInArrow(slim(run), "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", file_blocks + 1).text(path)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of the files under path: file, doc_id, local_start (ids before it in its file), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids."""
    names = ["file", "doc_id", "local_start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content = memoryview(content.as_buffer())
                for at, first in zip(*footer(content), strict=True):
                    bits, keys, null, lens, raw, n = _read_block(content, int(at))
                    flat = unpack(raw, bits, 0, n)
                    off = np.concatenate([[0], np.cumsum(lens)])
                    crc = [zlib.crc32(flat[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                    cols = [pa.array([name] * len(keys)), pa.array(keys.astype(np.int64), mask=null.astype(bool)), pa.array(off[:-1] + first), pa.array(lens), pa.array(crc, pa.int64())]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(slim(run), schema)


def with_starts(docs: DataFrame) -> DataFrame:
    """docs, as read_ids gives them, and start: the ids of all documents before. Files come in the order of the
    two numbers in their names, partition and file of it. Counts per file are the only thing that is ordered in
    one task: one row for each file."""
    docs = staged(docs, "packed-docs")
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    sizes = docs.groupBy("file").agg(F.sum("n_tokens").alias("n__")).withColumn("part__", number(r"part-(\d+)[^/]*$")).withColumn("nth__", number(r"-c(\d+)[^/]*$"))
    order = Window.orderBy("part__", F.col("nth__").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", F.coalesce(F.sum("n__").over(order), F.lit(0)).alias("before__"))
    return join_checked(docs, before, "file").withColumn("start", F.col("before__") + F.col("local_start")).drop("before__")


def round_trip(df: DataFrame, tokenizer_path: str, end: int = 2) -> DataFrame:
    """Write df's documents to packed files in the shared folder and read them back: doc_id, start,
    n_tokens, ids_crc32."""
    path = shared_path(df.sparkSession, "packed-ids")
    write_ids(df, path, tokenizer_path, end=end)
    return with_starts(read_ids(df.sparkSession, path, ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")

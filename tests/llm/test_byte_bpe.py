"""Byte-level BPE against the tiktoken library."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodestone.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(serialized):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, serialized.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def serialized():
    with open(PATH, "rb") as f:
        return f.read()


def fuzzed(n):
    random.seed(11)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", "l", "e", " ", "  ", "\n", "\t", "\r", " ", "　", "a", "Z", "1", "½", "é", "́", "!", "€", "中", "🦆", "՘", "\x00", "\x1c", "\x85", "​", " the", "ß"]
    anything = lambda: chr(random.choice([random.randrange(0x20, 0x7F), random.randrange(0x80, 0xD800), random.randrange(0xE000, 0x110000)]))
    mixed = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(n)]
    return mixed + ["".join(anything() for _ in range(random.randint(1, 40))) for _ in range(n // 2)]


def same(model, lib, texts):
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        ids, off = model.encode(part)
        raw, ends = model.decode(ids, off)
        raw = raw.tobytes()
        for k, text in enumerate(part):
            assert ids[off[k] : off[k + 1]].tolist() == lib.encode_ordinary(text or ""), text
            assert raw[ends[k] : ends[k + 1]] == (text or "").encode()


def test_equals_the_library(serialized):
    long = ["a" * 3000, "ab" * 3000, " " * 2000, "\n" * 777 + "x", "'" * 999, "the" * 3000, "", None, "é" * 2000, "x'" * 500, "'ll'd's'x" * 100]
    same(byte_bpe.Ranks(serialized), library(serialized), fuzzed(6000) + long)


def test_both_ways_of_replaying_agree(serialized, monkeypatch):
    words = [w.encode() for w in dict.fromkeys(fuzzed(800)) if w]
    model = byte_bpe.Ranks(serialized)
    want = model.replay(words)
    for few in (0, 1 << 30):
        monkeypatch.setattr(byte_bpe, "FEW", few)
        for a, b in zip(want, model.replay(words), strict=True):
            assert np.array_equal(a, b)


def test_vocabularies_out_of_order():
    """Random vocabularies: merges open others of lower ranks, and whole words that merges don't reach."""
    random.seed(3)
    for _ in range(30):
        pieces = [bytes([i]) for i in range(256)]
        pieces += list({bytes(random.choices(b"abc", k=random.randint(2, 5))) for _ in range(40)})
        ids = list(range(len(pieces)))
        random.shuffle(ids)
        text = b"\n".join(base64.b64encode(p) + b" %d" % i for p, i in zip(pieces, ids, strict=True))
        same(byte_bpe.Ranks(text), library(text), ["".join(random.choices("abc ", k=random.randint(0, 60))) for _ in range(200)])


def test_columns_nulls_repeats_and_empty_tables(spark, serialized):
    rows = [(1, "Hello  world's", "x", 1), (1, "Hello  world's", "x", 2), (2, None, None, 3), (None, "", "y", 4), (3, "word " * 100_000, "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, ids int").repartition(3)
    got = byte_bpe.encode_decode(df, PATH)
    assert got.columns == ["doc_id", "a.b", "ids", "decoded"]
    lib = library(serialized)
    key = lambda r: tuple(map(str, r))
    want = [(i, b, lib.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t, b, _ in rows]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert byte_bpe.encode_decode(df.limit(0), PATH).collect() == []
    back = byte_bpe.decode(got.select("doc_id", "ids"), PATH).collect()
    assert sorted((r.decoded for r in back), key=len) == sorted((w[3] for w in want), key=len)
    assert bytes(byte_bpe.decode(spark.createDataFrame([([-1, 10**7, None],), (None,)], "ids array<int>"), PATH).head().decoded) == b""

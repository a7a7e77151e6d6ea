import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import maxent_lm, mixing, ngram_join, packed_ids, sentencepiece_bpe, toxicity, warc_zst
from lodestone.llm.common import text_chunks, word_hashes
from lodestone.llm.html_text import extract, extracted

WORD = "[^\x20\x09-\x0d]+"


def words(t):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x1c ß", max_size=12)), max_size=8))
def test_word_hashes(texts):
    seen = {}
    for lo, hi, data, off in text_chunks(pa.array(texts, pa.string()), 16):
        h, at = word_hashes(data, off)
        for k, t in enumerate(texts[lo:hi]):
            own = h[at[k] : at[k + 1]].tolist()
            assert len(own) == len(words(t))
            for w, x in zip(words(t), own):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- HTML


def test_html_blocks_lists_tables():
    page = """<html><head><title>T</title></head><body><p>One <b>two</b>
      three<p>Four<br>five &amp; six<div hidden>no</div><ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
      <table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td rowspan=2>r<td>1<tr><td>2</table><pre>
 keep
   this</pre><script>var a = "</p>"</script><!-- c -->1 < 2</body>"""
    assert extract(page) == "One two three\n\nFour\nfive & six\n\n- a\n- b\n  3. x\n  4. y\n\nName       Qty\nApple pie  3\nr          1\n           2\n\n keep\n   this\n\n1 < 2"


def test_html_visibility_and_broken_markup():
    assert extract('<p style="color:red; display : none">a</p><span style="visibility:hidden">b</span>c<template>d</template>') == "c"
    assert extract("<details><summary>S</summary>x</details><details open><summary>T</summary>y</details>") == "S\nT\ny"
    assert extract("a</div></p><b>b<p>c</b>") == "ab\n\nc"
    assert extract('<a href="x') == '<a href="x'
    for page in (None, "", "<", "<>", "</", "<!--", "<p", "<table><td>x", "<li>x", "&bogus; &#0; &#x110000;", "<div>" * 5000 + "deep" + "<ul><li>" * 5000, "\x00<p>\x00"):
        assert isinstance(extract(page), str)
    assert "deep" in extract("<div>" * 5000 + "deep")


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div hidden>" + "<div>" * 200 + "secret" + "</div>" * 200 + "</div>ok", "ok"),
        ("<div>" * 300 + "<span hidden>secret</span>x", "x"),
        ('<div style="visibility:hidden">a<b style="visibility: visible">b</b>c</div>d', "b\nd"),
        ("<select><option>x<option selected>y</select> <select multiple><option>x<option>y</select>z", "y\nx\ny\nz"),
        ("<svg><title>t</title><text>drawn</text></svg><object>fallback</object><object data=x>no</object><video>no</video>", "drawnfallback"),
        ("<table><tr><td>a<td>b<td>c<tr><td colspan=2>a long cell here<td>d</table>", "a  b              c\na long cell here  d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("a<!-->b<!-- c -- > --!>d<!- e>f</ g>h", "abdfh"),
        ("<a title='>'>x</a><a b = \"c>\"d='e'>y</a><p =f>z", "xy\n\nz"),
    ],
)
def test_layout(page, want):
    assert extract(page) == want


_HALF = 500_000


@pytest.mark.parametrize(
    "page",
    ["<a " * 150_000 + end for end in ('"', '="', "")]
    + ["<a" + " " * _HALF, "<!-- -->" * 60_000, "<p><button>" + "<div>" * 90_000, "<b>" * 150_000 + "</i>" * 9000, "<ul><li>x" * 50_000, "<table><tr><td>x<td>" * 12_000 + "x<br>" * 50_000]
    + ["<table><tr>" + "<td colspan=1000 rowspan=1000>x" * 8000 + "<tr><td>y" * 25_000, "<p style='" + " " * _HALF + "'>x", "&" * _HALF, "<" * _HALF],
)
def test_no_page_takes_long(page):
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 20


def test_words_equal_another_parser(data):
    """The words of whole pages, in any order, against the parser of the standard library."""
    from collections import Counter
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.found = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("head", "script", "style", "title")
            if tag in ("p", "li", "div", "h1", "br", "td", "article", "nav", "footer"):
                self.found.append(" ")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("head", "script", "style", "title")
            self.handle_starttag(tag, []) if tag in ("p", "li", "div", "h1", "nav") else None

        def handle_data(self, text):
            self.found += [text] * (not self.hidden)

    for page in pq.read_table(f"{data}/pages.parquet").column("html").to_pylist():
        other = Words()
        other.feed(page)
        other.close()
        own = re.sub(r"(?m)^ *- ", "", extract(page))
        assert Counter(own.split()) == Counter("".join(other.found).split())


def test_html_column(spark):
    df = spark.createDataFrame([(1, "<p>x"), (2, None), (1, "<p>x")], "page_id long, html string").withColumn("text", F.lit("old"))
    assert sorted(map(tuple, extracted(df).collect())) == [(1, "x"), (1, "x"), (2, "")]
    assert extracted(df.limit(0)).count() == 0


# --- n-gram join


def brute_components(rows, n, num, den):
    sets = [({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())) for w in (words(t) for _, t in rows)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, len(sets[k]), low[root(k)] if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(rng, count, length=120, edits=6):
    base = [f"w{rng.integers(0, 400)}" for _ in range(length)]
    out = []
    for _ in range(count):
        own = list(base)
        for k in rng.integers(0, length, rng.integers(0, edits)):
            own[k] = f"n{rng.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("group_tokens", [250_000, 700])
def test_ngram_join_equals_brute_force(spark, monkeypatch, group_tokens):
    """With 700 n-grams in a group, components are cut into blocks that must find each other's links."""
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", group_tokens)
    rng = np.random.default_rng(4)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = near_copies(rng, 50) + near_copies(rng, 8, 30, 3) + [f"{shared} {' '.join(f'u{rng.integers(0, 10**6)}' for _ in range(int(rng.integers(30, 90))))}" for _ in range(25)]
    texts += ["", None, " \t", "A", "a", "A b", "a B", "a b c", "x " * 500, "X " * 700] + texts[:6]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS ck", "'z' AS component_id", "3 AS h").repartition(5)
    got = ngram_join.ngram_components(df).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, 3, 90, 100)


def test_one_of_each_keeps_one_row_of_a_group(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from here at once"
    rows = [(5, long), (2, long.upper()), (2, long.upper()), (9, "something else entirely that is quite different"), (7, ""), (8, None), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    assert sorted([r.doc_id for r in out.collect()], key=str) == [2, 7, 8, 9, None]
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


# --- mixing


def shares(sizes, weights=(5, 2, 1), ratio=1.5, cap=2.0):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    out, left, open_ = {}, ratio * sum(sizes.values()), list(names)
    while open_:
        full = [k for k in open_ if left * w[k] / sum(w[j] for j in open_) > cap * sizes[k]]
        if not full:
            return out | {k: left * w[k] / sum(w[j] for j in open_) for k in open_}
        for k in full:
            out[k] = cap * sizes[k]
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return out


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(8)
    sources = ["a", "b", "é", "z", None, "B"]
    rows = [(i, None if i == 3 else " ".join(["w"] * int(rng.integers(0, 200))), sources[int(rng.integers(0, 6)) if i % 3 else 0]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'x' AS h", "2 AS p")
    got = mixing.mix(mixing.sized(df)).toPandas()
    again = mixing.mix(mixing.sized(df.repartition(7))).toPandas()
    key = lambda p: p.sort_values("doc_id")[["doc_id", "copies"]].to_numpy().tolist()
    assert key(got) == key(again) and len(got) == len(rows)
    totals, want = {}, None
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + len(words(t))
    want = shares(totals)
    for s, g in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert g.target.iloc[0] == pytest.approx(want[s])
        assert (g["size"] * g.copies).sum() == pytest.approx(want[s], abs=250)
        assert (g.source_size == totals[s]).all() and g.copies.max() <= 2
    assert mixing.mix(mixing.sized(df.limit(0))).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, x = rng.random(500), np.sort(rng.integers(0, 1000, 500))[::-1].astype(float)
    out = mixing.flight(p, x, rng, False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * x).sum() == pytest.approx((p * x).sum())
    assert set(np.unique(mixing.flight(p, x, rng, True))) <= {0.0, 1.0}


def test_take_repeats_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, "c", None), (3, "d", "t")], "doc_id long, text string, source string")
    mixed = mixing.sized(df).withColumn("copies", F.when(F.col("doc_id") == 1, 2).when(F.col("doc_id") == 2, 1).otherwise(0).cast("long"))
    assert sorted(r.doc_id for r in mixing.take(df, mixed).collect()) == [1, 1, 1, 1, 2]


def test_long_unbroken_words_equal_the_library():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = sentencepiece_bpe.Model(f.read())
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(5)
    texts = [x * 700 + y for x in ("the", "a", "ing", "  ", "\u65e5\u672c", "=", "interest") for y in ("", "q")]
    texts += ["".join(rng.choice("etaoinshr ") for _ in range(3000)), "".join(rng.choice("etain") for _ in range(5000)), "the" * 16_000]
    flat, off = model.encode(texts)
    for t, ids in zip(texts, np.split(flat, off[1:-1]), strict=True):
        assert ids.tolist() == library.encode(t)
    began = time.process_time()
    model.encode(["the" * 333_000, "".join(rng.choice("etaoinshr") for _ in range(500_000)), " " * 500_000])
    assert time.process_time() - began < 60


# --- toxicity


def test_toxicity_on_held_out_documents(spark):
    rng = np.random.default_rng(6)
    plain = [f"{a}{b}{c}" for a in ("the", "in", "re") for b in ("st", "on", "al", "er") for c in ("ing", "ed", "ly", "tion")]
    bad = ["vilescum", "worthlessfool", "idiotic", "pathetical"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        w = [plain[k] for k in rng.integers(0, len(plain), int(rng.integers(20, 200)))]
        for k in rng.integers(0, len(w), 6 if toxic else 0):
            w[k] = bad[int(rng.integers(0, 4))]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(5000, ""), (5001, None), (5002, "x" * 30_000), (None, "text")]
    labels += [(1, 1), (None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("score", F.lit("s"))
    got = {r.doc_id: r for r in toxicity.classified(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(1200))
    right = [got[i].predicted == int(i % 6 == 0) for i in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[5000].score == got[5001].score


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.classified(df, none).collect()} == {0}
    assert toxicity.classified(df.limit(0), none).count() == 0


# --- archives


def test_archives_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    body = lambda k: "<p>" + " ".join(f"word{rng.integers(0, 50)}" for _ in range(k)) + "</p>"
    same, small = body(100), "tiny"
    rows = [(i, f"http://x/{i}\r\nEvil: 1", body(60)) for i in range(40)] + [(50, "u", same), (45, None, same), (60, "u", same), (None, "u", same), (46, "u", small), (47, "u", small), (48, "u", None), (49, "u", ""), (50, "u", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS revisit", "'x' AS digest")
    got = sorted(map(tuple, warc_zst.round_trip(df).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == same and i != 45
        want.append((i, "revisit" if again else "response", 45 if again else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want, key=str)
    assert warc_zst.round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_zstandard_frames(spark, tmp_path):
    rows = [(i, "u", f"<p>{'common text of all pages ' * 20}{i}</p>") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc_zst.write_archives(warc_zst.with_revisits(df).coalesce(1), str(tmp_path / "w"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")) if p.stat().st_size)
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    size = int.from_bytes(raw[4:8], "little")
    assert size > 0
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).stream_reader(raw, read_across_frames=True)
    whole = reader.read()
    assert whole.count(b"WARC/1.1\r\n") == 100 and b"common text of all pages" in whole


def test_archives_of_bounded_size(spark, tmp_path, monkeypatch):
    """A task writes several archives, each with its dictionary; record ids are unique; both joins agree."""
    rng = np.random.default_rng(8)
    rows = [(i % 390, None if i % 7 else f"u{i}", "<p>common text</p>" * 20 + "".join(map(chr, rng.integers(0x4E00, 0x9000, 20_000)))) for i in range(400)]
    rows += [(1000 + i, "u", rows[0][2]) for i in range(50)] + [(None, "u", None), (5, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc_zst.write_archives(warc_zst.with_revisits(df).coalesce(1), str(tmp_path / "w"), archive_rows=2)
    files = [p for p in sorted((tmp_path / "w").glob("part-*")) if p.stat().st_size]
    assert len(files) >= 3 and all(p.read_bytes()[:4] == bytes.fromhex("5d2a4d18") for p in files)
    got = warc_zst.read_archives(spark, str(tmp_path / "w")).collect()
    want = sorted((i is None, i or 0, hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_digest) for r in got) == want
    ids = set()
    for p in files:
        raw = p.read_bytes()
        d = zstandard.ZstdCompressionDict(raw[8 : 8 + int.from_bytes(raw[4:8], "little")]) if raw[4:8] != bytes(4) else None
        text = zstandard.ZstdDecompressor(dict_data=d).stream_reader(raw, read_across_frames=True).read()
        ids |= set(re.findall(rb"WARC-Record-ID: (\S+)", text))
    assert len(ids) == len(rows)
    pick = lambda: sorted(map(str, warc_zst.round_trip(df).drop("payload").collect()))
    near = pick()
    monkeypatch.setattr(warc_zst, "TWINS", 0)
    assert pick() == near and sum("revisit" in r for r in near) == 50


# --- language model


def test_base_scores_and_folds(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"{'AbCdEf'[int(k) % 6]}{k}" for k in rng.zipf(1.5, 30) % 500)) for i in range(300)] + [(900, ""), (901, None), (902, "unseenword " * 3), (1, "repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS rid")
    got = maxent_lm.scored(df).toPandas()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = {}
    for i, t in rows:
        if not held(i):
            for w in [*words(t), None]:
                count[w] = count.get(w, 0) + 1
    total, types = sum(count.values()), len(count)
    want = sorted((i, held(i), len(words(t)) + 1, sum(w in count for w in [*words(t), None]), sum(np.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))) for w in [*words(t), None])) for i, t in rows)
    have = sorted((int(r.doc_id), bool(r.held_out), int(r.n_tokens), int(r.n_known), float(r.base_score)) for r in got.itertuples())
    assert [w[:4] for w in want] == [h[:4] for h in have]
    assert np.allclose([w[4] for w in want], [h[4] for h in have])
    assert (got.train_tokens == total).all() and np.isfinite(got.score).all() and (got.score < 0).all()
    assert maxent_lm.scored(df.limit(0)).count() == 0


def test_probabilities_add_up():
    """Over all known words and, in each cell, its words and one unseen."""
    rng = np.random.default_rng(2)
    n, rare = 5000, 700
    w = np.unique(rng.integers(1, 2**62, n + rare)).astype(np.uint64)
    rng.shuffle(w)
    c = np.sort(rng.integers(1, 100, len(w)))[::-1].copy()
    cell = rng.integers(0, maxent_lm.CELLS, len(w))
    far = slice(n, len(w))
    mass = np.full(maxent_lm.CELLS, 0.5) + np.bincount(cell[far], weights=c[far] + 0.5, minlength=maxent_lm.CELLS)
    m = maxent_lm.Model(w[:n], c[:n], int(c.sum()), len(w), mass)
    table = m.weights.astype(np.float32)
    table[m.nodes :] += rng.normal(0, 0.3, (1 << m.bits, maxent_lm.FAN)).astype(np.float32)
    leaves = n + maxent_lm.CELLS
    f = np.repeat(maxent_lm.context(w[:3], np.array([0, 3]))[:, 2:3], leaves, axis=1)
    p = 10 ** maxent_lm.log_probability(m, table, f, np.arange(leaves))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    leaf, count = m.look_up(w, cell)
    assert (leaf[:n] == np.arange(n)).all() and (count[:n] == c[:n]).all() and (leaf[far] == n + cell[far]).all() and (count[far] == -1).all()
    shares = p[:n].sum() + (p[leaf[far]] * (c[far] + 0.5) / mass[cell[far]]).sum() + (p[n:] * 0.5 / mass).sum()
    assert shares == pytest.approx(1, abs=1e-4)


# --- packed ids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=80), st.integers(0, 80), st.integers(0, 80))
def test_packing_round_trip(bits, ids, a, b):
    ids = np.array(ids, np.uint64) & np.uint64((1 << bits) - 1)
    raw = np.frombuffer(packed_ids.pack(ids, bits), np.uint8)
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert packed_ids.unpack(raw, bits, a, b).tolist() == ids[a:b].tolist()


def test_widths():
    assert [packed_ids.width(v) for v in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        packed_ids.pack(np.array([4]), 2)


def test_starts_follow_file_numbers(spark):
    """Names end in numbers of different lengths; a partition can have several files."""
    files = ["part-99998-a-c000.txt", "part-99999-a-c000.txt", "part-99999-a-c001.txt", "part-100000-a-c000.txt", "part-100000-a-c1000.txt"]
    rows = [(f"file:/x/{f}", 10 * i + k, k, 1, 0) for i, f in enumerate(files) for k in range(2)]
    got = packed_ids.with_starts(spark.createDataFrame(rows[::-1], "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long")).orderBy("doc_id").collect()
    assert [r.start for r in got] == list(range(10))


def test_word_encoder_equals_the_library():
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library, rng = packed_ids.WordEncoder(path), Tokenizer.from_file(path), random.Random(3)
    assert encoder.plain and encoder.bare is not None
    texts = ["".join(rng.choice("aAbt\u00e99 .,'s\u2019\"<|>#*\x01\u00f1\u00c9\u00df\u0301\u0130-\n\t\u65e5_\u00a0") for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [None, "", "<|endoftext|> a", "a<|startoftext|>b<|", "it's WE'RE", "x" * 5000]
    for part in (texts[:7], texts):
        flat, off = encoder.encode(pa.array(part, pa.string()), 2)
        for t, ids in zip(part, np.split(flat, off[1:-1]), strict=True):
            assert ids.tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2], t


def test_files_of_few_blocks(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(i, "one two three " * 40_000) for i in range(9)], "doc_id long, text string")
    packed_ids.write_ids(df.coalesce(1), str(tmp_path / "f"), path, file_blocks=2)
    docs = packed_ids.with_starts(packed_ids.read_ids(spark, str(tmp_path / "f"), ids=False))
    got = docs.orderBy("doc_id").collect()
    assert len({r.file for r in got}) >= 3
    assert [r.start for r in got] == [i * 120_001 for i in range(9)] and {r.n_tokens for r in got} == {120_001}


def test_packed_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, f"Some text, number {i}! It's <|endoftext|> é ὒ {'long ' * (i % 50)}") for i in range(200)] + [(500, ""), (501, None), (7, "again"), (None, "null id"), (502, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS file", "2 AS start").repartition(3)
    tok = Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in order]
    starts = np.cumsum([0] + [len(x) for x in ids])
    want = [(i, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(order, starts, ids)]
    got = [tuple(r) for r in packed_ids.round_trip(df, path).orderBy("start").collect()]
    assert got == want
    packed_ids.write_ids(df.coalesce(1), str(tmp_path / "f"), path)
    flat = [x for d in ids for x in d]
    files = [p.read_bytes() for p in sorted((tmp_path / "f").glob("part-*"))]
    whole = [packed_ids.read_range(f, 0, 10**9).tolist() for f in files]
    assert [x for w in whole for x in w] == flat
    assert packed_ids.read_range(files[0], 3, 9).tolist() == whole[0][3:9]
    back = {tuple(r.ids) for r in packed_ids.read_ids(spark, str(tmp_path / "f")).collect()}
    assert back == {tuple(x) for x in ids}
    assert packed_ids.round_trip(df.limit(0), path).count() == 0


# --- SentencePiece


ALPHABET = "ab  ▁éß東京\U0001f600\n\t<s></s>0x41thei  ń​"


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return sentencepiece_bpe.Model(f.read()), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=50), max_size=20))
def test_pieces_equal_the_library(piece, texts):
    model, sp = piece
    flat, off = model.encode(texts, True)
    back = model.decode(flat, off)
    for k, t in enumerate(texts):
        own = flat[off[k] : off[k + 1]].tolist()
        assert own == sp.encode(t) + [2] and back[k] == sp.decode(own)


def test_odd_pieces(piece):
    model, sp = piece
    texts = ["", "a" * 5000, " " * 3000, "<s></s><0x41>", "\x00 x", "▁", "thththth" * 500]
    flat, off = model.encode(texts)
    assert [flat[off[k] : off[k + 1]].tolist() for k in range(len(texts))] == [sp.encode(t) for t in texts]
    for ids in ([232, 163, 300], [2, 2, 300], [300, 0, 301], [258, 229, 133], [1, 29871, 300]):
        assert model.decode(np.array(ids), np.array([0, len(ids)])) == [sp.decode(ids)]


def test_piece_columns(spark, piece):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (2, None)], "doc_id long, text string").withColumn("ids", F.lit("old"))
    out = sentencepiece_bpe.encode_decode(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r.doc_id, r.ids, r.decoded) for r in out.collect()) == [(1, piece[1].encode("Hello world") + [2], "Hello world"), (2, [2], ""), (2, [2], "")]
    assert sentencepiece_bpe.encode_decode(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0

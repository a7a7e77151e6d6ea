"""Bounds that hold for odd inputs: landing, size of layouts, marks behind capitals, one hot key."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import html_text, mixing, ngram_join, packed_ids, sentencepiece_bpe
from lodestone.llm.queries import PIECE_MODEL

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_every_source_lands_on_its_target(spark):
    """Within one per cent, or within half of the shortest document where a source is that small."""
    rng = np.random.default_rng(2)
    sizes = {s: np.maximum(1, rng.lognormal(4.5, 1.3, n)).astype(int) for s, n in ((None, 30), ("a", 40), ("b", 60), ("c", 400), ("d", 3000), ("e", 25))}
    rows = [(i, s, int(x), int(rng.integers(1 << 62))) for s, xs in sizes.items() for i, x in enumerate(xs)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, h long")).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.min("size").alias("least"), F.max(F.col("copies") > 2).alias("over")).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert abs(r.taken - r.target) <= max(0.01 * r.target, r.least / 2) and not r.over, r


def test_long_documents_settle_and_probabilities_hold():
    rng = np.random.default_rng(1)
    x = np.sort(np.append(np.maximum(1, rng.lognormal(4, 1, 500)).astype(int), [20_000]))[::-1].astype(float)
    sums = np.zeros(len(x))
    for t in range(60):
        out = mixing.flight(np.full(len(x), 0.4), x, np.random.default_rng(t), True)
        assert set(np.unique(out)) <= {0.0, 1.0} and abs(out.sum() - 0.4 * len(x)) < 1
        sums += out
    assert 0.1 < sums[0] / 60 < 0.8 and sums.mean() / 60 == pytest.approx(0.4, abs=0.01)


def test_the_landing_is_the_best_choice():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        p, x = rng.random(n), rng.integers(1, 900, n).astype(float)
        out = mixing._landing(p, x, rng)
        every = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        errors = [abs(np.dot(c, x) - p @ x) for c in every if abs(sum(c) - p.sum()) < 1]
        assert abs(out @ x - p @ x) == pytest.approx(min(errors))


def words(text):
    return re.findall(r"\S+", text)


def test_wide_cells_and_many_columns_give_output_in_proportion():
    wide = "<table><tr><td>" + "w" * 20_000 + "<td>x" + "<tr><td>a<td>b" * 2000 + "</table>"
    far = "<table><tr>" + "<td>" + "<td>".join(["c" * 100] * 1000) + "<tr><td colspan=999><td>x" * 2000 + "</table>"
    for page in (wide, far):
        out = html_text.extract(page)
        assert len(out) < 20 * len(page)
        assert sorted(words(out)) == sorted(words(re.sub("<[^>]*>", " ", page)))
    assert html_text.extract("<table><tr><td>" + "y " * 80 + "<td>next<td>z<tr><td>s<td>t<td>u</table>").split("\n") == ["y " * 79 + "y", "   next  z", "s  t     u"]


def test_what_browsers_hide():
    page = "a<dialog>no</dialog><dialog open>yes</dialog><ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby><progress>no</progress><meter>no</meter>"
    assert words(html_text.extract(page)) == ["a", "yes", "kr"]


def test_marks_behind_capitals():
    random.seed(6)
    base = ["T", "J", "H", "W", "Y", "A", "t", "j", "I", "İ", "Å", "Ω", "ſ", "Ǆ", "가", "ᄀ", "ᅡ", " ", "\n", "1", ".", "'", "s", "\x00"]
    marks = ["̈", "̌", "̱", "̊", "́", "̣", "ͅ", "゙"]
    texts = ["T̈ J̌ H̱ W̊ Y̊", *("".join(random.choice(base) + "".join(random.choices(marks, k=random.choice([0, 0, 1, 2]))) for _ in range(random.randint(1, 12))) for _ in range(4000))]
    ids, off = packed_ids.WordEncoder(WORDS).encode(pa.array(texts), None)
    for i, want in enumerate(Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)):
        assert ids[off[i] : off[i + 1]].tolist() == want.ids, ascii(texts[i])


def test_one_hot_key_is_split_between_files(spark):
    rows = [(7, f"text {i % 5}") for i in range(4000)] + [(None, "x"), (1, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packed_ids.round_trip(df, WORDS).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1] + [7] * 4000 + [None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/hot"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed_ids.write_ids(df, path, WORDS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert packed_ids.read_ids(spark, path, ids=False).groupBy("file").count().count() > 1


def test_no_task_of_the_join_holds_two_workers(spark, monkeypatch):
    """An executor keeps every worker that its tasks ever held at once."""
    plans, components = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or components(edges))
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2 * 7 + k}" for k in range(40))) for i in range(20)], "doc_id long, text string")
    assert ngram_join.ngram_components(docs).filter("component_id <> doc_id").count() == 10
    assert plans and not any("InArrow" in p for p in plans)


def test_piece_workers_keep_no_words_after_a_task(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "TABLE_WORDS", 1000)
    with open(PIECE_MODEL, "rb") as f:
        model = sentencepiece_bpe.load(f.read())
    held, whole = [], " ".join(f"word{i}" for i in range(500))
    encode = model.encode
    monkeypatch.setattr(model, "encode", lambda *a: held.append(len(model.table)) or encode(*a))
    texts = [whole.replace("w", f"{i}w") for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(400))], names=["text", "doc_id"])
    with open(PIECE_MODEL, "rb") as f:
        run = sentencepiece_bpe._encoded(f.read(), True, True, ["doc_id", "ids", "decoded"])
    out = pa.Table.from_batches(run(iter([batch])))
    assert out["decoded"].to_pylist() == texts and max(held) > 1000 and len(held) > 2
    assert not model.table and not len(model.table_ids)


def test_word_table_keeps_what_was_met_most():
    encoder, library = packed_ids.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    slices = [" ".join(f"q{i}x{k} zebra{'' if i < 3 else 's'}" for k in range(50)) for i in range(9)]
    for text in slices:
        encoder.encode(pa.array([text]), None)
    encoder.trim(2)
    assert set(encoder.table) == {b"zebra", b"zebras"} and len(encoder.at) == 3 and len(encoder.ids) == encoder.at[-1]
    for text in slices:
        assert encoder.encode(pa.array([text]), None)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_workers_of_packed_ids_keep_few_words_after_a_task(spark):
    """Words that differ from task to task don't pile up in the workers, which executors keep."""
    texts = [" ".join(f"{a}{b:x}" for b in range(k * 2000, k * 2000 + 2000)) for k in range(20) for a in ("ka", "zu", "mo", "ti")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert packed_ids.round_trip(df, WORDS).count() == len(texts)

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.table) for e in packed_ids._encoders.values())])], names=["n"])

    most = max(r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect())
    assert most > 0  # the encoder is kept
    assert most <= packed_ids.KEPT_WORDS

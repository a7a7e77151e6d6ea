import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.operators.chunking import chunk_fixed, chunk_recursive, split_recursive, with_ids

texts = st.text(alphabet=st.sampled_from("ab é\n .  \n"), max_size=300)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 40), st.integers(0, 39))
def test_invariants(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = split_recursive(text, size, overlap)
    assert chunks == split_recursive(text, size, overlap)
    assert all(c and c == c.strip() and len(c) <= size for c in chunks)
    if not text.strip():
        assert chunks == []
    elif len(text) <= size:
        assert chunks == [text.strip()]
    at, covered = 0, set()
    for c in chunks:  # in order, and together they hold every character but white space
        found = text.find(c, at)
        assert found >= 0
        covered.update(range(found, found + len(c)))
        at = found
    plain = sorted(x for x in text if not x.isspace())
    assert sum(not x.isspace() for c in chunks for x in c) >= len(plain)


def test_overlap_is_carried():
    text = " ".join(f"w{i:03d}" for i in range(200))
    chunks = split_recursive(text, 100, 30)
    for a, b in zip(chunks, chunks[1:]):
        shared = max(k for k in range(len(b) + 1) if a.endswith(b[:k]))
        assert 0 < shared <= 30


def test_bad_overlap():
    with pytest.raises(ValueError):
        split_recursive("x", 10, 10)


def test_paragraphs_first():
    assert split_recursive("aa bb\n\ncc dd", 8, 0) == ["aa bb", "cc dd"]


def test_frames(spark):
    rows = [(1, "x" * 2500), (2, ""), (3, None), (4, "short"), (5, "y" * 1000), (6, "z" * 1001)]
    df = spark.createDataFrame(rows, "id int, text string")
    fixed = {r[0]: r[1] for r in chunk_fixed(df).groupBy("id").agg(F.sort_array(F.collect_list(F.length("chunk_text")))).collect()}
    assert fixed == {1: [900, 1000, 1000], 4: [5], 5: [1000], 6: [201, 1000]}
    got = {r.id: r.n for r in chunk_recursive(df).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {1, 4, 5, 6}


def test_equal_chunks_become_one(spark):
    df = spark.createDataFrame([(1, "f", 0, "a"), (1, "f", 1, "a"), (1, "f", 2, "b"), (2, "f", 0, "a")], "kb_id int, file_name string, chunk_index int, chunk_text string")
    got = sorted((r.kb_id, r.chunk_text, r.chunk_index, r.dup_count) for r in with_ids(df).collect())
    assert got == [(1, "a", 0, 2), (1, "b", 2, 1), (2, "a", 0, 1)]


def test_preview_takes_documents_before_uploads(spark):
    table = lambda rows: spark.createDataFrame(rows, "id long, file_name string, text string")
    docs, uploads = table([(1, "a", "one two three four"), (2, "b", None)]), table([(1, "x", "never"), (3, "c", "five six")])
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "id long")
    got = sorted(map(tuple, chunking.preview(asked, docs, uploads, 8, 0).collect()))
    assert got == [(1, "a", 0, "one two"), (1, "a", 1, "three"), (1, "a", 2, "four"), (3, "c", 0, "five six")]
    chunking.register_splitter(spark, "pieces")
    assert spark.sql("SELECT count(*) n FROM VALUES ('a b c'), (NULL) t(x), LATERAL pieces(x, 1, 0)").head().n == 3

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import maxent_lm
from lodestone.llm.common import text_chunks


def features(text):
    ((_, _, data, off),) = text_chunks(pa.array([text]))
    h, _, at = maxent_lm.tokens(data, off)
    return maxent_lm.context(h, at)


def test_context_holds_the_skip_features():
    """The word after "a b c" sees a change of a word in two skip features, of b in two, of c in three."""
    own = features("a b c d")[:, 3]
    assert len(own) == 5
    changed = [np.flatnonzero(own != features(t)[:, 3]).tolist() for t in ("x b c d", "a x c d", "a b x d")]
    assert changed == [[3, 4], [1, 2], [0, 1, 4]]


def test_tree_of_classes():
    """Every leaf has a path of its own, and the shares of a node's classes are those of its leaves."""
    mass = np.sort(np.random.default_rng(1).zipf(1.3, 3000).astype(float))[::-1]
    at, node, cls, shares = maxent_lm.class_tree(mass)
    paths = [tuple(zip(node[a:b].tolist(), cls[a:b].tolist(), strict=True)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert len(set(paths)) == 3000 and all(p[0][0] == 0 for p in paths)
    assert not any(p[: len(q)] == q for p, q in zip(paths[1:], paths, strict=False))
    product = [np.prod([shares[n, c] for n, c in p]) for p in paths]
    assert np.allclose(product, mass / mass.sum())


@pytest.fixture(scope="module")
def sentences(spark):
    """A word is told by the one before it; the last documents are copies of one text."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        word, out = int(rng.integers(400)), []
        for _ in range(60):
            out.append(f"w{word}")
            word = (word * 7 + int(rng.integers(3))) % 400
        rows.append((i, " ".join(out)))
    rows += [(2000 + i, rows[3][1]) for i in range(700)] + [(None, rows[5][1]), (None, None), (4000, ""), (4001, "long " * 200_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_context_helps_on_held_out_texts(sentences):
    got = maxent_lm.scored(sentences).filter("held_out AND doc_id < 1500").agg({"score": "sum", "base_score": "sum"}).head()
    assert got["sum(score)"] > 0.7 * got["sum(base_score)"]


def test_scores_do_not_depend_on_partitions(sentences):
    pick = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, round(r.score, 6)) for r in maxent_lm.scored(df).collect()), key=str)
    assert pick(sentences) == pick(sentences.repartition(7))


def small_model(words=3000, seed=2):
    rng = np.random.default_rng(seed)
    h = rng.integers(1 << 63, size=words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.sort(rng.zipf(1.4, words).clip(1, 10_000))[::-1]
    return maxent_lm.Model(h, counts, int(counts.sum()), words, np.full(maxent_lm.CELLS, 2.0)), h, counts


def test_words_are_found_by_buckets():
    model, h, counts = small_model()
    other = h ^ np.uint64(1)
    asked = np.concatenate([h, other, np.array([0, 2**64 - 1], np.uint64)])
    leaf, count = model.look_up(asked, np.arange(len(asked)) % maxent_lm.CELLS)
    assert leaf[:3000].tolist() == list(range(3000)) and count[:3000].tolist() == counts.tolist()
    assert (count[3000:] == -1).all() and (leaf[3000:] >= 3000).all()
    assert len(model.begin) <= 2 * 4096
    assert maxent_lm.Model(h[:0], counts[:0], 0, 0, np.full(maxent_lm.CELLS, 2.0)).look_up(h[:2], np.array([3, 4]))[0].tolist() == [3, 4]


def test_a_step_equals_plain_sums():
    """Rows begin with a cache line, and a batch moves every row by the sum over its instances."""
    model, h, _ = small_model()
    tokens = h[np.random.default_rng(5).zipf(1.3, 1500).clip(1, 3000) - 1]
    cell, at = np.zeros(1500, np.int64), np.array([0, 1, 700, 1500])
    table, met = maxent_lm._table(model.weights), model.met.copy()
    assert table.ctypes.data % 64 == 0 and np.array_equal(table, model.weights.astype(np.float32))
    want = table.astype(np.float64)
    leaf, _ = model.look_up(tokens, cell)
    token, node, cls = model.paths(leaf)
    rows = model.rows(maxent_lm.context(tokens, at), token, node)
    g = np.exp(want[rows].sum(axis=0))
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(cls)), cls] -= 1
    total, uses = np.zeros_like(want), np.zeros(len(want))
    np.add.at(uses, rows.ravel(), 1)
    np.add.at(total, rows.ravel(), np.tile(g, (len(rows), 1)))
    want -= total * (maxent_lm.STEP / (uses + maxent_lm.DAMP))[:, None]
    maxent_lm.learn(model, table, met, tokens, cell, at)
    assert np.array_equal(met, uses) and uses.max() > 100
    assert np.allclose(table, want, atol=1e-4)
    once, again = maxent_lm._table(model.weights), model.met.copy()
    maxent_lm.learn(model, once, again, tokens[:1], cell[:1], np.array([0, 1]))  # rows that occur once alone
    assert again.sum() > 0


def test_words_are_counted_once():
    texts = pa.array(["a B b", None, "", "c " * 1000 + "a"])
    got = pa.Table.from_batches(maxent_lm._counted(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    assert sorted(got["c"].to_pylist()) == [2, 2, 4, 1000]

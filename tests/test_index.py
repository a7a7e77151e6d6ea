"""The stored text index: blocks that are skipped, segments, tombstones, merges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.config import Settings
from lodestone.operators import index as I
from lodestone.operators.search import Index
from lodestone.operators.versions import Conflict

ITEMS = "kb_id int, item_id long, hash string, text string"


def corpus(n, seed=1, kbs=3, start=0):
    """Words by a steep law, so that some stand in most items and some in few."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    law = [1 / (k + 1) for k in range(60)]
    return [(i % kbs, i, f"h{seed}-{i}", " ".join(rng.choices(words, law, k=rng.randint(0, 40)))) for i in range(start, start + n)]


def table(rows):
    t = [r[3].split() for r in rows]
    return pa.table({"kb_id": pa.array([0] * len(rows), pa.int32()), "shard": pa.array([0] * len(rows), pa.int32()), "item_id": pa.array([r[1] for r in rows]), "hash": pa.array([r[2] for r in rows]), "terms": pa.array(t, pa.list_(pa.string())), "tf": pa.nulls(len(rows), pa.binary())})


def shard_of(rows, dead=(), **how):
    made = I.shard_rows(table(rows))
    made = made.filter(pa.compute.is_null(made["terms"]))
    graves = pa.array([list(dead)] + [None] * (made.num_rows - 1), pa.list_(pa.int32()))
    return I.Shard(made.append_column("dead", graves), **how)


def brute(rows, terms, kind, dead=(), model="tfidf2"):
    out, mean = [], sum(len(r[3].split()) for r in rows) / len(rows)
    for r in rows:
        words = r[3].split()
        tf = {t: words.count(t) for t, _ in terms if t in words}
        if r[1] in dead or not tf:
            continue
        if kind == I.SPARSE:
            norm = math.sqrt(sum(math.log(1 + words.count(t)) ** 2 for t in set(words)))
            s = sum(w * math.log(1 + tf[t]) for t, w in terms if t in tf) / norm
        elif model == "bm25":
            s = sum(w * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t, w in terms if t in tf)
        else:
            s = sum(w * tf[t] for t, w in terms if t in tf)
        out.append((-round(s, 6), r[1]))
    return sorted(out)


def best(shard, asked, pool, kind):
    """(items, scores, pieces read, pieces) for each list of terms, all answered at once."""
    column = {t: i for i, t in enumerate(shard.terms.to_pylist())}
    weights = np.zeros((len(asked), len(column)))
    for i, terms in enumerate(asked):
        for t, w in terms:
            if t in column:
                weights[i, column[t]] = w
    q, p, s, read, of = shard.best(weights, pool, kind)
    return [(shard.items[p[q == i]].tolist(), s[q == i], read[i], of[i]) for i in range(len(asked))]


@pytest.mark.parametrize("model", ["tfidf2", "bm25"])
@pytest.mark.parametrize("kind", [I.EXACT, I.SPARSE])
def test_the_best_of_a_shard(kind, model):
    rows = corpus(1500, kbs=1)
    dead = set(range(0, 1500, 7))
    mean = sum(len(r[3].split()) for r in rows) / len(rows)
    shard = shard_of(rows, dead, model=model, mean=mean)
    rng = random.Random(5)
    asked = [[(f"w{k}", rng.random() * 3) for k in rng.sample(range(60), rng.randint(1, 6))] for _ in range(12)] + [[("absent", 1.0)], []]
    every = [brute(rows, terms, kind, dead, model) for terms in asked]
    for pool in (1, 24, 5000):
        for (items, scores, read, of), want in zip(best(shard, asked, pool, kind), every, strict=True):
            want = want[:pool]
            assert items == [w[1] for w in want] and np.allclose(-scores, [w[0] for w in want], atol=2e-6)
            assert read <= of


def test_blocks_are_skipped():
    """A term with a few strong items: the blocks of a common term that can't reach them stay unread."""
    rows = [(0, i, f"h{i}", "common " * (9 if i % 2000 == 0 else 1) + ("rare " * 5 if i % 2000 == 0 else "")) for i in range(20_000)]
    shard = shard_of(rows)
    (items, _, read, of), (none, _, *zero), (_, _, few, ten) = best(shard, [[("common", 0.1), ("rare", 9.0)], [("absent", 1.0)], [("rare", 1.0)]], 5, I.EXACT)
    assert items == [0, 2000, 4000, 6000, 8000] and none == [] and zero == [0, 0]
    assert of == 79 + 10 and read < of / 2 and few <= ten == 10


def hits(ix, spark, scope=None):
    queries = spark.createDataFrame([(1, "w1 w2 w30"), (2, "W50! w51"), (3, "absent"), (4, "")], "query_id long, text string")
    scope = spark.createDataFrame(scope or [(q, k) for q in (1, 2, 3, 4) for k in range(3)], "query_id long, kb_id int")
    found = ix.text_hits(queries, scope, 24, [I.EXACT, I.SPARSE]).filter(f"kind <> {I.SEEN}").collect()
    best: dict = {}
    for r in found:
        best.setdefault((r.kind, r.query_id) if r.kind == I.EXACT else (r.kind, r.query_id, r.kb_id), []).append((-r.score, r.item_id, r.hash))
    return {k: sorted(v)[:24] for k, v in best.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def test_segments_give_what_a_rebuild_gives(spark, tmp_path):
    rows = {r[1]: r for r in corpus(300)}
    ix = Index(frame(spark, list(rows.values())), path=str(tmp_path / "a"))
    for step in range(3):
        changed = [(r[0], r[1], f"n{step}-{r[1]}", r[3] + f" w{50 + step} w1") for r in list(rows.values())[step * 11 :: 97]] + corpus(3, seed=step + 9, start=1000 + 10 * step)
        gone = [k for k in rows if k % 53 == step]
        before = set(ix.versions.names("rows"))
        ix.upsert(frame(spark, changed))
        assert len(set(ix.versions.names("rows")) - before) == 1
        rows |= {r[1]: r for r in changed}
        ix.delete(spark.createDataFrame([(k,) for k in gone], "item_id long"))
        rows = {k: r for k, r in rows.items() if k not in gone}
    fresh = Index(frame(spark, list(rows.values())), path=str(tmp_path / "b"))
    same = lambda: ({r.term: r.df for r in ix.frequencies().collect()} == {r.term: r.df for r in fresh.frequencies().collect()}, hits(ix, spark) == hits(fresh, spark), ix.items == fresh.items, ix.content["tokens"] == fresh.content["tokens"])
    assert all(same()) and len(ix.content["segments"]) == 4
    assert ix.merge() == [] and ix.merge(at_least=2) and len(ix.content["segments"]) < 4 and all(same())
    assert ix.merge(all=True) and len(ix.content["segments"]) == 1 and ix.content["tombs"] == [] and all(same())
    assert Index.open(spark, str(tmp_path / "a")).content == ix.content
    assert hits(ix, spark, [(1, 2)]).keys() == {(0, 1), (1, 1, 2)}


def test_an_upsert_reads_and_writes_little(spark, tmp_path):
    ix = Index(frame(spark, corpus(400)), path=str(tmp_path / "a"))
    first = ix.content["segments"][0]["name"]
    for number in [n for n in ix.versions.names(f"rows/{first}") if n.startswith("bucket=") and int(n[7:]) >= 0]:
        ix.versions.remove(f"rows/{first}/{number}")  # postings of the first segment
    ix.upsert(frame(spark, corpus(4, seed=3, start=100)))
    assert [s["items"] for s in ix.content["segments"]] == [400, 4] and ix.items == 400


def test_writers_conflict_and_vectors_follow(spark, tmp_path):
    rows = corpus(30)
    vec = lambda rows, v: spark.createDataFrame([(r[0], r[1], r[2], [float(v), 1.0]) for r in rows], "kb_id int, item_id long, hash string, vector array<double>")
    ix = Index(frame(spark, rows), vec(rows, 1), str(tmp_path / "a"))
    other = Index.open(spark, str(tmp_path / "a"))
    ix.upsert(frame(spark, rows[:2]), vec(rows[:2], 5))
    with pytest.raises(Conflict):
        other.upsert(frame(spark, rows[:1]))
    assert other.refresh().content == ix.content
    got = {r.item_id: r.vector[0] for r in ix.vectors().collect()}
    assert len(got) == 30 and got[0] == got[1] == 5.0 and got[2] == 1.0
    ix.merge(all=True)
    assert {r.item_id: r.vector[0] for r in ix.vectors().collect()} == got


def test_empty_and_null_texts(spark, tmp_path):
    ix = Index(frame(spark, [(0, 1, "a", None), (0, 2, "b", ""), (None, 3, "c", "w1"), (0, 4, "d", "w1 w1 w2")]), path=str(tmp_path / "a"))
    assert ix.items == 4 and {r.term: r.df for r in ix.frequencies().collect()} == {"w1": 2, "w2": 1}
    assert [h[1] for h in hits(ix, spark)[0, 1]] == [4]
    empty = Index(frame(spark, []), path=str(tmp_path / "b"))
    assert empty.items == 0 and hits(empty, spark) == {}
    q = spark.createDataFrame([(1, "w1", None)], "query_id long, text string, vector array<double>")
    assert empty.search(q, spark.createDataFrame([(1, 0, 0)], "query_id long, kb_id int, kb_pos int"), Settings()).count() == 0

"""Merkle manifests against a plain Python version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(leaves, fanout):
    """The root, and each leaf's siblings by level as (left, right)."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            a = i // fanout * fanout
            steps[k].append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
        level = [digest(*level[a : a + fanout]) for a in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], steps


def plain(rows, fanout):
    leaf = lambda r: digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out, subroots = [], []
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        held = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, steps = climb([leaf(r) for r in held], fanout)
        subroots.append(root)
        out.append([(r[0], leaf(r), root, step) for r, step in zip(held, steps, strict=True)])
    root, over = climb(subroots, fanout)
    return [(i, d, sub, root, step + over[k]) for k, rows in enumerate(out) for i, d, sub, step in rows]


def check(spark, rows, fanout, parts=7):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts)
    got, groups, over = merkle.manifest(df, "doc_id", "source", FIELDS, fanout=fanout)
    key = lambda r: tuple(map(str, r))
    found = sorted(((r.id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in got.collect()), key=key)
    assert found == sorted(plain(rows, fanout), key=key)
    return df, groups, over


def documents(n, sources, seed):
    random.seed(seed)
    source = lambda: random.choices([f"s{k}" for k in range(sources)] + [None, "é", ""], [sources * 2] + [1] * (sources + 2))[0]
    return [(random.choice([None, k, k // 2, -k]), source(), random.choice(["en", None]), random.choice([None, 3]), random.choice(["Text", "", None, "Ä\n", "7:x"])) for k in range(n)]


@pytest.mark.parametrize("n, sources, fanout, parts", [(700, 3, 16, 7), (120, 30, 3, 40), (1, 1, 16, 1)])
def test_equals_the_plain_version(spark, n, sources, fanout, parts):
    check(spark, documents(n, sources, n), fanout, parts)


def test_repeated_rows_and_one_hot_group(spark):
    _, groups, _ = check(spark, [(5, "s", "en", 1, "same")] * 600 + [(k, "s", "en", 1, "x") for k in range(300)] + [(1, "t", None, 2, "y")], 16)
    assert {(r.tree, r.n) for r in groups.roots().collect()} == {("=s", 900), ("=t", 1)}
    nodes = groups.nodes.collect()
    assert len(nodes) == len({(r.tree, r.level, r.idx) for r in nodes}) == 57 + 4 + 1


def test_tampering_is_found(spark):
    rows = documents(200, 3, 9)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    changed = merkle.row_digest([*(F.col(c) for c in FIELDS[:-1]), F.translate("text", "T", "t")])
    got, _, _ = merkle.manifest(df, "doc_id", "source", FIELDS, {"changed": changed, "was": F.col("text")})
    found = got.select("was", "root", merkle.folded(F.col("changed"), F.col("steps")).alias("folded")).collect()
    assert all((r.folded == r.root) == (r.was != "Text") for r in found) and len(found) == 200


def test_empty_tables_extra_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "x", 9, 8, 7)], "doc_id long, source string, lang string, n_chars long, text string, tree int, `a.b` int, idx int")
    got, groups, over = merkle.manifest(df, "doc_id", "source", FIELDS, {"more": F.col("tree")})
    row = got.head()
    assert row.more == 9 and row.leaf == row.subroot == row.root and row.steps == []
    assert merkle.manifest(df.limit(0), "doc_id", "source", FIELDS)[0].collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(df, "doc_id", "source", FIELDS, {"tree": F.col("tree")})


@pytest.mark.parametrize("fanout", [2, 5, 16])
def test_any_cut_leaves_every_run_or_its_open_nodes(fanout):
    """Stretches of a tree: finished runs are right, and what stays open is less than a run on each side of a level."""
    random.seed(fanout)
    for n in (2, 31, 256, 700):
        leaves = [digest(str(k)) for k in range(n)]
        cuts = [0, *sorted(random.sample(range(1, n), min(5, n - 1))), n]
        whole: list = []
        merkle.Range("t", n, 0, fanout, whole).add(leaves)
        right = {(r[2], r[3]): r[4] for r in whole}
        for a, z in zip(cuts, cuts[1:], strict=False):
            out: list = []
            part = merkle.Range("t", n, a, fanout, out)
            for k in range(a, z, 3):
                part.add(leaves[k : min(k + 3, z)])
            part.close()
            runs, loose = [r for r in out if r[5] is not None], [r for r in out if r[5] is None]
            assert all(right[r[2], r[3]] == r[4] for r in runs)
            for level in {r[2] for r in loose}:
                assert sum(r[2] == level for r in loose) <= 2 * (fanout - 1)

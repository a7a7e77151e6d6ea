"""Fill-in-middle against a plain Python version."""

import hashlib
import random
import re

import pytest

from lodestone.llm import infill
from lodestone.llm.infill import Infill


def plain(doc_id, text, how=Infill()):
    text = text or ""
    units = re.findall(how.unit, text)
    n = len(units)
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    marks = (how.prefix, how.suffix, how.middle)
    if not text or any(m in text for m in marks) or h[2] % 100 >= how.percent:
        return (n, "plain", None, None, text, text)
    if h[3] % 100 < how.spm_percent:
        return (n, "spm", len(pre), len(mid), marks[1] + suf + marks[0] + pre + marks[2] + mid, text)
    return (n, "psm", len(pre), len(mid), marks[0] + pre + marks[1] + suf + marks[2] + mid, text)


def texts():
    random.seed(4)
    fixed = [None, "", "a", "\n", "\n\n\n", "a\nb", "a\nb\n", "x<P>y\n", "<S>", "a\n<M>", "P>\nS>\n<", "a<\nP>b\n", "é\n🦆\x00\n\r\né", "x" * 400_000, "line\n" * 120_000]
    parts = ["a", "\n", "é", "🦆", "<", "P>", "S>", "M>", " "]
    return fixed + ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(400)]


@pytest.mark.parametrize("how", [Infill(), Infill(seed=3, percent=40, spm_percent=90), Infill(unit=r"[^ ]* |[^ ]+", prefix="[pre]", suffix="{suf}", middle="(mid)")])
def test_equals_the_plain_version(spark, how):
    rows = list(enumerate(texts())) + [(None, "a\nb\nc\n"), (None, None), (7, "a\nb"), (7, "a\nb")]
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), how=how).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *plain(i, t, how)) for i, t in rows), key=key)


def test_stored_outputs_are_restored(spark):
    rows = list(enumerate(texts()))
    out = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "form", "output")
    back = {r.doc_id: r.restored for r in infill.restored(out).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a\nb\n", "kept", "gone", 5, "t")], "doc_id long, text string, `a.b` string, output string, batch int, id string")
    got = infill.fill_in_middle(df)
    assert got.columns == ["doc_id", "a.b", "batch", "id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    row = got.head()
    assert (row["a.b"], row.batch, row.id, row.restored) == ("kept", 5, "t", "a\nb\n")
    assert infill.fill_in_middle(df.limit(0)).collect() == []


def test_ambiguous_sentinels_are_refused():
    for marks in (("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<<", "<S>", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            Infill(prefix=marks[0], suffix=marks[1], middle=marks[2])

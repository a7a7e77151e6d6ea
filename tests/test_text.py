import base64
import json
import re
import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).head()[0]


def many(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(f(F.col("c"))).collect()]


def test_uuid5(spark):
    names = ["", "a", "é", "x" * 100, *map(str, range(200))]
    assert many(spark, T.uuid5_oid, names) == [str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names]


def test_strip_and_tokens(spark):
    assert many(spark, T.strip, ["  a b\t\n", "", "x", None]) == ["a b", "", "x", None]
    assert many(spark, T.tokens, ["Ab_c d-É 12", "", None]) == [["ab_c", "d", "é", "12"], [], None]


def test_extension_and_content_type(spark):
    names = ["a.PDF", "b.tar.md", "noext", ".hidden", "dir.x/file", "x.docx", "y.TXT", "..a.b"]
    assert many(spark, T.extension, names) == [".pdf", ".md", "", "", "", ".docx", ".txt", ".b"]
    assert many(spark, T.content_type, ["a.md", "a.zip"]) == ["text/markdown", "application/octet-stream"]


def test_safe_names_icons_sizes(spark):
    assert many(spark, T.safe_file_name, ["a b/(c)é_1-2.txt"]) == ["abcé_1-2.txt"]
    assert one(spark, T.icon(F.col("a"), F.col("b")), a="text/plain", b="n.log") == "log"
    assert one(spark, T.icon(F.col("a"), F.col("b")), a="application/PDF", b="n.log") == "pdf"
    assert one(spark, T.size_mb(F.col("a")), a=5 * 1024 * 1024) == "5.00 MB"
    assert one(spark, T.size_kb(F.col("a")), a=1536) == "1.5 KB"


def test_think_blocks(spark):
    got = [one(spark, T.without_think(F.col("a"), F.col("b")), a=a, b="q") for a in ("<think>x\ny</think> z ", "<think>x</think>", "<think>open", " w ")]
    assert got == ["z", "q", "<think>open", "w"]
    split = [tuple(one(spark, T.think_split(F.col("a")), a=a)) for a in ("<think> a </think> b ", "<think>a", "b <think>")]
    assert split == [("a", True, "b"), ("a", False, ""), (None, False, "b <think>")]


def test_sentinels(spark):
    c = "e__LLM_RESPONSE__one__LLM_RESPONSE__two"
    assert many(spark, T.history_text, [c, "plain"]) == ["two", "plain"]
    assert many(spark, T.shown_text, [c, "plain"]) == ["one", "plain"]


def test_preview(spark):
    c = "x__LLM_RESPONSE__<think>t\nu</think># Head\n**bold** _it_ `code` [l](u) [citation:3]  end  "
    assert many(spark, T.preview, [c]) == ["Head bold it code l end"]


def test_citations(spark):
    got = many(spark, T.citation_links, ["[[citation:1]]", "[Citation:2]", "[[Citation:3]]", "[citation:4]]", "[1]"])
    assert got == ["[citation](1)", "[citation](2)", "[citation](3)", "[citation](4)", "[1]"]


def test_identity(spark):
    asked = ["who are you", " WHAT is  your name ? ", "What's your purpose", "who are you really", "", None]
    assert many(spark, T.is_identity, asked) == [True, True, True, False, False, None]


def test_base64_and_ascii_json(spark):
    texts = ["é" * 200, "a\U0001f600b", "plain", ""]
    assert many(spark, T.base64_line, texts) == [base64.b64encode(t.encode()).decode() for t in texts]
    got = many(spark, lambda c: T.ascii_json(F.to_json(F.struct(c.alias("t")))), texts)
    assert all(g.isascii() for g in got)
    assert [json.loads(g)["t"] for g in got] == texts


def test_metadata_hash_ignores_order(spark):
    a, b = (F.create_map(F.lit(x), F.lit("1"), F.lit(y), F.lit("2" if x == "k" else "2")) for x, y in (("k", "l"), ("k", "l")))
    assert one(spark, T.versioned_hash(F.col("t"), a) == T.versioned_hash(F.col("t"), b), t="x")
    row = spark.sql("select map('a','1','b','2') m, map('b','2','a','1') n").select(T.canonical_metadata(F.col("m")) == T.canonical_metadata(F.col("n"))).head()
    assert row[0]


def test_shortened_and_ints(spark):
    assert many(spark, T.shortened, ["x" * 301, "y"]) == ["x" * 300 + "...", "y"]
    assert many(spark, T.ints, ["1, 2,3"]) == [[1, 2, 3]]


def test_identity_pattern_is_anchored():
    assert all(re.compile(p) for p in T.IDENTITY)

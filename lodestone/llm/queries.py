"""Queries over the standard tables, one for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, html_text, infill, maxent_lm, maxscore, merkle, mixing, ngram_join, packed_ids, sentencepiece_bpe, toxicity, vector_neardup, warc_zst
from lodestone.llm.common import staged

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    vectors = staged(vectors.withColumn("row", F.monotonically_increasing_id()), "weighted-vectors")
    found = maxscore.top_k(vectors, vectors.filter(F.col("id") % 50 == 0), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "html"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zst.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scored(table(spark, sf_dir, "documents"))


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.round_trip(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = byte_bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_RANKS)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.row_digest([*(F.col(c) for c in fields[:-1]), lower]))
    rows, _, _ = merkle.manifest(docs, "doc_id", "source", fields, {"tampered": tampered})
    rows = rows.select("id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("steps")), 256).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxscore_topk": op1_maxscore_topk,
    "op2_html_text": op2_html_text,
    "op3_ngram_join": op3_ngram_join,
    "op4_source_mix": op4_source_mix,
    "op5_toxicity": op5_toxicity,
    "op6_warc_archive": op6_warc_archive,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_packed_ids": op8_packed_ids,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_vector_neardup": op10_vector_neardup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _merkle_sql(levels: int = 8) -> str:
    """A level at a time, for trees of up to 16 ** levels leaves; a tree that has one node left passes through. Crc32 is no
    function of the engine, so it is folded from its polynomial's table over the digits of an id."""
    table = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table[i] = c
    step = "CAST(xor(c >> 8, crc_table[CAST(xor(c & 255, x) AS INTEGER) + 1]) AS BIGINT)"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}"]
    leaf = "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    out = [
        f"""crc AS (SELECT {[*table]} AS crc_table),
d AS (SELECT doc_id, source, {leaf.format(text="text")} AS leaf, {leaf.format(text=lower)} AS low,
             xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, x: {step}), 4294967295) % 5 = 0 AS hit FROM documents, crc),
k AS (SELECT row_number() OVER () AS k, *, CASE WHEN hit THEN low ELSE leaf END AS shown FROM d),
t0 AS (SELECT k, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
              count(*) OVER (PARTITION BY source) AS n, leaf AS digest FROM k)"""
    ]

    def climb(name: str) -> None:
        for i in range(levels):
            w = "OVER (PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
            out.append(f"""{name}s{i} AS (SELECT tree, idx, n > 1 AS step,
    coalesce(string_agg(digest, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i})""")
            out.append(f"""{name}{i + 1} AS (SELECT tree, idx // 16 AS idx, (max(n) + 15) // 16 AS n,
    CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE max(digest) END AS digest FROM {name}{i} GROUP BY tree, idx // 16)""")

    def follow(name: str, start: str, at: str) -> str:
        """The rows of start (tree, idx, proof, shown) with what the levels add to proof and make of shown."""
        for i in range(levels):
            out.append(f"""{at}{i} AS (SELECT p.* REPLACE (p.idx // 16 AS idx, CASE WHEN s.step THEN p.proof || s.l || s.r ELSE p.proof END AS proof,
    CASE WHEN s.step THEN sha256(s.l || p.shown || s.r) ELSE p.shown END AS shown) FROM {start} p JOIN {name}s{i} s ON s.tree = p.tree AND s.idx = p.idx)""")
            start = f"{at}{i}"
        return start

    climb("t")
    out.append(f"u0 AS (SELECT '' AS tree, tree AS member, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest FROM t{levels})")
    climb("u")
    out.append("p AS (SELECT k.doc_id, k.leaf, t0.tree, t0.idx, '' AS proof, k.shown FROM t0 JOIN k ON k.k = t0.k)")
    inner = follow("t", "p", "pt")
    out.append(f"q AS (SELECT p.doc_id, p.leaf, t.digest AS subroot, '' AS tree, u0.idx, p.proof, p.shown FROM {inner} p JOIN t{levels} t ON t.tree = p.tree JOIN u0 ON u0.member = p.tree)")
    outer = follow("u", "q", "pu")
    last = f"""SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, shown AS folded_root, shown = root.digest AS verified
FROM {outer}, u{levels} AS root"""
    return "WITH " + ",\n".join(out) + "\n" + last


SQL: dict[str, str] = {
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     s AS (SELECT *, string_split(text, chr(10)) AS cut FROM d),
     c AS (SELECT *, CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN len(cut) - 1 ELSE len(cut) END AS n FROM s),
     b AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
                  text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 AS whole,
                  CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm FROM c),
     e AS (SELECT *, CASE WHEN least(x, y) = 0 THEN 0 WHEN least(x, y) = n THEN length(text) ELSE length(array_to_string(cut[1:least(x, y)], chr(10))) + 1 END AS a,
                  CASE WHEN greatest(x, y) = 0 THEN 0 WHEN greatest(x, y) = n THEN length(text) ELSE length(array_to_string(cut[1:greatest(x, y)], chr(10))) + 1 END AS z FROM b),
     o AS (SELECT *, text[1:a] AS pre, text[a + 1:z] AS mid, text[z + 1:] AS suf FROM e)
SELECT doc_id, n, CASE WHEN whole THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT whole THEN a END AS prefix_chars, CASE WHEN NOT whole THEN z - a END AS middle_chars,
       sha256(CASE WHEN whole THEN text WHEN spm THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM o""",
    "op13_merkle_manifest": _merkle_sql(),
    "op1_maxscore_topk": """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     s AS (SELECT q.n AS q_n, q.vec_id AS query_id, d.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(q.w, d.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.n <> d.n)
SELECT query_id, CAST(row_number() OVER (PARTITION BY q_n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op3_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
     n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
     i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v)
SELECT n.doc_id, n.n AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n""",
    "op10_vector_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
     u AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v
           WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
           WHERE a.norm > 0 AND b.norm > 0 AND list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.98),
     r AS (SELECT vec_id AS v, vec_id AS m FROM v UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v),
     c AS (SELECT v, min(m) AS component_id FROM r GROUP BY v),
     k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.v AS vec_id, coalesce(k.n, 0) AS n_links, c.component_id, c.v = c.component_id AS kept FROM c LEFT JOIN k ON k.a = c.v""",
    "op6_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
     r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r""",
}

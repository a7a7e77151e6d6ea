"""DuckDB SQL with the results that the queries of this package must have."""

from __future__ import annotations

KB = "CAST(substr(source, 4) AS INTEGER)"
KBS = f"kbs AS (SELECT DISTINCT {KB} AS id, source AS name, {KB} % 4 AS user_id FROM documents)"
DOCS = f"docs AS (SELECT doc_id AS id, {KB} AS kb, 'doc_' || doc_id || '.txt' AS file_name, strlen(text) AS file_size, sha256(text) AS file_hash, text FROM documents)"
TOKEN = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
MSG = "msg AS (SELECT conv_id * 1000 + turn AS id, conv_id AS chat_id, role, text AS content FROM conversations)"
NTH = "greatest(0, CAST(ceil((length(text) - 200) / 800.0) AS INTEGER) - 1)"


def chunks(source: str, name: str = "chunks") -> str:
    """Fixed chunks of a relation with (kb, id, file_name, text), one row for each chunk id."""
    return f"""{name}_rows AS (SELECT kb, id AS document_id, file_name, i AS chunk_index, substr(text, i * 800 + 1, 1000) AS chunk_text
        FROM (SELECT *, unnest(CASE WHEN length(text) = 0 THEN [] ELSE range(0, {NTH} + 1) END) AS i FROM {source})),
      {name}_ids AS (SELECT *, sha256(kb || ':' || file_name || ':' || chunk_text) AS id, sha256(chunk_text) AS hash FROM {name}_rows),
      {name} AS (SELECT id, any_value(kb) AS kb, any_value(document_id) AS document_id, any_value(file_name) AS file_name, any_value(chunk_text) AS chunk_text,
        any_value(hash) AS hash, CAST(min(chunk_index) AS INTEGER) AS chunk_index, count(*) AS dup_count FROM {name}_ids GROUP BY id)"""


VERSIONS = f"""{DOCS}, newer AS (SELECT id, kb, file_name, CASE WHEN id % 7 = 0 THEN '' WHEN id % 5 = 0 THEN 'x' || text ELSE text END AS text FROM docs),
      {chunks('docs', 'old')}, {chunks('newer', 'cur')},
      added AS (SELECT * FROM cur c WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.kb = c.kb AND o.file_name = c.file_name AND o.hash = c.hash)),
      gone AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE o.kb = c.kb AND o.file_name = c.file_name AND o.hash = c.hash))"""

INDEX = f"""items AS (SELECT {KB} AS kb_id, doc_id AS item_id, sha256(text) AS hash, text FROM documents),
      posts AS (SELECT item_id, any_value(kb_id) AS kb_id, any_value(hash) AS hash, term, count(*) AS tf
        FROM (SELECT item_id, kb_id, hash, unnest({TOKEN}) AS term FROM items) GROUP BY item_id, term),
      df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
      qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKEN}) AS term FROM benchmark) GROUP BY ALL)"""
SCOPE = {
    "own": "scope AS (SELECT item_id AS query_id, CAST(item_id % 20 AS INTEGER) AS kb_id, 0 AS kb_pos FROM benchmark)",
    "all": f"scope AS (SELECT b.item_id AS query_id, k.kb AS kb_id, k.kb AS kb_pos FROM benchmark b, (SELECT DISTINCT {KB} AS kb FROM documents) k)",
}
EXACT = """exact_scored AS (SELECT query_id, p.item_id, any_value(p.kb_id) AS kb_id, any_value(hash) AS hash,
        round(sum(tf * pow(log10((SELECT count(*) FROM items)::DOUBLE / df), 2)), 6) AS score
        FROM qt JOIN df USING (term) JOIN posts p USING (term) GROUP BY query_id, p.item_id),
      exact_top AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS rank
        FROM exact_scored s JOIN scope USING (query_id, kb_id) WHERE score > 0 QUALIFY rank < 24),
      exact_leg AS (SELECT query_id, hash, min(rank) AS rank, arg_min(item_id, rank) AS item_id, arg_min(kb_id, rank) AS kb_id, max(score) AS score FROM exact_top GROUP BY query_id, hash)"""


def by_kb(leg: str, order: str) -> str:
    keys = "score DESC, item_id" if order == "global" else "kb_pos, score DESC, item_id"
    return f"""{leg}_top AS (SELECT s.*, kb_pos FROM {leg}_scored s JOIN scope USING (query_id, kb_id)
        QUALIFY row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, item_id) <= 24),
      {leg}_once AS (SELECT * FROM {leg}_top QUALIFY row_number() OVER (PARTITION BY query_id, hash ORDER BY {keys}) = 1),
      {leg}_leg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {keys}) - 1 AS rank FROM {leg}_once)"""


def sparse(order: str) -> str:
    return f"""norms AS (SELECT item_id, sqrt(sum(ln(1 + tf) * ln(1 + tf))) AS norm FROM posts GROUP BY item_id),
      qw AS (SELECT query_id, term, ln(1 + qtf) / sqrt(sum(ln(1 + qtf) * ln(1 + qtf)) OVER (PARTITION BY query_id)) AS qw FROM qt),
      sparse_scored AS (SELECT query_id, p.item_id, any_value(kb_id) AS kb_id, any_value(hash) AS hash, round(sum(qw * ln(1 + tf) / norm), 6) AS score
        FROM qw JOIN posts p USING (term) JOIN norms USING (item_id) GROUP BY query_id, p.item_id),
      {by_kb('sparse', order)}"""


def dense(order: str) -> str:
    return f"""vecs AS (SELECT kb_id, item_id, hash, embedding::DOUBLE[] AS v FROM items JOIN embeddings ON vec_id = item_id),
      dense_scored AS (SELECT b.item_id AS query_id, v.item_id, v.kb_id, v.hash, round(list_cosine_similarity(e.embedding::DOUBLE[], v.v), 6) AS score
        FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id, vecs v),
      {by_kb('dense', order)}"""


def merged(legs: tuple[str, ...], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, hash, item_id, kb_id, rank, {('dense', 'sparse', 'exact').index(n)} AS leg FROM {n}_leg" for n in legs)
    part = lambda w, c: f"coalesce({w}::DOUBLE / (60::DOUBLE + {c}), 0::DOUBLE)"
    return f"""every_leg AS ({union}),
      fused AS (SELECT query_id, hash, min(rank) FILTER (leg = 0) AS dense_rank, min(rank) FILTER (leg = 1) AS sparse_rank, min(rank) FILTER (leg = 2) AS exact_rank,
        arg_min(item_id, leg) AS item_id, arg_min(kb_id, leg) AS kb_id FROM every_leg GROUP BY query_id, hash),
      summed AS (SELECT *, 0::DOUBLE + {part(0.5, 'dense_rank')} + {part(0.3, 'sparse_rank')} + {part(0.2, 'exact_rank')} AS score FROM fused)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, exact_rank NULLS LAST) - 1 AS INTEGER) AS rank,
      item_id, CAST(kb_id AS INTEGER) AS kb_id, round(score, 9) AS score, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank, CAST(exact_rank AS INTEGER) AS exact_rank
    FROM summed QUALIFY rank < {k}"""


def hybrid(scope: str, order: str, legs: tuple[str, ...] = ("dense", "sparse", "exact")) -> str:
    parts = {"dense": dense(order), "sparse": sparse(order), "exact": EXACT}
    return f"WITH {INDEX}, {SCOPE[scope]}, {', '.join(parts[n] for n in legs)}, {merged(legs, 6)}"


STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
HITS = f"""found AS ({hybrid('own', 'sequential')}),
      hits AS (SELECT query_id, f.kb_id, item_id, text AS t, rank + 1 AS n FROM found f JOIN documents ON doc_id = item_id),
      packed AS (SELECT query_id, string_agg('[' || n || '] ' || t, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS passages FROM hits GROUP BY query_id)"""
UPLOADS = "uploads AS (SELECT event_id AS id, user_id % 20 AS knowledge_base_id, 'up_' || event_id AS file_name, ts AS created_at FROM events)"
LOG = "log AS (SELECT event_id, user_id AS task_id, user_id % 20 AS kb_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status FROM events)"
DRESSED = "CASE WHEN role = 'assistant' THEN 'a' || chr(10) ELSE '' END"


def _prompt() -> str:
    from lodestone.operators.answers import SYSTEM_PROMPT

    return SYSTEM_PROMPT.replace("'", "''")


def _rewrite() -> str:
    from lodestone.operators.answers import REWRITE_PROMPT

    return REWRITE_PROMPT.replace("'", "''")


def _preview() -> str:
    """The preview of the last message, by the same replacements in DuckDB's pattern language."""
    r = lambda c, p, to="", o="g": f"regexp_replace({c}, '{p}', '{to}', '{o}')"
    c = "CASE WHEN role = 'assistant' THEN '<think>a' || chr(10) || 'b</think>## Head' || chr(10) || '**' || substr(content, 1, 40) || '** [citation:1] `x` [l](u)' || chr(10) || substr(content, 41) ELSE content END"
    c = r(c, "<think>.*?</think>", "", "gs")
    c = r(c, "\\[citation:\\d+\\]")
    c = r(c, "(?m)^#{1,6}\\s+")
    c = r(c, "\\*\\*(.*?)\\*\\*|__(.*?)__", "\\1\\2")
    c = r(c, "\\*(.*?)\\*|_(.*?)_", "\\1\\2")
    c = r(c, "`([^`]+)`", "\\1")
    c = r(c, "\\[([^\\]]+)\\]\\([^)]+\\)", "\\1")
    c = r(c, "[\\s\\p{Z}]+", " ")
    return f"trim({c})"


SQL: dict[str, str] = {
    "doc_catalog": f"WITH {DOCS} SELECT id, kb AS knowledge_base_id, file_name, file_size, file_hash, '.txt' AS ext, 'text/plain' AS content_type, 'user_' || kb % 4 || '/kb_' || kb || '/' || file_name AS file_path, 'txt' AS icon FROM docs",
    "kb_doc_counts": f"WITH {KBS}, {DOCS} SELECT k.id, k.name, k.user_id, count(d.id) AS documents FROM kbs k LEFT JOIN docs d ON d.kb = k.id GROUP BY ALL",
    "owned_documents": f"WITH {KBS}, {DOCS} SELECT d.id, d.file_name, k.name AS kb_name, k.user_id FROM docs d JOIN kbs k ON k.id = d.kb WHERE k.user_id = 1",
    "file_dedup_status": f"WITH {DOCS} SELECT id, kb AS kb_id, file_name, CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'exists' END AS status FROM docs",
    "content_hash_dedup": "SELECT sha256(text) AS hash, min(doc_id) AS item_id, count(*) AS copies FROM documents GROUP BY 1",
    "chunk_fixed": f"WITH {DOCS}, {chunks('docs')} SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(chunk_text) AS INTEGER) AS n_chars, hash FROM chunks_ids",
    "chunk_ids": f"WITH {DOCS}, {chunks('docs')} SELECT id, kb AS kb_id, document_id, chunk_index, dup_count, hash FROM chunks",
    "point_uuid5": f"""WITH {DOCS}, {chunks('docs')}, h AS (SELECT id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(id)) AS d FROM chunks)
      SELECT id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id FROM h""",
    "token_stats": f"SELECT doc_id AS item_id, CAST(len({TOKEN}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({TOKEN})) AS INTEGER) AS n_terms FROM documents",
    "doc_freq": f"WITH {INDEX} SELECT term, df FROM df",
    "exact_search": f"WITH {INDEX}, {SCOPE['all']}, {EXACT} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, score FROM exact_leg",
    "dense_search": f"WITH {INDEX}, {SCOPE['all']}, {dense('sequential')} SELECT query_id, item_id, kb_id, CAST(rank AS INTEGER) AS rank, score FROM dense_leg",
    "sparse_search": f"WITH {INDEX}, {SCOPE['own']}, {sparse('sequential')} SELECT query_id, item_id, kb_id, CAST(rank AS INTEGER) AS rank, score FROM sparse_leg",
    "hybrid_search": hybrid("own", "sequential"),
    "hybrid_search_batch": hybrid("all", "global"),
    "hybrid_search_sequential": hybrid("all", "sequential"),
    "hybrid_leg_ablation": hybrid("all", "global", ("dense", "exact")),
    "test_retrieval_topk": hybrid("own", "sequential"),
    "rrf_merge": "WITH " + ", ".join(f"{n}_leg AS (SELECT doc_id % 7 AS query_id, sha256(CAST(doc_id AS VARCHAR)) AS hash, doc_id AS item_id, 0 AS kb_id, xor(CAST(floor(doc_id / 7.0) AS INTEGER), {k}) AS rank FROM documents)" for n, k in (("dense", 0), ("sparse", 1), ("exact", 2))) + ", " + merged(("dense", "sparse", "exact"), 24),
    "incremental_new_chunks": f"WITH {VERSIONS} SELECT id, document_id, chunk_index FROM added",
    "incremental_deleted_chunks": f"WITH {VERSIONS} SELECT id, document_id, chunk_index FROM gone",
    "upsert_result": f"WITH {VERSIONS} SELECT id, kb AS kb_id, document_id, chunk_index FROM old WHERE id NOT IN (SELECT id FROM gone) AND id NOT IN (SELECT id FROM added) UNION ALL SELECT id, kb, document_id, chunk_index FROM added",
    "cascade_delete": f"""WITH {KBS}, {DOCS}, {UPLOADS}, {chunks('docs')}
      SELECT 'knowledge_bases' AS table_name, count(*) AS rows_left FROM kbs WHERE id % 3 <> 0
      UNION ALL SELECT 'documents', count(*) FROM docs WHERE kb % 3 <> 0
      UNION ALL SELECT 'document_uploads', count(*) FROM uploads WHERE knowledge_base_id NOT IN (SELECT id FROM kbs WHERE id % 3 = 0)
      UNION ALL SELECT 'document_chunks', count(*) FROM chunks_rows WHERE kb % 3 <> 0""",
    "chat_cascade": f"WITH {MSG} SELECT id, chat_id, role FROM msg WHERE chat_id % 4 <> 1",
    "upload_ttl_cleanup": f"WITH {UPLOADS} SELECT id, knowledge_base_id, file_name FROM uploads WHERE created_at < TIMESTAMP '2024-01-24 00:00:00'",
    "new_tasks": f"WITH {UPLOADS} SELECT knowledge_base_id, id AS document_upload_id, 'pending' AS status FROM uploads WHERE id % 3 <> 0",
    "task_latest_status": f"WITH {LOG} SELECT task_id, arg_max(status, (ts, event_id)) AS status, count(*) AS events FROM log GROUP BY task_id",
    "task_all_done": f"WITH {LOG}, last AS (SELECT task_id, kb_id, arg_max(status, (ts, event_id)) AS status FROM log GROUP BY ALL) SELECT kb_id, bool_and(status IN ('completed', 'failed')) AS all_done, bool_or(status = 'failed') AS any_failed FROM last GROUP BY kb_id",
    "task_names": f"WITH {UPLOADS} SELECT id AS document_upload_id, 'pending' AS status, CASE WHEN id % 4 <> 0 THEN file_name END AS file_name FROM uploads",
    "document_or_upload": f"""WITH {DOCS}, {UPLOADS} SELECT b.item_id AS id, coalesce(d.file_name, u.file_name) AS file_name, CASE WHEN d.id IS NOT NULL THEN 'kb/' || d.file_name ELSE 'tmp/' || u.file_name END AS path,
      CASE WHEN d.id IS NOT NULL THEN 'document' ELSE 'upload' END AS origin FROM benchmark b LEFT JOIN docs d ON d.id = b.item_id LEFT JOIN uploads u ON u.id = b.item_id WHERE d.id IS NOT NULL OR u.id IS NOT NULL""",
    "chat_list_preview": f"""WITH {MSG}, last AS (SELECT * FROM msg QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) = 1), n AS (SELECT chat_id, count(*) AS messages FROM msg GROUP BY chat_id)
      SELECT chat_id AS id, 'Chat ' || chat_id AS title, chat_id % 4 AS user_id, messages, {_preview()} AS preview FROM last JOIN n USING (chat_id)""",
    "last_assistant_message": f"WITH {MSG} SELECT chat_id, max(id) AS message_id FROM msg WHERE role = 'assistant' GROUP BY chat_id",
    "chat_knowledge_bases": """WITH c AS (SELECT DISTINCT conv_id AS id FROM conversations)
      SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE least(id % 20, (id + 7) % 20) || ',' || greatest(id % 20, (id + 7) % 20) END AS kb_ids FROM c""",
    "history_clean": f"""WITH {MSG}, t AS (SELECT * FROM msg WHERE role IN ('user', 'assistant') AND id < (SELECT max(id) FROM msg m WHERE m.chat_id = msg.chat_id))
      SELECT chat_id, CAST(count(*) AS INTEGER) AS turns, string_agg(role || ': ' || content, chr(10) ORDER BY id) AS history FROM t GROUP BY chat_id""",
    "identity_route": "SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'identity' WHEN item_id % 3 = 0 THEN 'no_kb' ELSE 'search' END AS route FROM benchmark",
    "think_split": f"""WITH {MSG} SELECT id, CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN ' b ' || content END AS think, id % 3 = 0 AS complete,
      CASE id % 3 WHEN 0 THEN {STRIP.format('content')} WHEN 1 THEN '' ELSE content END AS answer FROM msg WHERE role = 'assistant'""",
    "citation_normalise": f"""WITH {MSG} SELECT id, '[citation](1) [citation](2) [citation](3)[citation](4) ' || regexp_replace(content, '\\[?\\[[cC]itation:(\\d+)\\]\\]?', '[citation](\\1)', 'g') || ' [citation](' || id % 9 || ')' AS text FROM msg WHERE role = 'assistant'""",
    "context_pack": f"WITH {HITS} SELECT query_id, context, CAST(passages AS INTEGER) AS passages FROM packed",
    "prompt_render": f"""WITH {HITS} SELECT query_id, replace('{_prompt()}', '{{context}}', context) AS system, CASE WHEN query_id % 4 = 2 THEN 'rewritten' ELSE text END AS human FROM packed JOIN benchmark ON item_id = query_id""",
    "context_envelope": f"""WITH {HITS} SELECT query_id, CAST(passages AS INTEGER) AS passages, text AS question, t AS first FROM packed JOIN benchmark b ON b.item_id = query_id JOIN hits USING (query_id) WHERE n = 1""",
    "citation_enrich": f"""WITH {HITS}, {KBS} SELECT query_id AS answer_id, CAST(n AS INTEGER) AS number, CASE WHEN h.item_id % 5 <> 0 THEN kb_id END AS kb_id, CAST(CASE WHEN h.item_id % 5 <> 0 THEN h.item_id END AS INTEGER) AS document_id,
      CASE WHEN h.item_id % 5 <> 0 THEN name END AS kb_name, CASE WHEN h.item_id % 5 <> 0 THEN 'doc_' || h.item_id || '.txt' END AS file_name FROM hits h JOIN kbs ON kbs.id = kb_id WHERE n <= 2""",
    "stream_frames": f"WITH {MSG} SELECT id AS body_id, content AS text, length(content) - length(replace(content, ' ', '')) + CASE WHEN content LIKE '% ' THEN 0 ELSE 1 END + CASE WHEN content LIKE '% ' THEN 1 ELSE 0 END AS parts, CAST(1 AS BIGINT) AS ends FROM msg",
    "title_search": "SELECT DISTINCT conv_id AS id, 'Chat ' || conv_id AS title FROM conversations WHERE 'chat ' || conv_id LIKE '%chat 1%'",
    "paged_list": "WITH c AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id % 4 = 1) SELECT id, 'Chat ' || id AS title, id % 4 AS user_id FROM c ORDER BY id LIMIT 10 OFFSET 5",
    "kb_tree": f"WITH {KBS}, {DOCS} SELECT k.id, k.name, CAST(count(d.id) AS INTEGER) AS documents, CAST(count(d.id) FILTER (d.id % 2 = 0) AS INTEGER) AS with_tasks FROM kbs k LEFT JOIN docs d ON d.kb = k.id GROUP BY ALL",
    "metadata_json_backfill": """SELECT doc_id AS item_id, text AS chunk_text, CAST(doc_id % 9 AS INTEGER) AS chunk_index, '{"source":"s"}' AS chunk_metadata FROM documents""",
    "props_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "raw_file_catalog": "SELECT page_id, 'Page' || page_id || '1.HTML' AS file_name, '.html' AS ext, 'application/octet-stream' AS content_type, sha256(html) AS file_hash, strlen(html) AS file_size FROM pages",
    "recall_at_k": f"""WITH {INDEX}, {SCOPE['all']}, {EXACT}, six AS ({merged(('exact',), 6).replace('every_leg AS', 'SELECT * FROM (WITH every_leg AS', 1)}) )
      SELECT count(DISTINCT query_id) AS queries, count(*) AS results, count(*) FILTER (contains(i.text, b.text)) AS holding FROM six JOIN items i USING (item_id) JOIN benchmark b ON b.item_id = query_id""",
}
SQL["exact_search_bm25"] = f"""WITH {INDEX}, lens AS (SELECT item_id, len({TOKEN}) AS n FROM items), stats AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM lens),
      s AS (SELECT query_id, p.item_id, any_value(hash) AS hash, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
        FROM qt JOIN df USING (term) JOIN posts p USING (term) JOIN lens ON lens.item_id = p.item_id, stats GROUP BY query_id, p.item_id),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS rank FROM s WHERE score > 0 QUALIFY rank < 24)
      SELECT query_id, arg_min(item_id, rank) AS item_id, CAST(min(rank) AS INTEGER) AS rank, max(score) AS score FROM t GROUP BY query_id, hash"""
SQL |= {
    "upload_result_by_name": f"WITH {DOCS} SELECT id, file_name, CASE WHEN id % 4 <> 0 THEN CASE WHEN id % 3 = 0 THEN 'exists' ELSE 'pending' END END AS status FROM docs",
    "dashboard_counts": f"""WITH {KBS}, c AS (SELECT DISTINCT conv_id AS id, conv_id % 4 AS user_id FROM conversations)
      SELECT coalesce(k.user_id, c.user_id) AS user_id, coalesce(k.n, 0) AS knowledge_bases, coalesce(c.n, 0) AS chats
      FROM (SELECT user_id, count(*) AS n FROM kbs GROUP BY 1) k FULL JOIN (SELECT user_id, count(*) AS n FROM c GROUP BY 1) c ON k.user_id = c.user_id""",
    "first_task_status": f"WITH {LOG} SELECT task_id AS document_id, arg_min(status, event_id) AS status FROM log GROUP BY task_id",
    "upload_ages": f"""WITH {UPLOADS}, s AS (SELECT id, epoch(TIMESTAMP '2024-01-25 00:00:00')::BIGINT - floor(epoch(created_at))::BIGINT AS s FROM uploads),
      u AS (SELECT id, s, CASE WHEN s >= 86400 THEN 86400 WHEN s >= 3600 THEN 3600 ELSE 60 END AS size FROM s)
      SELECT id, CASE WHEN s < 60 THEN 'just now' ELSE s // size || CASE size WHEN 86400 THEN ' day' WHEN 3600 THEN ' hour' ELSE ' minute' END || CASE WHEN s >= 2 * size THEN 's' ELSE '' END || ' ago' END AS age,
        printf('%.1f', round((id % 997) / 997.0::DOUBLE * 100, 1)) || '%' AS score FROM u""",
    "upload_insert": f"WITH {DOCS} SELECT kb AS knowledge_base_id, file_name, 'kb_' || kb || '/temp/' || file_name AS temp_path, 'pending' AS status FROM docs WHERE id % 3 = 0",
    "message_append": f"""WITH {MSG}, last AS (SELECT chat_id, max(id) AS id FROM msg GROUP BY chat_id)
      SELECT * FROM msg UNION ALL SELECT id + 1, chat_id, 'user', 'About Chat ' || chat_id FROM last UNION ALL SELECT id + 2, chat_id, 'assistant', '' FROM last""",
    "condense_request": f"""WITH {MSG}, t AS (SELECT * FROM msg WHERE role IN ('user', 'assistant') AND id < (SELECT max(id) FROM msg m WHERE m.chat_id = msg.chat_id))
      SELECT chat_id, CAST(count(*) + 2 AS INTEGER) AS messages, 'system: {_rewrite()}' || chr(10) || string_agg(CASE role WHEN 'user' THEN 'human' ELSE 'ai' END || ': ' || content, chr(10) ORDER BY id) || chr(10) || 'human: And Chat ' || chat_id AS request
      FROM t GROUP BY chat_id""",
    "hit_payload": f"WITH {DOCS}, {chunks('docs')} SELECT id, kb AS kb_id, document_id, file_name, chunk_index FROM chunks",
    "chunk_preview": f"""WITH {DOCS}, c AS (SELECT id AS document_id, i AS chunk_index, substr(text, i * 400 + 1, 500) AS t
        FROM (SELECT *, unnest(CASE WHEN length(text) = 0 THEN [] ELSE range(0, greatest(0, CAST(ceil((length(text) - 100) / 400.0) AS INTEGER) - 1) + 1) END) AS i FROM docs))
      SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(t) AS hash FROM c""",
    "upload_knowledge_bases": f"WITH {KBS}, {UPLOADS} SELECT u.id, u.file_name, k.name AS kb_name, k.user_id FROM uploads u JOIN kbs k ON k.id = u.knowledge_base_id WHERE k.user_id = 2",
}


def recursive_sql(table: str, size: int = 1000, overlap: int = 200) -> str:
    """(doc_id, chunk_index, chunk) by recursive splitting: pieces level by level, then a fold that packs them."""
    cell = max(1, min(size - overlap, overlap or size))
    blank = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))

    def pieces(p: str, level: int) -> str:
        if level == 3:
            return f"list_transform(range(0, length({p}), {cell}), lambda c: {p}[c + 1:c + {cell}])"
        sep, x, i = ("chr(10) || chr(10)", "chr(10)", "' '")[level], f"x{level}", f"i{level}"
        q = f"q{level}"
        parts = f"list_transform(string_split({p}, {sep}), lambda {x}, {i}: CASE WHEN {i} > 1 THEN {sep} || {x} ELSE {x} END)"
        return f"CASE WHEN contains({p}, {sep}) THEN flatten(list_transform({parts}, lambda {q}: CASE WHEN length({q}) <= {size} THEN [{q}] ELSE {pieces(q, level + 1)} END)) ELSE {pieces(p, level + 1)} END"

    strip = lambda s: f"trim({s}, {blank})"
    joined = "array_to_string({}, '')".format
    p = "x.held[1]"
    over = f"len(a.held) > 0 AND length({joined('a.held')}) + length({p}) > {size}"
    rest = f"a.held[list_filter(range(1, len(a.held) + 2), lambda k: length({joined('a.held[k:]')}) <= {overlap} AND length({joined('a.held[k:]')}) + length({p}) <= {size})[1]:]"
    fold = f"CASE WHEN {over} THEN {{'held': list_append({rest}, {p}), 'out': list_append(a.out, {strip(joined('a.held'))})}} ELSE {{'held': list_append(a.held, {p}), 'out': a.out}} END"
    return f"""
WITH cut AS (SELECT doc_id, text, CASE WHEN length(text) > {size} THEN {pieces("text", 0)} END AS pieces FROM {table}),
     packed AS (SELECT doc_id, text, CASE WHEN pieces IS NOT NULL THEN list_reduce(list_transform(pieces, lambda y: {{'held': [y], 'out': CAST([] AS VARCHAR[])}}), lambda a, x: {fold}) END AS f FROM cut),
     chunks AS (SELECT doc_id, list_filter(CASE WHEN f IS NULL THEN [{strip("coalesce(text, '')")}] ELSE list_append(f.out, {strip(joined('f.held'))}) END, lambda c: c <> '') AS c FROM packed)
SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS chunk_index FROM chunks"""


_HASHED = "chunk_index, length(chunk) AS n_chars, sha256(chunk) AS hash"
SQL["chunk_recursive"] = f"SELECT doc_id AS document_id, {_HASHED} FROM ({recursive_sql('documents')})"
_ASKED = "(SELECT doc_id, text FROM documents UNION ALL SELECT page_id + 1000000000, html FROM pages)"
SQL["preview_chunks"] = f"SELECT doc_id AS id, {_HASHED} FROM ({recursive_sql(_ASKED, 500, 100)})"

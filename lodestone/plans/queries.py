"""The engine's queries over the standard tables. Each takes (spark, sf_dir) and reads its whole tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import text as T
from lodestone.operators import answers, chunking, incremental, records, search
from lodestone.operators.index import EXACT, SPARSE
from lodestone.schema import migrate
from lodestone.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = datetime.datetime(2024, 1, 25)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def scope_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query searches one knowledge base: its id modulo 20."""
    q = S.table(spark, sf_dir, "benchmark")
    return q.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 20).cast("int").alias("kb_id"), F.lit(0).alias("kb_pos"))


def scope_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query searches all knowledge bases, in the order of their ids."""
    kbs = S.knowledge_bases(spark, sf_dir).agg(F.collect_list("id")).scalar()
    q = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(kbs).alias("kb_id"))
    return q.select("query_id", "kb_id", F.col("kb_id").alias("kb_pos"))


def ranked(df: DataFrame) -> DataFrame:
    r = lambda c: F.col(c).cast("int").alias(c)
    return df.select("query_id", r("rank"), "item_id", r("kb_id"), F.round("score", 9).alias("score"), r("dense_rank"), r("sparse_rank"), r("exact_rank"))


def index(spark: SparkSession, sf_dir: str, vectors: bool = True) -> search.Index:
    return search.Index(S.items(spark, sf_dir), S.vectors(spark, sf_dir) if vectors else None)


@query
def doc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.documents(spark, sf_dir)
    name, kb = F.col("file_name"), F.col("knowledge_base_id")
    return d.select("id", "knowledge_base_id", "file_name", "file_size", "file_hash", T.extension(name).alias("ext"), T.content_type(name).alias("content_type"), T.object_path(kb % 4, kb, name).alias("file_path"), T.icon(T.content_type(name), name).alias("icon"))


@query
def kb_doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.kb_document_counts(S.knowledge_bases(spark, sf_dir), S.documents(spark, sf_dir))


@query
def owned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.owned_documents(S.documents(spark, sf_dir), S.knowledge_bases(spark, sf_dir), 1).select("id", "file_name", "kb_name", "user_id")


@query
def file_dedup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come again, every third with changed text."""
    d = S.documents(spark, sf_dir)
    files = d.select("id", F.col("knowledge_base_id").alias("kb_id"), "file_name", F.when(F.col("id") % 3 == 0, T.content_hash(F.concat("text", F.lit("!")))).otherwise(F.col("file_hash")).alias("file_hash"))
    return records.upload_status(files, d).select("id", "kb_id", "file_name", "status")


@query
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.items(spark, sf_dir).groupBy("hash").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.documents(spark, sf_dir).select(F.col("knowledge_base_id").alias("kb_id"), F.col("id").alias("document_id"), "file_name", "text")
    return chunking.chunk_fixed(d)


@query
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("document_id", "chunk_index", F.length("chunk_text").alias("n_chars"), T.content_hash(F.col("chunk_text")).alias("hash"))


@query
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.documents(spark, sf_dir).select("id", "text")
    return chunking.chunk_recursive(d).select(F.col("id").alias("document_id"), "chunk_index", F.length("chunk_text").alias("n_chars"), T.content_hash(F.col("chunk_text")).alias("hash"))


@query
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.with_ids(_chunks(spark, sf_dir))
    return c.select("id", "kb_id", "document_id", "chunk_index", "dup_count", "hash")


@query
def point_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.with_ids(_chunks(spark, sf_dir))
    return c.select("id", T.uuid5_oid(F.col("id")).alias("point_id"))


@query
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.items(spark, sf_dir).select("item_id", T.tokens(F.col("text")).alias("t"))
    return d.select("item_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequencies(search.postings(S.items(spark, sf_dir)))


@query
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = index(spark, sf_dir, vectors=False)
    s = Settings()
    leg = search.exact_leg(ix.text_hits(S.search_queries(spark, sf_dir), scope_all(spark, sf_dir), s.pool, [EXACT]), s)
    return leg.select("query_id", "item_id", F.col("rank").cast("int").alias("rank"), "score")


@query
def exact_search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = index(spark, sf_dir, vectors=False)
    s = Settings()
    leg = search.exact_leg(ix.text_hits(S.search_queries(spark, sf_dir), scope_all(spark, sf_dir), s.pool, [EXACT], "bm25"), s)
    return leg.select("query_id", "item_id", F.col("rank").cast("int").alias("rank"), "score")


@query
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    leg = search.dense_leg(S.search_queries(spark, sf_dir), S.vectors(spark, sf_dir), scope_all(spark, sf_dir), Settings())
    return leg.select("query_id", "item_id", "kb_id", F.col("rank").cast("int").alias("rank"), "score")


@query
def sparse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = index(spark, sf_dir, vectors=False)
    s, scope = Settings(), scope_own(spark, sf_dir)
    leg = search.sparse_leg(ix.text_hits(S.search_queries(spark, sf_dir), scope, s.pool, [SPARSE]), scope, s)
    return leg.select("query_id", "item_id", "kb_id", F.col("rank").cast("int").alias("rank"), "score")


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three legs, each query in its own knowledge base."""
    return ranked(index(spark, sf_dir).search(S.search_queries(spark, sf_dir), scope_own(spark, sf_dir)))


@query
def hybrid_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three legs, each query in all knowledge bases, ranked by score across them."""
    return ranked(index(spark, sf_dir).search(S.search_queries(spark, sf_dir), scope_all(spark, sf_dir), Settings(cross_kb="global")))


@query
def hybrid_search_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three legs in all knowledge bases; every hit of a knowledge base ranks before those of the next."""
    return ranked(index(spark, sf_dir).search(S.search_queries(spark, sf_dir), scope_all(spark, sf_dir)))


@query
def hybrid_leg_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs: dense and exact."""
    return ranked(index(spark, sf_dir).search(S.search_queries(spark, sf_dir), scope_all(spark, sf_dir), Settings(cross_kb="global", sparse_enabled=False)))


@query
def test_retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten results are asked for; six are the most that there are."""
    return ranked(index(spark, sf_dir).test_retrieval(S.search_queries(spark, sf_dir), scope_own(spark, sf_dir), 10))


@query
def rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion alone, of three ranked lists made from ids; every document is in each list, in another order."""
    d = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    place = F.floor(F.col("item_id") / 7).cast("int")
    leg = lambda swap: d.select((F.col("item_id") % 7).alias("query_id"), T.content_hash(F.col("item_id").cast("string")).alias("hash"), "item_id", F.lit(0).alias("kb_id"), place.bitwiseXOR(F.lit(swap)).alias("rank"))
    return ranked(search.rrf_merge({"dense": leg(0), "sparse": leg(1), "exact": leg(2)}, Settings(), 24))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the chunk table: every fifth document changes, every seventh loses its text."""
    d = S.documents(spark, sf_dir).select(F.col("knowledge_base_id").alias("kb_id"), F.col("id").alias("document_id"), "file_name", "text")
    new = d.withColumn("text", F.when(F.col("document_id") % 7 == 0, "").when(F.col("document_id") % 5 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    return chunking.with_ids(chunking.chunk_fixed(d)), chunking.with_ids(chunking.chunk_fixed(new))


@query
def incremental_new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return incremental.new_chunks(new, old).select("id", "document_id", "chunk_index")


@query
def incremental_deleted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return incremental.deleted_chunks(new, old, old.select("kb_id", "file_name")).select("id", "document_id", "chunk_index")


@query
def upsert_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    gone = incremental.deleted_chunks(new, old, old.select("kb_id", "file_name"))
    out = incremental.upserted(incremental.without(old, gone, "id"), incremental.new_chunks(new, old).select(*old.columns))
    return out.select("id", "kb_id", "document_id", "chunk_index")


@query
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table after the deletion of every third knowledge base."""
    kbs, docs = S.knowledge_bases(spark, sf_dir), S.documents(spark, sf_dir)
    chunks = _chunks(spark, sf_dir)
    left = incremental.cascade_kb(kbs.filter("id % 3 = 0"), {"knowledge_bases": kbs, "documents": docs, "document_uploads": S.uploads(spark, sf_dir), "document_chunks": chunks})
    parts = [df.agg(F.count("*").alias("left")).select(F.lit(name).alias("table_name"), "left") for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", F.col("left").alias("rows_left"))


@query
def chat_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = S.chats(spark, sf_dir)
    left = incremental.cascade_chat(chats.filter("id % 4 = 1"), {"chats": chats, "messages": S.messages(spark, sf_dir)})
    return left["messages"].select("id", "chat_id", "role")


@query
def upload_ttl_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.expired(S.uploads(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("id", "knowledge_base_id", "file_name")


@query
def new_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = S.uploads(spark, sf_dir).withColumn("status", F.when(F.col("id") % 3 == 0, "exists").otherwise(F.col("status")))
    return records.new_tasks(up).select("knowledge_base_id", "document_upload_id", "status")


@query
def task_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest_status(S.task_log(spark, sf_dir))


@query
def task_all_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = S.task_log(spark, sf_dir)
    latest = log.groupBy("task_id", "kb_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return records.batch_outcome(latest, ["kb_id"])


@query
def task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with the names of their uploads; every fourth upload is gone."""
    up = S.uploads(spark, sf_dir)
    tasks = records.new_tasks(up).select("document_upload_id", "status")
    return records.task_names(tasks, up.filter("id % 4 <> 0")).select("document_upload_id", "status", "file_name")


@query
def document_or_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.documents(spark, sf_dir).select("id", "file_name", F.concat(F.lit("kb/"), "file_name").alias("file_path"))
    up = S.uploads(spark, sf_dir).select("id", "file_name", F.concat(F.lit("tmp/"), "file_name").alias("temp_path"))
    return records.document_or_upload(S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), docs, up)


@query
def chat_list_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown, a reasoning block and citations are put around the messages first."""
    m = S.messages(spark, sf_dir)
    dressed = F.concat(F.lit("e30=__LLM_RESPONSE__<think>a\nb</think>## Head\n**"), F.left("content", F.lit(40)), F.lit("** [citation:1] `x` [l](u)\n"), F.substr("content", F.lit(41)))
    m = m.withColumn("content", F.when(F.col("role") == "assistant", dressed).otherwise(F.col("content")))
    return records.chat_list(S.chats(spark, sf_dir), m).select("id", "title", "user_id", "messages", "preview")


@query
def last_assistant_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_assistant(S.messages(spark, sf_dir))


@query
def chat_knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = S.chats(spark, sf_dir)
    bridge = chats.filter("id % 5 <> 0").select(F.col("id").alias("chat_id"), F.explode(F.array((F.col("id") % 20).cast("int"), ((F.col("id") + 7) % 20).cast("int"))).alias("knowledge_base_id"))
    return records.chat_kbs(chats, bridge).select("id", F.concat_ws(",", F.col("knowledge_base_ids").cast("array<string>")).alias("kb_ids"))


@query
def history_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.messages(spark, sf_dir).withColumn("content", F.when(F.col("role") == "assistant", F.concat(F.lit("e30=__LLM_RESPONSE__x__LLM_RESPONSE__"), "content")).otherwise(F.col("content")))
    h = answers.history(m)
    return h.select("chat_id", F.size("history").alias("turns"), F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("history"))


@query
def identity_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.search_queries(spark, sf_dir)
    text = F.when(F.col("query_id") % 4 == 0, F.lit("  Who are  YOU ?")).when(F.col("query_id") % 4 == 1, F.lit("who are you really")).otherwise(F.col("text"))
    return answers.routed(q.withColumn("text", text), scope_own(spark, sf_dir).filter("query_id % 3 <> 0")).select("query_id", "route")


@query
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.messages(spark, sf_dir).filter("role = 'assistant'")
    c = F.when(F.col("id") % 3 == 0, F.concat(F.lit("<think> a\n</think> "), "content")).when(F.col("id") % 3 == 1, F.concat(F.lit("<think> b "), "content")).otherwise(F.col("content"))
    return m.select("id", T.think_split(c).alias("s")).select("id", "s.think", "s.complete", "s.answer")


@query
def citation_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.messages(spark, sf_dir).filter("role = 'assistant'")
    c = F.concat(F.lit("[[citation:1]] [Citation:2] [[Citation:3]][citation:4]] "), F.col("content"), F.lit(" [citation:"), (F.col("id") % 9).cast("string"), F.lit("]"))
    return m.select("id", T.citation_links(c).alias("text"))


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, context, passages): the whole texts that hybrid search finds in each query's knowledge base."""
    docs = S.items(spark, sf_dir).select("kb_id", "item_id", "text")
    docs = docs.withColumn("metadata", F.when(F.col("item_id") % 5 == 0, F.create_map(F.lit("page"), F.lit("1"))).otherwise(F.create_map(F.lit("kb_id"), F.col("kb_id").cast("string"), F.lit("document_id"), F.col("item_id").cast("string"))))
    hits = index(spark, sf_dir).search(S.search_queries(spark, sf_dir), scope_own(spark, sf_dir)).select("query_id", F.col("rank").cast("int").alias("rank"), "item_id")
    return answers.context(hits, docs)


@query
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelopes(spark, sf_dir).select("query_id", "context", F.size("passages").alias("passages"))


@query
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = answers.standalone(S.search_queries(spark, sf_dir), S.search_queries(spark, sf_dir).filter("query_id % 2 = 0").select("query_id", F.when(F.col("query_id") % 4 == 0, F.lit("<think>x</think>")).otherwise(F.lit("<think>y\n</think> rewritten ")).alias("rewrite")))
    rows = q.join(_envelopes(spark, sf_dir), "query_id")
    p = answers.prompt(F.col("question"), F.col("context"))
    return rows.select("query_id", p.alias("p")).select("query_id", F.col("p")[0]["content"].alias("system"), F.col("p")[1]["content"].alias("human"))


@query
def context_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base64 envelope, and what is read from it again."""
    rows = _envelopes(spark, sf_dir).join(S.search_queries(spark, sf_dir).select("query_id", "text"), "query_id")
    enc = rows.select("query_id", answers.envelope(F.col("passages"), F.col("text")).alias("envelope"))
    e = answers.opened(F.col("envelope"))
    return enc.select("query_id", F.size(e["context"]).alias("passages"), e["rewritten_query"].alias("question"), F.get(e["context"], 0)["page_content"].alias("first"))


@query
def citation_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _envelopes(spark, sf_dir)
    text = F.concat(answers.envelope(F.col("passages"), F.lit("q")), F.lit("__LLM_RESPONSE__a [citation:1] b [[citation:2]] c [citation:1] d [citation:9]"))
    docs = S.documents(spark, sf_dir).select("id", "file_name")
    return answers.citations(rows.select(F.col("query_id").alias("answer_id"), text.alias("content")), S.knowledge_bases(spark, sf_dir), docs)


@query
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as streams of frames, cut into words, and put together again."""
    m = S.messages(spark, sf_dir)
    body = F.concat(F.array_join(answers.frames(F.split("content", "(?<= )")), ""), F.lit('d:{"finishReason":"stop"}\n'))
    parsed = answers.parsed_frames(m.select(F.col("id").alias("body_id"), body.alias("body")))
    ended = parsed.groupBy("body_id").agg(F.count_if(F.col("kind") == "0").alias("parts"), F.count_if(F.col("kind") == "d").alias("ends"))
    return answers.joined_frames(parsed).join(ended, "body_id").select("body_id", "text", "parts", "ends")


@query
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.title_search(S.chats(spark, sf_dir), "CHAT 1").select("id", "title")


@query
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.paged(records.scoped(S.chats(spark, sf_dir), 1), 5, 10).select("id", "title", "user_id")


@query
def kb_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.documents(spark, sf_dir)
    tasks = docs.filter("id % 2 = 0").select(F.col("id").alias("document_id"), (F.col("id") * 10).alias("id"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error_message"))
    t = records.kb_tree(S.knowledge_bases(spark, sf_dir), docs, tasks)
    with_task = F.filter("documents", lambda d: d["processing_tasks"].isNotNull())
    return t.groupBy("id", "name").agg(F.sum(F.size("documents")).cast("int").alias("documents"), F.sum(F.size(with_task)).cast("int").alias("with_tasks"))


@query
def metadata_json_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows of the first schema version brought to the next."""
    d = S.items(spark, sf_dir)
    meta = F.to_json(F.struct(F.col("text").alias("page_content"), (F.col("item_id") % 9).alias("chunk_index"), F.lit("s").alias("source")))
    return migrate(d.select("item_id", meta.alias("chunk_metadata")), 0, 1).select("item_id", "chunk_text", "chunk_index", "chunk_metadata")


@query
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query
def raw_file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as raw files of an unknown kind: they go through the text loader, markup and all."""
    p = S.table(spark, sf_dir, "pages")
    name = F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" (1).HTML"))
    return p.select("page_id", T.safe_file_name(name).alias("file_name"), T.extension(name).alias("ext"), T.content_type(name).alias("content_type"), T.content_hash(F.col("html")).alias("file_hash"), F.octet_length("html").cast("long").alias("file_size"))


@query
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the documents that hold a benchmark passage word for word are among the six exact hits."""
    q = S.search_queries(spark, sf_dir)
    docs = S.items(spark, sf_dir)
    found = index(spark, sf_dir, vectors=False).search(q, scope_all(spark, sf_dir), Settings(dense_enabled=False, sparse_enabled=False))
    texts = found.join(docs.groupBy("hash").agg(F.min("text").alias("text")), "hash").join(q.select("query_id", F.col("text").alias("passage")), "query_id")
    hit = texts.groupBy("query_id").agg(F.count("*").alias("results"), F.count_if(F.contains("text", F.col("passage"))).alias("holding"))
    return hit.agg(F.count("*").alias("queries"), F.sum("results").alias("results"), F.sum("holding").alias("holding"))


@query
def upload_result_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chosen files; every fourth has no result."""
    files = S.documents(spark, sf_dir).select("id", "file_name")
    results = files.filter("id % 4 <> 0").select((-F.col("id")).alias("id"), "file_name", F.when(F.col("id") % 3 == 0, "exists").otherwise("pending").alias("status"))
    return records.by_file_name(files, results).select("id", "file_name", "status")


@query
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dashboard(S.knowledge_bases(spark, sf_dir), S.chats(spark, sf_dir))


@query
def first_task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = S.task_log(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("task_id").alias("document_id"), "status")
    return records.first_task_status(log)


@query
def upload_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = S.uploads(spark, sf_dir)
    return up.select("id", T.relative_time(F.col("created_at"), F.lit(NOW).cast("timestamp_ntz")).alias("age"), T.percent((F.col("id") % 997) / F.lit(997.0)).alias("score"))


@query
def upload_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come again, every third with changed text: these are new uploads."""
    d = S.documents(spark, sf_dir)
    files = d.select(F.col("knowledge_base_id").alias("kb_id"), "file_name", F.when(F.col("id") % 3 == 0, T.content_hash(F.concat("text", F.lit("!")))).otherwise(F.col("file_hash")).alias("file_hash"), "file_size", F.lit("text/plain").alias("content_type"))
    return records.new_uploads(files, d, F.lit(NOW).cast("timestamp_ntz")).select("knowledge_base_id", "file_name", "temp_path", "status")


@query
def message_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question to every chat, and the answer that is to be filled."""
    m, chats = S.messages(spark, sf_dir), S.chats(spark, sf_dir)
    return records.asked(m, chats.select(F.col("id").alias("chat_id"), F.concat(F.lit("About "), "title").alias("content")))


@query
def condense_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.messages(spark, sf_dir)
    questions = S.chats(spark, sf_dir).select(F.col("id").alias("chat_id"), F.concat(F.lit("And "), "title").alias("question"))
    r = answers.rewrite_requests(questions, answers.history(m))
    lines = F.array_join(F.transform("request", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return r.select("chat_id", F.size("request").alias("messages"), lines.alias("request"))


@query
def hit_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a chunk but its text."""
    c = chunking.with_ids(_chunks(spark, sf_dir)).select("id", "kb_id", "document_id", "file_name", "chunk_text", "chunk_index")
    return answers.payload(c)


@query
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 500 characters with an overlap of 100 of all documents that are asked for, without ids or store."""
    d = S.documents(spark, sf_dir).select(F.col("knowledge_base_id").alias("kb_id"), F.col("id").alias("document_id"), "file_name", "text")
    return chunking.chunk_fixed(d, size=500, overlap=100).select("document_id", "chunk_index", T.content_hash(F.col("chunk_text")).alias("hash"))


@query
def preview_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 500 characters with an overlap of 100, by the recursive splitter as a table function, of all documents, and of
    pages as uploads that aren't documents yet."""
    docs = S.documents(spark, sf_dir).select("id", "file_name", "text")
    uploads = S.table(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000_000).alias("id"), F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("file_name"), F.col("html").alias("text"))
    found = chunking.preview(docs.select("id").unionByName(uploads.select("id")), docs, uploads, 500, 100)
    return found.select("id", "chunk_index", F.length("chunk_text").alias("n_chars"), T.content_hash(F.col("chunk_text")).alias("hash"))


@query
def upload_knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of one owner's knowledge bases."""
    return records.owned_documents(S.uploads(spark, sf_dir), S.knowledge_bases(spark, sf_dir), 2).select("id", "file_name", "kb_name", "user_id")

"""From search results to prompts, context envelopes, citations and stream frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import SENTINEL, ascii_json, base64_line, citation_links, history_text, is_identity, without_think

SYSTEM_PROMPT = "Answer the question from the numbered context below. Cite every statement as [citation:x], with x the number of its source. Say so if the context isn't enough. Answer in the language of the question.\n\nContext:\n{context}"
REWRITE_PROMPT = "Rewrite the last question so that it can be understood without the conversation. Return only the question, unchanged if it needs no change."
IDENTITY_ANSWER = "I answer questions from the documents of your knowledge bases, with citations. Ask me about their content."
NO_KB_ANSWER = "There is no knowledge base to answer from. Add one to this chat first."
ENVELOPE = "struct<context:array<struct<page_content:string,metadata:map<string,string>>>,rewritten_query:string>"


def routed(queries: DataFrame, scope: DataFrame) -> DataFrame:
    """queries with route: "identity" for questions about the assistant, "no_kb" without a knowledge base, else "search"."""
    have = scope.select("query_id").distinct().withColumn("kb__", F.lit(True))
    return queries.join(have, "query_id", "left").withColumn("route", F.when(is_identity(F.col("text")), "identity").when(F.col("kb__").isNull(), "no_kb").otherwise("search")).drop("kb__")


def history(messages: DataFrame) -> DataFrame:
    """(chat_id, history): the turns before the last message as structs (id, role, content), in order."""
    turns = messages.filter(F.col("role").isin("user", "assistant")).withColumn("content", F.when(F.col("role") == "assistant", history_text(F.col("content"))).otherwise(F.col("content")))
    kept = turns.join(messages.groupBy("chat_id").agg(F.max("id").alias("last__")), "chat_id").filter(F.col("id") < F.col("last__"))
    return kept.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("id", "role", "content"))).alias("history"))


def rewrite_requests(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """(chat_id, request): messages that ask a language model for a standalone question, of chats with a history
    (a result of ``history``): the instruction, the turns, the question."""
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    past = F.transform("history", lambda x: message(F.when(x["role"] == "user", F.lit("human")).otherwise(F.lit("ai")), x["content"]))
    request = F.concat(F.array(message(F.lit("system"), F.lit(REWRITE_PROMPT))), past, F.array(message(F.lit("human"), F.col("question"))))
    return questions.join(turns.filter(F.size("history") > 0), "chat_id").select("chat_id", request.alias("request"))


def payload(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Columns of a hit's payload: all but its text."""
    return chunks.drop(text)


def standalone(queries: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """queries with the question that is searched: the rewritten one (query_id, rewrite) where there is one."""
    if rewrites is None:
        return queries.withColumn("question", F.col("text"))
    return queries.join(rewrites.select("query_id", "rewrite"), "query_id", "left").withColumn("question", F.when(F.col("rewrite").isNull(), F.col("text")).otherwise(without_think(F.col("rewrite"), F.col("text")))).drop("rewrite")


def context(results: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, context, passages): numbered text "[i] ..." joined by blank lines, and the passages as structs."""
    rows = results.join(items.select("item_id", F.col(text).alias("page_content"), "metadata"), "item_id")
    got = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "page_content", F.map_entries("metadata").alias("metadata")))).alias("p"))
    return got.select("query_id", F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), (x["rank"] + 1).cast("string"), F.lit("] "), x["page_content"])), "\n\n").alias("context"), F.transform("p", lambda x: F.struct(x["page_content"].alias("page_content"), F.map_from_entries(x["metadata"]).alias("metadata"))).alias("passages"))


def prompt(question: Column, packed: Column) -> Column:
    """Messages of the answering step."""
    return F.array(F.struct(F.lit("system").alias("role"), F.replace(F.lit(SYSTEM_PROMPT), F.lit("{context}"), packed).alias("content")), F.struct(F.lit("human").alias("role"), question.alias("content")))


def envelope(passages: Column, question: Column, legacy_quote_escape: bool = False, ascii_only: bool = True) -> Column:
    """The passages and the searched question as base64 of JSON."""
    if legacy_quote_escape:
        passages = F.transform(passages, lambda x: F.struct(F.replace(x["page_content"], F.lit('"'), F.lit('\\"')).alias("page_content"), x["metadata"].alias("metadata")))
    body = F.to_json(F.struct(passages.alias("context"), question.alias("rewritten_query")))
    return base64_line(ascii_json(body) if ascii_only else body)


def opened(encoded: Column) -> Column:
    """The envelope's struct; null if it can't be read."""
    return F.from_json(F.try_to_binary(F.trim(encoded), F.lit("base64")).cast("string"), ENVELOPE)


def citations(answers: DataFrame, kbs: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, number, kb_name, file_name) of the numbers that answers (answer_id, content) cite.

    content is an envelope, the sentinel and the answer. Numbers beyond the context have no row, and passages
    without kb_id or document_id have no names."""
    parts = F.split("content", SENTINEL)
    rows = answers.select("answer_id", opened(F.get(parts, 0)).alias("e"), citation_links(F.element_at(parts, -1)).alias("text"))
    cited = rows.select("answer_id", "e", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("\\[citation\\]\\((\\d+)\\)"), F.lit(1)))).alias("n")).withColumn("number", F.col("n").try_cast("int"))
    hit = cited.withColumn("m", F.get(F.col("e.context"), F.col("number") - 1)["metadata"]).filter("m IS NOT NULL")
    keyed = hit.select("answer_id", "number", F.try_element_at("m", F.lit("kb_id")).try_cast("int").alias("kb_id"), F.try_element_at("m", F.lit("document_id")).try_cast("int").alias("document_id"))
    named = keyed.join(kbs.select(F.col("id").alias("kb_id"), F.col("name").alias("kb_name")), "kb_id", "left")
    return named.join(documents.select(F.col("id").alias("document_id"), "file_name"), "document_id", "left").select("answer_id", "number", "kb_id", "document_id", "kb_name", "file_name")


def lookups(passages: DataFrame) -> DataFrame:
    """The distinct (kb_id, document_id) pairs that citations (id, text, metadata) need; those without a key are left out."""
    pair = passages.select(F.try_element_at("metadata", F.lit("kb_id")).alias("kb_id"), F.try_element_at("metadata", F.lit("document_id")).alias("document_id"))
    return pair.filter("kb_id <> '' AND document_id <> ''").dropDuplicates(["kb_id", "document_id"])


def frames(texts: Column) -> Column:
    """Text parts as lines of the stream protocol."""
    return F.transform(texts, lambda t: F.concat(F.lit("0:"), F.to_json(F.struct(t.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(t.alias("t")))) - 6), F.lit("\n")))


def parsed_frames(bodies: DataFrame) -> DataFrame:
    """(body_id, seq, kind, payload) of (body_id, body) streams: text (0), finish (d), error (3); other lines are left out."""
    return frames_of_lines(bodies.select("body_id", F.posexplode(F.split("body", "\n")).alias("seq", "line")))


def frames_of_lines(lines: DataFrame) -> DataFrame:
    """(body_id, seq, kind, payload) of the lines (body_id, seq, line) of streams."""
    lines = lines.filter(F.length("line") > 0)
    kind = F.regexp_extract("line", "^([0d3]):", 1)
    payload = F.when(kind == "0", F.from_json(F.concat(F.lit('{"t":'), F.substr("line", F.lit(3)), F.lit("}")), "struct<t:string>")["t"]).otherwise(F.substr("line", F.lit(3)))
    return lines.select("body_id", "seq", kind.alias("kind"), payload.alias("payload")).filter("kind <> ''")


def joined_frames(frames_: DataFrame) -> DataFrame:
    """The whole text of each stream."""
    parts = frames_.filter("kind = '0'").groupBy("body_id").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("p"))
    return parts.select("body_id", F.array_join(F.transform("p", lambda x: x["payload"]), "").alias("text"))


def canned(route: Column) -> Column:
    return F.when(route == "identity", IDENTITY_ANSWER).when(route == "no_kb", NO_KB_ANSWER)

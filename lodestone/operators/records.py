"""Relational reads and writes: knowledge bases, documents, uploads, tasks, chats, messages. Everything is
scoped to an owner; what the owner doesn't have isn't found."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import preview


def scoped(df: DataFrame, user_id: int | None) -> DataFrame:
    """Rows of an owner; all rows for None."""
    return df if user_id is None else df.filter(F.col("user_id") == user_id)


def paged(df: DataFrame, skip: int = 0, limit: int = 100, order: str = "id") -> DataFrame:
    return df.orderBy(order).offset(skip).limit(limit)


def get(df: DataFrame, key: int, user_id: int | None = None) -> DataFrame:
    return scoped(df, user_id).filter(F.col("id") == key).limit(1)


def updated(df: DataFrame, key: int, changes: dict[str, object], user_id: int | None = None) -> DataFrame:
    """df with the fields that changes names set in one row; a field set to None becomes null."""
    hit = (F.col("id") == key) & (F.lit(True) if user_id is None else F.col("user_id") == user_id)
    return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def owned_documents(documents: DataFrame, kbs: DataFrame, user_id: int | None) -> DataFrame:
    kb = scoped(kbs, user_id).select(F.col("id").alias("knowledge_base_id"), F.col("name").alias("kb_name"), "user_id")
    return documents.join(kb, "knowledge_base_id")


def document_or_upload(ids: DataFrame, documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """(id, file_name, path, origin) of each id: the document of that id, else the upload."""
    found = documents.select("id", "file_name", F.col("file_path").alias("path"), F.lit("document").alias("origin"), F.lit(0).alias("n")).unionByName(
        uploads.select("id", "file_name", F.col("temp_path").alias("path"), F.lit("upload").alias("origin"), F.lit(1).alias("n"))
    )
    return found.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(*[F.min_by(c, "n").alias(c) for c in ("file_name", "path", "origin")])


def kb_tree(kbs: DataFrame, documents: DataFrame, tasks: DataFrame, page: int = 1000) -> DataFrame:
    """Knowledge bases with their documents, and these with their tasks, nested and ordered by id; a row for each page of
    documents, whose ids have the same quotient by page, so that no row outgrows it. A knowledge base without documents has
    one row, with page 0."""
    t = tasks.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("task_id"), "status", "error_message"))).alias("processing_tasks"))
    keys = [F.col("knowledge_base_id").alias("id"), F.floor(F.col("id") / page).alias("page")]
    d = documents.join(t, "id", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "file_name", "file_size", "processing_tasks"))).alias("documents"))
    tree = kbs.join(d, "id", "left").withColumn("documents", F.coalesce("documents", F.array().cast(d.schema["documents"].dataType)))
    return tree.withColumn("page", F.coalesce("page", F.lit(0)))


def kb_document_counts(kbs: DataFrame, documents: DataFrame) -> DataFrame:
    n = documents.groupBy(F.col("knowledge_base_id").alias("id")).agg(F.count("*").alias("documents"))
    return kbs.join(n, "id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def missing_ids(ids: DataFrame, known: DataFrame) -> DataFrame:
    return ids.select("id").join(known.select("id"), "id", "left_anti")


def check_chat_scope(kb_ids: list[int], kbs: DataFrame, user_id: int) -> None:
    """Every id must be a knowledge base of the owner; an id given twice fails, too."""
    if len(kb_ids) != scoped(kbs, user_id).filter(F.col("id").isin(kb_ids)).count():
        raise ValueError("a knowledge base isn't there, or is named twice")


def upload_status(files: DataFrame, documents: DataFrame) -> DataFrame:
    """files (kb_id, file_name, file_hash) with status: "exists" for a file that the knowledge base holds
    unchanged under that name, else "pending"."""
    known = documents.select(F.col("knowledge_base_id").alias("kb_id"), "file_name", "file_hash", F.lit("exists").alias("status")).distinct()
    return files.join(known, ["kb_id", "file_name", "file_hash"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def new_tasks(uploads: DataFrame, now: Column | None = None) -> DataFrame:
    """A pending task for every upload that isn't skipped."""
    now = F.current_timestamp() if now is None else now
    return uploads.filter("status <> 'exists'").select(F.col("knowledge_base_id"), F.lit(None).cast("int").alias("document_id"), F.col("id").alias("document_upload_id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"), now.alias("created_at"), now.alias("updated_at"))


def latest_status(events: DataFrame, key: str = "task_id", status: str = "status", at: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last state of each task of an append-only log."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*at)).alias(status), F.count("*").alias("events"))


def batch_outcome(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Whether all tasks of a batch have ended, and whether one failed."""
    return tasks.groupBy(*by).agg(F.every(F.col("status").isin("completed", "failed")).alias("all_done"), F.some(F.col("status") == "failed").alias("any_failed"))


def task_names(tasks: DataFrame, uploads: DataFrame) -> DataFrame:
    return tasks.join(uploads.select(F.col("id").alias("document_upload_id"), "file_name"), "document_upload_id", "left")


def expired(uploads: DataFrame, now: datetime.datetime | Column, hours: int = 24) -> DataFrame:
    """Uploads of all owners, in any state, made more than hours before now."""
    now = now if isinstance(now, Column) else F.lit(now)
    return uploads.filter(F.col("created_at") < now - F.expr(f"INTERVAL {hours} HOURS"))


def duplicated(users: DataFrame, column: str) -> DataFrame:
    """Values that more than one account uses."""
    return users.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def chat_list(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with the number of their messages and a one-line preview of the last one."""
    m = messages.groupBy(F.col("chat_id").alias("id")).agg(F.count("*").alias("messages"), F.max_by("content", "id").alias("last"))
    return chats.join(m, "id", "left").withColumn("messages", F.coalesce("messages", F.lit(0))).withColumn("preview", preview(F.col("last"))).drop("last")


def last_assistant(messages: DataFrame) -> DataFrame:
    return messages.filter("role = 'assistant'").groupBy("chat_id").agg(F.max("id").alias("message_id"))


def chat_kbs(chats: DataFrame, bridge: DataFrame) -> DataFrame:
    """Chats with the ids of their knowledge bases, ascending."""
    kb = bridge.groupBy(F.col("chat_id").alias("id")).agg(F.array_sort(F.collect_list("knowledge_base_id")).alias("knowledge_base_ids"))
    return chats.join(kb, "id", "left").withColumn("knowledge_base_ids", F.coalesce("knowledge_base_ids", F.array().cast("array<int>")))


def title_search(chats: DataFrame, text: str) -> DataFrame:
    return chats.filter(F.contains(F.lower("title"), F.lit(text.lower())))


def shown_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role").isin("user", "assistant"))


def first_per(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return df.withColumn("n__", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("n__") <= n).drop("n__")


def answered(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages with the placeholders' content (id, content) filled in."""
    return messages.join(answers.select("id", F.col("content").alias("new")), "id", "left").withColumn("content", F.coalesce("new", "content")).drop("new").select(*messages.columns)


def by_file_name(files: DataFrame, results: DataFrame) -> DataFrame:
    """files with the result of each one's upload, found by file_name; of several results of a name, that with the
    smallest id counts. Files without a result have nulls."""
    rest = [c for c in results.columns if c not in ("id", "file_name")]
    first = results.groupBy("file_name").agg(*[F.min_by(c, "id").alias(c) for c in rest])
    return files.join(first, "file_name", "left")


def dashboard(kbs: DataFrame, chats: DataFrame) -> DataFrame:
    """(user_id, knowledge_bases, chats): how many of each an owner has."""
    one, zero = F.lit(1).alias("k"), F.lit(0).alias("k")
    rows = kbs.select("user_id", one).unionByName(chats.select("user_id", zero))
    return rows.groupBy("user_id").agg(F.count_if(F.col("k") == 1).alias("knowledge_bases"), F.count_if(F.col("k") == 0).alias("chats"))


def first_task_status(tasks: DataFrame) -> DataFrame:
    """(document_id, status): the state of the task with the smallest id of every document."""
    return tasks.groupBy("document_id").agg(F.min_by("status", "id").alias("status"))


def new_uploads(files: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Pending upload rows of files (kb_id, file_name, file_hash, file_size, content_type) that their knowledge base
    doesn't hold unchanged; staged below a temporary path until they are processed."""
    fresh = upload_status(files, documents).filter("status = 'pending'")
    path = F.concat(F.lit("kb_"), F.col("kb_id").cast("string"), F.lit("/temp/"), F.col("file_name"))
    return fresh.select(F.col("kb_id").alias("knowledge_base_id"), "file_name", "file_hash", "file_size", "content_type", path.alias("temp_path"), now.alias("created_at"), "status", F.lit(None).cast("string").alias("error_message"))


def asked(messages: DataFrame, questions: DataFrame) -> DataFrame:
    """messages with each chat's question (chat_id, content) appended, and an empty answer to be filled later."""
    last = messages.groupBy("chat_id").agg(F.max("id").alias("last"))
    new = questions.join(last, "chat_id", "left").withColumn("last", F.coalesce("last", F.col("chat_id") * 1000))
    turn = lambda k, role, content: new.select((F.col("last") + k).alias("id"), "chat_id", F.lit(role).alias("role"), content.alias("content"))
    return messages.select("id", "chat_id", "role", "content").unionByName(turn(1, "user", F.col("content"))).unionByName(turn(2, "assistant", F.lit("")))

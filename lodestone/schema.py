"""Tables of the data model, as DDL, and the migrations between schema versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES: dict[str, str] = {
    "users": "id INT, email STRING, username STRING, hashed_password STRING, is_active BOOLEAN, is_superuser BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "knowledge_bases": "id INT, name STRING, description STRING, user_id INT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "documents": "id INT, file_path STRING, file_name STRING, file_size BIGINT, content_type STRING, file_hash STRING, knowledge_base_id INT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "document_uploads": "id INT, knowledge_base_id INT, file_name STRING, file_hash STRING, file_size BIGINT, content_type STRING, temp_path STRING, created_at TIMESTAMP, status STRING, error_message STRING",
    "processing_tasks": "id INT, knowledge_base_id INT, document_id INT, document_upload_id INT, status STRING, error_message STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "document_chunks": "id STRING, kb_id INT, document_id INT, file_name STRING, chunk_text STRING, chunk_index INT, chunk_metadata MAP<STRING,STRING>, hash STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "chats": "id INT, title STRING, user_id INT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "messages": "id INT, content STRING, role STRING, chat_id INT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "chat_knowledge_bases": "chat_id INT, knowledge_base_id INT",
    "points": "point_id STRING, kb_id INT, dense ARRAY<FLOAT>, sparse MAP<STRING,DOUBLE>, payload MAP<STRING,STRING>",
}

TASK_STATES = ("pending", "processing", "completed", "failed")


def _columns_from_metadata(chunks: DataFrame) -> DataFrame:
    """Chunk text and position move from the JSON metadata to columns of their own."""
    meta = F.from_json("chunk_metadata", "map<string,string>")
    own = ("page_content", "chunk_index")
    return chunks.select(
        *[c for c in chunks.columns if c not in ("chunk_metadata", "chunk_text", "chunk_index")],
        F.coalesce(F.get_json_object("chunk_metadata", "$.page_content"), F.lit("")).alias("chunk_text"),
        F.get_json_object("chunk_metadata", "$.chunk_index").try_cast("int").alias("chunk_index"),
        F.to_json(F.map_filter(meta, lambda k, v: ~k.isin(*own))).alias("chunk_metadata"),
    )


def _metadata_from_columns(chunks: DataFrame) -> DataFrame:
    meta = F.coalesce(F.from_json("chunk_metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = F.create_map(F.lit("page_content"), F.col("chunk_text"), F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    return chunks.select(*[c for c in chunks.columns if c not in ("chunk_metadata", "chunk_text", "chunk_index")], F.to_json(F.map_concat(F.map_filter(meta, lambda k, v: ~k.isin("page_content", "chunk_index")), own)).alias("chunk_metadata"))


#: (version, upgrade, downgrade) of document_chunks, in order.
MIGRATIONS: list[tuple[int, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]] = [(1, _columns_from_metadata, _metadata_from_columns)]


def migrate(chunks: DataFrame, have: int, want: int) -> DataFrame:
    """chunks brought from schema version have to version want."""
    if not 0 <= have <= len(MIGRATIONS) or not 0 <= want <= len(MIGRATIONS):
        raise ValueError(f"no schema version between {have} and {want}")
    for version, up, _ in MIGRATIONS:
        if have < version <= want:
            chunks = up(chunks)
    for version, _, down in reversed(MIGRATIONS):
        if want < version <= have:
            chunks = down(chunks)
    return chunks

"""Files as documents: loading by extension, and the file store of uploads."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import content_type, extension

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
Loader = Callable[[bytes], str]


def docx_text(raw: bytes) -> str:
    """Paragraphs of a DOCX body, with tabs and line breaks."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    mark = {f"{_W}t": None, f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "\n\n".join("".join((n.text or "") if mark[n.tag] is None else mark[n.tag] for n in p.iter() if n.tag in mark) for p in root.iter(f"{_W}p"))


def pdf_text(raw: bytes) -> str:
    """Pages of a PDF; needs a PDF parser on the executors."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)


def plain_text(raw: bytes) -> str:
    return raw.decode("utf-8-sig")


LOADERS: dict[str, Loader] = {".pdf": pdf_text, ".docx": docx_text, ".md": plain_text}


def load_files(spark: SparkSession, path: str, glob: str | None = None, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """(path, file_name, file_size, content_type, file_hash, text, status, error_message) of all files under a
    path. Loaders go by extension, plain text by default; a file that can't be read is "failed" with a reason."""
    use = LOADERS | (loaders or {})
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    meta = files.select("path", name.alias("file_name"), F.col("length").alias("file_size"), content_type(name).alias("content_type"), F.sha2("content", 256).alias("file_hash"), extension(name).alias("ext"), "content")
    keep = ["path", "file_name", "file_size", "content_type", "file_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                b = whole.slice(at, 16)
                text, status, error = [], [], []
                for ext, raw in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                    try:
                        text.append(use.get(ext, plain_text)(raw or b""))
                        status.append("completed")
                        error.append(None)
                    except Exception as e:  # whatever a parser raises is the file's reason
                        text.append(None)
                        status.append("failed")
                        error.append(f"{type(e).__name__}: {e}"[:500])
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(text, pa.string()), pa.array(status), pa.array(error, pa.string())], names=[*keep, "text", "status", "error_message"])

    schema = meta.select(*keep).schema.add("text", "string").add("status", "string").add("error_message", "string")
    return meta.mapInArrow(run, schema)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of plain text or markdown files, whole."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


class FileStore:
    """Uploaded files below a base path, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.base))

    def full(self, path: str) -> str:
        if ".." in path.split("/"):
            raise ValueError("a path must not lead out of the store")
        return f"{self.base}/{path.lstrip('/')}"

    def save(self, path: str, content: bytes) -> None:
        """Write bytes, with the directories above them; an older file is replaced."""
        out = self._fs.create(self._path(self.full(path)), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def move(self, source: str, to: str) -> None:
        to = self.full(to)
        self._fs.mkdirs(self._path(to).getParent())
        self._fs.delete(self._path(to), False)
        if not self._fs.rename(self._path(self.full(source)), self._path(to)):
            raise FileNotFoundError(source)

    def delete(self, path: str) -> None:
        """Delete a file; one that isn't there is no error."""
        self._fs.delete(self._path(self.full(path)), False)

    def delete_kb(self, user_id: int, kb_id: int) -> None:
        self._fs.delete(self._path(self.full(kb_path(user_id, kb_id))), True)

    def list(self, prefix: str = "") -> DataFrame:
        """(path, length) of all files under a prefix."""
        if not self._fs.exists(self._path(self.full(prefix))):
            return self.spark.createDataFrame([], "path string, length long")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.full(prefix))
        return files.select(F.regexp_replace("path", f"^.*?{re.escape(self.base.split(':')[-1])}/", "").alias("path"), "length")


def kb_path(user_id: int, kb_id: int) -> str:
    return f"user_{user_id}/kb_{kb_id}"

"""WARC archives compressed record by record with a dictionary of their own.

An archive is a ``.warc.zst`` stream: a skippable frame (magic 0x184D2A5D) with a Zstandard dictionary built
from records of that archive, then one frame for each record. The text writer of Spark stores the bytes, so
archives commit like any other Spark output; the newline byte that it adds after each row is the content of a
one-byte skippable frame, so every archive is a plain sequence of Zstandard frames. A task ends an archive and
begins the next, with a dictionary of its own, after ARCHIVE_ROWS rows of about CHUNK_BYTES.

Record ids are unique: they name the page, the task and the record's number in it. A revisit names its page's
response by page (WARC-Refers-To-Page), as that record's number isn't known where the revisit is written.

Contract: every row is archived, null html as an empty payload. Of the rows with equal payloads of at least
``min_revisit`` bytes, those with the smallest page_id (null only if all are null) are response records, all
others are revisits that name it; smaller payloads are always response records. A repeated page_id gets a
record for each row. Null urls become empty target URIs. An empty table gives no record.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK_BYTES, shared_path, staged
from lodestone.llm.sentencepiece_bpe import text_slices

DICTIONARY_FRAME, SPARE_FRAME = 0x184D2A5D, 0x184D2A50
ZSTD_MAGIC = 0xFD2FB528
#: Bytes of the dictionary, and of the records it is built from (evenly spaced ones of the first rows held).
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
#: Copies of each repeated payload's row, over which its revisits are dealt out.
SALTS = 32
#: Rows of an archive, each with about CHUNK_BYTES of compressed records.
ARCHIVE_ROWS = 64
#: Revisits (an id and a digest each) that are broadcast; beyond, both sides shuffle.
TWINS = 200_000


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: str, number: str) -> bytes:
    name = "null" if page is None else str(page)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}:{number}>", f"WARC-Page: {name}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers}"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from evenly spaced records of SAMPLE_BYTES in all; empty if they are too few or small."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[: 128 << 10] for r in records[::step]]
    if len(sample) < 8 or sum(map(len, sample)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample, k=200, d=8, steps=1, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 3, archive_rows: int = ARCHIVE_ROWS) -> None:
    """Write (page_id, url, payload, payload_digest, refers_to, revisit) rows to archives under path, as many
    for each partition as their size asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held, size, packer, out, made, rows = [], 0, None, [], 0, 0

        def row() -> pa.RecordBatch:
            nonlocal out, made, rows
            out.append(struct.pack("<II", SPARE_FRAME, 1))
            b = pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])
            out, made, rows = [], 0, rows + 1
            return b

        def packed() -> Iterator[pa.RecordBatch]:
            """Compress what is held; an archive begins with the dictionary of what is held then."""
            nonlocal held, size, packer, made, rows
            todo, held, size = held, [], 0
            for n, raw in enumerate(todo):
                if packer is None:
                    dictionary = build_dictionary(todo[n:])
                    out.append(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                    made += len(dictionary)
                    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
                    if d:
                        d.precompute_compress(level)
                    packer = zstandard.ZstdCompressor(level=level, dict_data=d)
                out.append(packer.compress(raw))
                made += len(out[-1])
                if made >= CHUNK_BYTES:
                    yield row()
                    if rows == archive_rows:
                        packer, rows = None, 0

        for b in (part for whole in batches for part in text_slices(whole, 2)):
            for fields in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(_record(*fields, date, f"{task}-{number}"))
                number += 1
                size += len(held[-1])
                if packer is not None or size >= 2 * SAMPLE_BYTES:
                    yield from packed()
        yield from packed()
        if out:
            yield row()

    columns = pages.select("page_id", "url", "payload", "payload_digest", "refers_to", "revisit")
    columns.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", archive_rows).text(path)


def _ends(content: bytes) -> list[tuple[int, int]]:
    """Begin and end of every frame, from frame and block headers alone."""
    out, at = [], 0
    while at < len(content):
        (magic,) = struct.unpack_from("<I", content, at)
        begin = at
        if magic & 0xFFFFFFF0 == SPARE_FRAME:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
        elif magic == ZSTD_MAGIC:
            flags = content[at + 4]
            single, check = flags >> 5 & 1, flags >> 2 & 1
            at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
            last = 0
            while not last:
                head = int.from_bytes(content[at : at + 3], "little")
                last, kind, n = head & 1, head >> 1 & 3, head >> 3
                at += 3 + (1 if kind == 1 else n)
            at += 4 * check
        else:
            raise ValueError("no Zstandard frame")
        out.append((begin, at))
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to and payload (null for revisits). The digest of a response is computed from its payload and
    must equal its header's."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    page = lambda name: None if name == "null" else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                content = content.as_py()
                reader, rows, size = zstandard.ZstdDecompressor(), [], 0
                for begin, end in _ends(content):
                    (magic,) = struct.unpack_from("<I", content, begin)
                    if magic != ZSTD_MAGIC:
                        if magic == DICTIONARY_FRAME and end > begin + 8:
                            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[begin + 8 : end]))
                        continue
                    f, body = _parse(reader.decompress(content[begin:end]))
                    digest, revisit = f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"] == "revisit"
                    if not revisit and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(f["X-Payload-Length"])):
                        raise ValueError(f"{f['WARC-Record-ID']}: the payload doesn't match its digest")
                    rows.append((page(f["WARC-Page"]), f["WARC-Target-URI"], f["WARC-Type"], int(f["X-Payload-Length"]), digest, page(f["WARC-Refers-To-Page"]) if revisit else None, None if revisit else body))
                    size += len(body)
                    if size > CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def with_revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to, revisit) of (page_id, url, html) rows.

    Only digests and ids are compared: each repeated payload's smallest page_id, in SALTS copies, meets the
    rows of that payload, and what they refer to meets the pages by page_id, so a payload that a third of all
    rows share is spread over tasks."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    keys = staged(rows.filter(F.length("payload") >= min_revisit).select("page_id", F.unhex("payload_digest").alias("digest")), "digests")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    twins = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(firsts.hint("merge"), ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    twins = staged(twins.select(F.col("page_id").alias("id2"), F.hex("digest").alias("digest2"), F.col("first").alias("refers_to")).dropDuplicates(["id2", "digest2"]), "twins")
    twins = F.broadcast(twins) if twins.count() <= TWINS else twins.hint("merge")  # then payloads needn't move
    # A null page_id can be a revisit too: the join key is null-safe.
    match = F.col("page_id").eqNullSafe(F.col("id2")) & (F.upper("payload_digest") == F.col("digest2"))
    return rows.join(twins, match, "left").select("page_id", "url", "payload", "payload_digest", "refers_to", F.col("digest2").isNotNull().alias("revisit"))


def round_trip(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """Archive all pages in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(with_revisits(pages, min_revisit), path)
    return read_archives(spark, path)

"""Text and id functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "__LLM_RESPONSE__"
#: The namespace of object ids, for uuid5.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"
#: Content types by file extension.
CONTENT_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".md": "text/markdown",
    ".txt": "text/plain",
}
#: Questions about the assistant itself.
IDENTITY = (
    "who\\s+are\\s+you",
    "what\\s+are\\s+you",
    "introduce\\s+yourself",
    "tell\\s+me\\s+about\\s+yourself",
    "what\\s+is\\s+your\\s+name",
    "what('s| is)\\s+your\\s+purpose",
    "what\\s+can\\s+you\\s+do",
)
#: Markdown and marks that a chat's preview leaves out, in the order of their removal.
PREVIEW = (
    ("(?s)<think>.*?</think>", ""),
    ("\\[citation:\\d+\\]", ""),
    ("(?m)^#{1,6}\\s+", ""),
    ("(\\*\\*|__)(.*?)\\1", "$2"),
    ("(\\*|_)(.*?)\\1", "$2"),
    ("`([^`]+)`", "$1"),
    ("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"),
    ("(?U)\\s+", " "),
)
#: The spellings of citation marks, in the order in which they are normalised.
CITATIONS = (
    ("\\[\\[[cC]itation", "[citation"),
    ("[cC]itation:(\\d+)\\]\\]", "citation:$1]"),
    ("\\[\\[([cC]itation:\\d+)\\]\\](?!\\])", "[$1]"),
    ("\\[[cC]itation:(\\d+)\\]", "[citation]($1)"),
)
TOKEN = "[\\p{L}\\p{N}_]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores, of any length, stopwords included."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(kb: Column, file_name: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", kb.cast("string"), file_name, text), 256)


def canonical_metadata(m: Column) -> Column:
    """A map as JSON with sorted keys: equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def versioned_hash(text: Column, metadata: Column) -> Column:
    """Hash of a chunk's text and metadata, which tells whether it changed."""
    return F.sha2(F.concat(text, canonical_metadata(metadata)), 256)


def uuid5_oid(name: Column) -> Column:
    """uuid5 of a name in the namespace of object ids."""
    digest = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def extension(name: Column) -> Column:
    """Lower-case suffix of the base name with its dot, or an empty string; leading dots don't begin a suffix."""
    return F.lower(F.regexp_extract(name, "(?:^|/)\\.*[^/.][^/]*?(\\.[^./]*)$", 1))


def content_type(name: Column) -> Column:
    ext = extension(name)
    out = F.lit("application/octet-stream")
    for suffix, kind in CONTENT_TYPES.items():
        out = F.when(ext == suffix, kind).otherwise(out)
    return out


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^\\p{L}\\p{N}_.-]", "")


def object_path(user: Column, kb: Column, name: Column) -> Column:
    return F.format_string("user_%s/kb_%s/%s", user.cast("string"), kb.cast("string"), name)


def icon(kind: Column, name: Column) -> Column:
    """File icon: by the content type, else the last part of the name."""
    low, out = F.lower(kind), F.element_at(F.split(name, "\\."), -1)
    for part in ("md", "txt", "doc", "pdf"):
        out = F.when(F.contains(low, F.lit(part)), part).otherwise(out)
    return out


def size_mb(n: Column) -> Column:
    return F.concat(F.format_string("%.2f", n / 1024 / 1024), F.lit(" MB"))


def size_kb(n: Column) -> Column:
    return F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))


def without_think(answer: Column, fallback: Column) -> Column:
    """A rewritten question without reasoning blocks; the original one if nothing is left."""
    return F.coalesce(F.nullif(strip(F.regexp_replace(strip(answer), "(?s)<think>.*?</think>", "")), F.lit("")), fallback)


def history_text(content: Column) -> Column:
    """What an assistant said: the part behind the last sentinel."""
    return F.element_at(F.split(content, SENTINEL), -1)


def shown_text(content: Column) -> Column:
    """What a list of chats shows: the part between the first and the second sentinel."""
    return F.when(F.contains(content, F.lit(SENTINEL)), F.get(F.split(content, SENTINEL), 1)).otherwise(content)


def preview(content: Column) -> Column:
    """One line of plain text: reasoning, citations and markdown marks removed."""
    out = shown_text(content)
    for pattern, to in PREVIEW:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def shortened(c: Column, n: int = 300) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def citation_links(c: Column) -> Column:
    """Citation marks in their various spellings as markdown links to the number."""
    for pattern, to in CITATIONS:
        c = F.regexp_replace(c, pattern, to)
    return c


def think_split(c: Column) -> Column:
    """struct(think, complete, answer) of an answer that may begin with a reasoning block, closed or still open."""
    closed, opened = F.rlike(c, F.lit("(?s)^<think>.*?</think>")), F.startswith(c, F.lit("<think>"))
    pattern = "(?s)^<think>(.*?)</think>(.*)$"
    think = F.when(closed, strip(F.regexp_extract(c, pattern, 1))).when(opened, F.substr(c, F.lit(8)))
    answer = F.when(closed, strip(F.regexp_extract(c, pattern, 2))).when(opened, F.lit("")).otherwise(c)
    return F.struct(think.alias("think"), closed.alias("complete"), answer.alias("answer"))


def is_identity(c: Column) -> Column:
    return F.rlike(c, F.lit(f"(?i)^\\s*({'|'.join(IDENTITY)})\\s*\\??\\s*$"))


def base64_line(c: Column) -> Column:
    return F.regexp_replace(F.base64(c.cast("binary")), "[\\r\\n]", "")


def ascii_json(c: Column) -> Column:
    """JSON text with every character beyond ASCII escaped, for readers that decode base64 as bytes."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(ch: Column) -> Column:
        code = F.ascii(ch)
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), unit(F.lit(0xDC00) + (code - 0x10000) % 1024))
        return F.when(code < 128, ch).when(code < 0x10000, unit(code)).otherwise(pair)

    wide = F.rlike(c, F.lit("[^\\x00-\\x7F]"))
    return F.when(wide, F.array_join(F.transform(F.split(c, ""), escaped), "")).otherwise(c)


def ints(c: Column) -> Column:
    """Comma-separated integers; a bad one is an error."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).cast("int"))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago: the largest whole unit of days, hours or minutes ("3 hours ago"), else "just now"."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    said = lambda unit, size: F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(f" {unit}"), F.when(seconds >= 2 * size, F.lit("s")).otherwise(F.lit("")), F.lit(" ago")))
    return F.coalesce(said("day", 86_400), said("hour", 3_600), said("minute", 60), F.when(seconds.isNotNull(), F.lit("just now")))


def percent(score: Column) -> Column:
    """A score as a percentage with one decimal place."""
    return F.format_string("%.1f%%", F.round(score * 100, 1))

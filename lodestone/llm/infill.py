"""Fill-in-middle transformation: every batch of texts is registered with DuckDB, and one statement cuts, orders
and restores all of its texts.

A text is cut into units; two hashes of its id choose where the prefix and the middle end, a third whether it is
transformed at all, and a fourth the order of the parts. All of it is decided by (id, text), so that reruns, retried
tasks and other partitions agree, and no row meets another one.

Contract: null texts count as empty and stay plain, as do texts that contain a sentinel. A null id hashes as the
empty string behind the seed. Rows are independent: repeated rows give repeated results, and an empty table gives none.
Columns of any names pass through; one that has an output's name is replaced. Texts are whole at any length; a batch is
cut to about CHUNK_BYTES of text, and a longer text is a batch of its own, which takes some 100 bytes for each unit
beside the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import CHUNK_BYTES
from lodestone.llm.sentencepiece_bpe import text_slices

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Infill:
    """unit: a pattern whose matches make up the whole text; seed: stands before ':' and the id in the hashed string;
    percent of texts that are transformed, and spm_percent of those that put the suffix first."""

    unit: str = LINES
    seed: int = 7
    percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3 or any(m[0] in o[1:] for m in marks for o in marks) or any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("sentinels must differ, none may begin another, and their first characters may stand nowhere else in them")


#: What stands between $: parameters of the statement.
_SQL = r"""
WITH hashed AS (
    SELECT text, sha256($seed || ':' || coalesce(id, '')) AS h, regexp_extract_all(text, $unit) AS units
    FROM (SELECT id, coalesce(text, '') AS text FROM batch)),
chosen AS (
    SELECT text, units, len(units) AS n,
           ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
           CASE WHEN text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m)
                     OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= $percent THEN 'plain'
                WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
    FROM hashed),
parts AS (
    SELECT text, n, form,
           array_to_string(list_slice(units, 1, least(c1, c2)), '') AS prefix,
           array_to_string(list_slice(units, least(c1, c2) + 1, greatest(c1, c2)), '') AS middle,
           array_to_string(list_slice(units, greatest(c1, c2) + 1, n), '') AS suffix
    FROM chosen),
written AS (
    SELECT n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           CASE form WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle
                     WHEN 'spm' THEN $s || suffix || $p || prefix || $m || middle ELSE text END AS output
    FROM parts),
"""
#: The text again, from the columns output and form of the relation `written` alone.
_BACK = r"""
found AS (SELECT *, strpos(output, $p) AS at_p, strpos(output, $s) AS at_s, strpos(output, $m) AS at_m FROM written)
SELECT * EXCLUDE (at_p, at_s, at_m),
       CASE form WHEN 'psm' THEN substr(output, 1 + length($p), at_s - 1 - length($p)) || substr(output, at_m + length($m)) || substr(output, at_s + length($s), at_m - at_s - length($s))
                 WHEN 'spm' THEN substr(output, at_p + length($p), at_m - at_p - length($p)) || substr(output, at_m + length($m)) || substr(output, 1 + length($s), at_p - 1 - length($s))
                 ELSE output END AS restored
FROM found"""

_connections: list[duckdb.DuckDBPyConnection] = []


def _ask(sql: str, batch: pa.Table, values: dict[str, object]) -> pa.Table:
    """The statement's result over one registered batch, in the batch's order: one thread keeps it."""
    if not _connections:
        _connections.append(duckdb.connect(":memory:", config={"threads": 1, "preserve_insertion_order": True, "temp_directory": ""}))
    con = _connections[0]
    con.register("batch", batch)
    try:
        return con.sql(sql, params={k: v for k, v in values.items() if f"${k}" in sql}).to_arrow_table()
    finally:
        con.unregister("batch")


def _through(df: DataFrame, first: list[str], names: list[str], outputs: list[T.StructField], sql: str, values: dict[str, object]) -> DataFrame:
    """df without the last of its columns `first`, which the statement knows by names, and the statement's columns behind the
    rest."""
    kept = [c for c in df.columns if c not in {first[-1], *(f.name for f in outputs)}]
    # Names such as "a.b" can't be passed through, so all columns go by place.
    taken = df.select(*(F.col(f"`{c}`").cast("string") for c in first), *(F.col(f"`{c}`") for c in kept)).toDF(*(f"c{i}" for i in range(len(first) + len(kept))))
    fields = [*taken.schema.fields[2:], *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, 1, CHUNK_BYTES):
                got = _ask(sql, pa.table(b.columns[:2], names=names), values).combine_chunks()
                made = [pa.array([], c.type) if not c.num_chunks else c.chunk(0) for c in got.columns]
                yield pa.RecordBatch.from_arrays([*b.columns[2:], *made], names=[f.name for f in fields])

    return taken.mapInArrow(run, T.StructType(fields)).toDF(*kept, *(f.name for f in outputs))


def _values(how: Infill) -> dict[str, object]:
    return {"seed": str(how.seed), "unit": how.unit, "percent": how.percent, "spm": how.spm_percent, "p": how.prefix, "s": how.suffix, "m": how.middle}


def fill_in_middle(df: DataFrame, id: str = "doc_id", text: str = "text", how: Infill = Infill()) -> DataFrame:
    """df without its text, and n long (units), form (plain, psm or spm), prefix_chars and middle_chars long (code points,
    null where plain), output (what a model is trained on), restored (the text again, from output and form)."""
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType(), "restored": T.StringType()}
    outputs = [T.StructField(name, kind) for name, kind in kinds.items()]
    return _through(df, [id, text], ["id", "text"], outputs, _SQL + _BACK, _values(how))


def restored(df: DataFrame, form: str = "form", output: str = "output", how: Infill = Infill()) -> DataFrame:
    """df without its output, and the restored text: the inverse for outputs that were stored."""
    sql = "WITH written AS (SELECT form, output FROM batch)," + _BACK.replace("SELECT * EXCLUDE (at_p, at_s, at_m),", "SELECT")
    return _through(df, [form, output], ["form", "output"], [T.StructField("restored", T.StringType())], sql, _values(how))

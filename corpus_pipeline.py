"""A training-corpus pipeline over the documents table: toxic documents go, one document of each group of near
copies stays, sources are mixed to weights, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

Of all stages: columns of docs can have any names; rows with null ids, texts or sources take part; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, ngram_join, sentencepiece_bpe, toxicity
from lodestone.llm.common import staged
from lodestone.llm.queries import PIECE_MODEL


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't classified as toxic; the model learns from those of docs that are labelled. Rows
    are judged by their text alone, repeated rows alike; null and empty texts score as having nothing toxic. Without
    labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = max(docs.columns, key=len) + "_"  # a name that no column has
    scored = toxicity.score(docs, toxicity.train(docs, labels), into=own)
    return scored.filter(F.col(f"`{own}`") < 0.5).drop(own)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of sets of five-word shingles.
    Repeated rows are linked; rows with a null id, and texts without a word, are linked with nothing and stay."""
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights: rows are left out, kept or repeated, up to twice. A null source is one of its
    own; texts without a word weigh nothing."""
    return mixing.take(docs, staged(mixing.mix(mixing.sized(docs)), "mixed"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): every document's ids, its end id included, and the text they decode to. A null
    text counts as empty; repeated rows give repeated results."""
    out = sentencepiece_bpe.encode_decode(docs.select("doc_id", "text"), PIECE_MODEL)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", toxicity_stage), ("ngram-jaccard-join", ngram_stage), ("mixing-sources", mixing_stage), ("sentencepiece", encoding_stage)]

#: Training, balanced sampling and merge rounds are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

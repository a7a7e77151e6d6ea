"""Mixing sources to target weights by balanced sampling (the cube method).

Every source gets a share of the mix by weight, up to a cap; the ratio of target to size says how many whole
copies each of its documents gets and with which probability it gets one more. The cube method settles those
probabilities: it moves all of them together along the null space of the two balancing constraints (words
and documents of the source) until one is 0 or 1, so both totals stay put while all but two probabilities of
a group are settled. Documents are dealt to groups of bounded size by a hash; what is left of the groups meets
in fewer groups, again and again, until each source has a few documents left. These land on the choice whose words are
the nearest to what they should be, of those that round their number up or down; their own probabilities, alone, aren't kept.

Contract: null texts have size 0; a null source is a source of its own, the last in rank; a repeated row is a
document of its own; an empty table gives no row. Sources are ranked and their shares computed in one task,
over one row for each source. The outcome depends on ids, sizes and the seed alone, not on partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import join_checked, staged

#: Documents of a group of the flight phase.
GROUP = 2048
#: Groups whose leftovers (two documents each) meet in one group of the next level.
MERGE = 512
#: Documents of a source that land together.
LANDING = 14
_EPS = 1e-9


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_docs, source_size, target) of (source, size) rows. The targets add up to ratio times
    all sizes if caps allow; sources beyond cap times their size stop there and the rest shares the excess
    by weight."""
    by = sizes.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    by = by.withColumn("w", w).withColumn("cap", F.lit(float(cap)) * F.col("source_size")).withColumn("all", F.sum("source_size").over(every) * F.lit(float(ratio)))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("all") - before) / F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", level).withColumn("rank", F.row_number().over(full))
    # Sources in front are full; the first whose share stays within its cap sets the level for all behind it.
    level = F.min_by(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("rank"))).over(every)
    return by.withColumn("target", F.coalesce(F.least("cap", level * F.col("w")), F.col("cap"))).select("source", "source_docs", "source_size", "target")


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move the probabilities p along the null space of the constraints (sum of p, sum of p * x) until two fractional
    ones are left at most; with land, settle the last LANDING or fewer together.

    A move goes along what the null space has of the first fractional row's own direction: it settles early, however long
    it is, as all others make up for it a little."""
    out, size = np.array(p, float), np.asarray(x, float)
    sure = np.abs(out - np.round(out)) < _EPS
    out[sure] = np.round(out[sure])
    live = np.flatnonzero(~sure)
    draw = iter(rng.random(len(out) + 8).tolist())
    while len(live) > (LANDING if land else 2):
        u = _direction(size[live])
        if u is None:
            break
        v = out[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - v) / u, np.where(u < 0, v / -u, np.inf)).min()
            down = np.where(u > 0, v / u, np.where(u < 0, (1 - v) / -u, np.inf)).min()
        v = v + (up if next(draw) * (up + down) < down else -down) * u
        v[v < _EPS], v[v > 1 - _EPS] = 0.0, 1.0
        out[live] = v
        live = live[(v > 0) & (v < 1)]
    if land and len(live):
        out[live] = _landing(out[live], size[live], rng)
    return out


def _direction(x: np.ndarray) -> np.ndarray | None:
    """A direction that leaves the sum and the sum by x as they are: what the first row's own has of it, or the next row's that
    has any. Two rows of different x have none."""
    c = x - x.mean()
    square = float(c @ c)
    c = c / np.sqrt(square) if square > 1e-9 else np.zeros(len(x))
    own = 1 - 1 / len(x) - c * c  # squared length of what is left of each row's direction
    i = int(np.argmax(own > 1e-6))
    if own[i] <= 1e-6:
        return None
    u = -1 / len(x) - c[i] * c
    u[i] += 1
    u[np.abs(u) < 1e-12] = 0.0
    return u / np.abs(u).max()


def _landing(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The choice of rows whose number is the nearest to the sum of p, and of these the one nearest to the sum of p * x;
    equal ones by lot."""
    every = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    off = np.abs(every @ x - p @ x)
    off[np.abs(every.sum(axis=1) - p.sum()) >= 1 - 1e-9] = np.inf  # the number is rounded up or down
    best = np.flatnonzero(off <= off.min() + 1e-6)
    return every[best[rng.integers(len(best))]].astype(float)


def _settle(seed: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: those that land are short.
        g = g.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], na_position="last", kind="stable")
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode()), int(key[1])])
        g["p"] = flight(g["p"].to_numpy(), g["size"].to_numpy(float), rng, bool(g["groups"].iloc[0] <= 1))
        return g

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ratio: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """(doc_id, source, h, size, source_size, target, copies) of (doc_id, source, size, h) rows: how often
    the mix takes each document. h is a hash of the document that orders and deals the rows."""
    docs = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"), "h"), "mix-sizes")
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name")  # "" stands for null
    targets = staged(source_targets(docs, weights, ratio, cap), "mix-targets").select(name, "source_docs", "source_size", "target")
    rows = join_checked(docs.select("*", name), targets, "name")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(share)).withColumn("p", share - F.floor(share)).withColumn("groups", F.ceil(F.col("source_docs") / GROUP))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("h", "doc_id"), F.col("groups")))
    schema, done = rows.schema, []
    while True:
        rows = staged(rows.groupBy("name", "grp").applyInPandas(_settle(seed), schema), "mix-flight")
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(rows.filter(settled))
        left = rows.filter(~settled)
        if not left.head(1):
            break
        rows = left.withColumn("grp", F.floor(F.col("grp") / MERGE)).withColumn("groups", F.ceil(F.col("groups") / MERGE))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "h", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, h) of documents."""
    return df.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(F.col("doc_id"), F.col(text)).alias("h"))


def take(df: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """df with every row as often as mixed, a result of ``mix`` over ``sized(df)``, takes it. Rows equal in
    id, source and text are interchangeable: together they are taken as often as all of them. Columns of df can
    have any names."""
    per = mixed.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("src"), "h").agg(F.sum("copies").alias("copies"), F.count("*").alias("same")).filter("copies > 0")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.col("source").alias("own_src"), F.xxhash64(F.col("doc_id"), F.col(text)).alias("h"))
    rows = rows.join(per.hint("merge"), "h").filter(F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_src").eqNullSafe(F.col("src")))
    once = rows.filter("same = 1")
    twins = rows.filter("same > 1").dropDuplicates(["h", "own_id", "own_src"])
    return once.unionByName(twins).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

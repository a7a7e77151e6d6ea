"""Merkle manifest of a dataset: a tree of digests over each group of rows, and one over the groups' roots.

Rows are hashed where they are read, dealt by (group, id) ranges, and numbered within their group by the rows of earlier
ranges. Every task then walks its stretch of numbered leaves with a stack of unfinished runs, one for each level, as in a
mountain range: a run of `fanout` nodes that is full, or is its level's last one, carries its digest to the next level and
leaves a node record with its children. What begins or ends in the middle of a run stays open: at most fanout - 1 nodes on
either side of each level. Open nodes of all tasks are merged by run, level by level. Short last runs are hashed as they
are, without padding, even of one node.

Proofs go the other way: from the root down, each node gets the siblings on its way, until the leaves join their run. No
step gathers more than one run in a row, whatever a group's size.

Contract: rows of a group ascend by id, null ids first; rows of equal ids by leaf digest, and equal rows in any order, which
changes no digest. A null group is one of its own, before all others. Null fields count as '-'. Every row is a leaf, repeated
rows too. An empty table has no leaves, nodes or root. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import staged

#: Spans of rows, and bytes of their group names, up to which numbering broadcasts them; beyond, both sides are sorted.
SPAN_ROWS, SPAN_BYTES = 200_000, 16 << 20
_RECORD = "tree string, n long, level int, idx long, digest string, children array<string>"
_STEPS = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Manifest:
    """leaves: (tree, idx, n, digest, and the columns carried); nodes: (tree, n, level, idx, digest, children) of every run,
    level 1 being that of the leaves' runs; depth: the highest level; fanout. A tree is named '' for the null group, and
    '=' with the group's name otherwise, which sorts as the groups do."""

    leaves: DataFrame
    nodes: DataFrame
    depth: int
    fanout: int

    def roots(self) -> DataFrame:
        """(tree, n, digest) of each tree: its last node, or its only leaf."""
        top = self.nodes.filter(_is_root(self.fanout)).select("tree", "n", "digest")
        return top.unionByName(self.leaves.filter("n = 1").select("tree", "n", "digest"))


def _is_root(fanout: int) -> Column:
    return F.pow(F.lit(float(fanout)), F.col("level")) >= F.col("n")


def row_digest(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields one after another: '-' for null, else byte count, ':' and value."""
    said = [F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields]
    return F.sha2(F.concat(*(F.coalesce(s, F.lit("-")) for s in said)), 256)


def tree_name(group: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, digest, ...) with idx, the place in the tree by order and then digest, and n, the tree's leaves.

    Rows are staged in ranges; a row's number is its place in its range's span of the tree, behind the spans before."""
    keys = ["tree", *order, "digest", "tie__"]
    tied = rows.withColumn("tie__", F.monotonically_increasing_id())  # so that equal rows can be split, too
    ranged = tied.repartitionByRange(*(F.asc_nulls_first(k) for k in keys)).sortWithinPartitions(*(F.asc_nulls_first(k) for k in keys))
    placed = staged(ranged.drop("tie__").withColumn("at__", F.monotonically_increasing_id()), "merkle-ranges")
    placed = placed.withColumn("part__", F.shiftrightunsigned("at__", 33))  # the partition; its rows count in the lower bits
    spans = placed.groupBy("part__", "tree").agg(F.min("at__").alias("first__"), F.count("*").alias("rows__"))
    in_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows__").over(in_tree.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = staged(spans.select("part__", "tree", "first__", before.alias("before__"), F.sum("rows__").over(in_tree).alias("n")), "merkle-spans")
    held = spans.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("tree")), F.lit(0))).head()
    if held[0] <= SPAN_ROWS and held[1] <= SPAN_BYTES:
        out = placed.join(F.broadcast(spans), ["part__", "tree"])  # keeps the order of the files
    else:
        out = placed.join(spans.hint("merge"), ["part__", "tree"]).sortWithinPartitions("at__")
    return out.withColumn("idx", F.col("at__") - F.col("first__") + F.col("before__")).drop("part__", "at__", "first__", "before__")


class Range:
    """The unfinished runs over a stretch of one tree's leaves. Finished ones go to `out` with their children, nodes
    that stay open without."""

    def __init__(self, tree: str, n: int, start: int, fanout: int, out: list[tuple]):
        self.tree, self.n, self.fanout, self.out, self.next = tree, n, fanout, out, start
        self.runs: list[tuple[int, list[str]]] = []  # of each level: first index, digests
        self.sizes = [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))

    def add(self, digests: list[str], level: int = 0, idx: int | None = None) -> None:
        """The next leaves, or the next node of a level."""
        at = self.next if idx is None else idx
        if idx is None:
            self.next += len(digests)
        if level == len(self.sizes) - 1:  # the root
            return
        taken = 0
        while taken < len(digests):
            end = min((at // self.fanout + 1) * self.fanout, self.sizes[level])  # of the run that at is in
            part = digests[taken : taken + end - at]
            while len(self.runs) <= level:
                self.runs.append((at, []))
            first, run = self.runs[level]
            if not run:
                first = at
            self.runs[level] = (first, run + part)
            at, taken = at + len(part), taken + len(part)
            if at == end:
                self._carry(level)

    def _carry(self, level: int) -> None:
        first, run = self.runs[level]
        self.runs[level] = (0, [])
        if first % self.fanout:
            self._open(level, first, run)
        else:
            up, idx = hashlib.sha256("".join(run).encode()).hexdigest(), first // self.fanout
            self.out.append((self.tree, self.n, level + 1, idx, up, run))
            self.add([up], level + 1, idx)

    def _open(self, level: int, first: int, run: list[str]) -> None:
        self.out += [(self.tree, self.n, level, first + k, d, None) for k, d in enumerate(run)]

    def close(self) -> None:
        for level, (first, run) in enumerate(self.runs):
            self._open(level, first, run)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def _stack(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: Range | None = None
        for b in batches:
            if not b.num_rows:
                continue
            tree, n, idx, digest = b.columns
            new = pc.or_(pc.not_equal(tree[1:], tree[:-1]), pc.not_equal(pc.subtract(idx[1:], idx[:-1]), 1))
            cuts = [0, *(k + 1 for k in pc.indices_nonzero(new).to_pylist()), b.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                name, at = tree[a].as_py(), idx[a].as_py()
                if held is None or held.tree != name or held.next != at:
                    if held is not None:
                        held.close()
                    held = Range(name, n[a].as_py(), at, fanout, out)
                for k in range(a, z, 4096):
                    held.add(digest[k : min(k + 4096, z)].to_pylist())
                    if len(out) >= 2048:
                        yield _records(out)
                        out.clear()
        if held is not None:
            held.close()
        for k in range(0, len(out), 2048):
            yield _records(out[k : k + 2048])

    return run


def forest(leaves: DataFrame, fanout: int = 16) -> Manifest:
    """The trees over numbered leaves (tree, digest, idx, n, ...)."""
    walked = staged(leaves.select("tree", "n", "idx", "digest").mapInArrow(_stack(fanout), _RECORD), "merkle-walked")
    largest = leaves.agg(F.max("n")).head()[0] or 0
    depth, size = 0, largest
    while size > 1:
        size, depth = -(-size // fanout), depth + 1
    nodes = walked.filter("children IS NOT NULL")
    carried: DataFrame | None = None
    for level in range(depth):
        loose = walked.filter((F.col("level") == level) & F.col("children").isNull()).select("tree", "n", "idx", "digest")
        if carried is not None:
            loose = loose.unionByName(carried.filter(~_is_root(fanout)).select("tree", "n", "idx", "digest"))
        runs = loose.groupBy("tree", "n", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        runs = runs.select("tree", "n", F.lit(level + 1).alias("level"), "idx", F.col("run.digest").alias("children"))
        carried = staged(runs.select("tree", "n", "level", "idx", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children"), "merkle-merged")
        nodes = nodes.unionByName(carried)
    return Manifest(leaves, nodes, depth, fanout)


def _step(children: str, place: Column) -> Column:
    """The digests beside a child, as (left, right)."""
    kids = F.col(children)
    left = F.array_join(F.slice(kids, F.lit(1), place), "")
    right = F.array_join(F.slice(kids, place + 2, F.size(kids)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def proofs(manifest: Manifest, above: DataFrame) -> DataFrame:
    """The manifest's leaves, all their columns and steps: the siblings (left, right: digests joined) in each run from the
    leaf up, then those in above (tree, steps), the way on from the tree's root; and above's other columns."""
    f, nodes = manifest.fanout, manifest.nodes
    more = [c for c in above.columns if c not in ("tree", "steps")]
    rooted = nodes.filter(_is_root(f)).join(above, "tree")
    down: DataFrame | None = None
    for level in range(manifest.depth, 0, -1):
        here = rooted.filter(F.col("level") == level).select("tree", "idx", "children", "steps", *more)
        if down is not None:
            own = nodes.filter((F.col("level") == level) & ~_is_root(f)).select("tree", "idx", "children")
            here = here.unionByName(own.join(down, ["tree", "idx"]).select("tree", "idx", "children", "steps", *more))
        if level > 1:
            child = here.select("*", F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("place"))
            steps = F.concat(F.array(_step("children", F.col("place"))), "steps").cast(_STEPS)
            down = child.select("tree", (F.col("idx") * f + F.col("place")).alias("idx"), steps.alias("steps"), *more)
        else:
            down = here
    lone = above.select("tree", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("array<string>").alias("children"), "steps", *more)
    runs = lone.join(manifest.leaves.filter("n = 1").select("tree"), "tree", "left_semi")
    if down is not None:
        runs = runs.unionByName(down)
    runs = runs.withColumnRenamed("idx", "run__")
    leaves = manifest.leaves.withColumn("run__", F.floor(F.col("idx") / f))
    beside = F.array(_step("children", (F.col("idx") % f).cast("int")))
    steps = F.when(F.col("children").isNull(), F.col("steps")).otherwise(F.concat(beside, "steps").cast(_STEPS))
    return leaves.join(runs, ["tree", "run__"]).select(*(f"`{c}`" for c in manifest.leaves.columns), steps.alias("steps"), *more)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_text(steps: Column) -> Column:
    """All siblings one after another, from the leaf up, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, id: str, group: str, fields: list[str], carried: dict[str, Column] | None = None, fanout: int = 16) -> tuple[DataFrame, Manifest, Manifest]:
    """(verifiable rows, the groups' trees, the tree over them).

    Rows: id, those carried (columns by name, computed of docs), leaf, subroot, root, steps. Each group's leaves are a tree,
    and the groups' roots, by name, are the leaves of one tree more, whose root is the dataset's."""
    carried = carried or {}
    if taken := {"id", "tree", "digest", "idx", "n", "leaf", "subroot", "root", "steps", "member", "children"} & set(carried):
        raise ValueError(f"carried columns need other names: {sorted(taken)}")
    rows = docs.select(F.col(f"`{id}`").alias("id"), tree_name(F.col(f"`{group}`")).alias("tree"), row_digest([F.col(f"`{c}`") for c in fields]).alias("digest"), *(c.alias(n) for n, c in carried.items()))
    groups = forest(numbered(staged(rows, "merkle-leaves"), ["id"]), fanout)
    subroots = staged(groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest"), "merkle-subroots")
    over = forest(numbered(subroots, ["member"]), fanout)
    start = over.roots().select("tree", F.array().cast(_STEPS).alias("steps"), F.col("digest").alias("root"))
    above = staged(proofs(over, start).select(F.col("member").alias("tree"), "steps", "root", F.col("digest").alias("subroot")), "merkle-above")
    out = proofs(groups, above).select("id", *carried, F.col("digest").alias("leaf"), "subroot", "root", "steps")
    return out, groups, over

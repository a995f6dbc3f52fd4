"""Merkle manifest of a dataset: trees of digests for each group, their roots under one root, a path for each row."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import forget, partitions, written

#: Hexadecimal digits of a digest.
WIDTH = 64
#: A block of a tree holds so many nodes at most at its lowest level.
BLOCK = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str | Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row's values: each `-` if null, else its UTF-8 byte count, a colon and itself as text."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


@dataclass(frozen=True)
class Forest:
    """Trees over the rows of each key.

    nodes: key, pos (from 0 in the key), n (rows of the key), digest and what came with them. rounds: for each block of
    nodes (key, block) its levels, from the lowest up; a level is the text of its digests side by side, so the
    preimage of parent p is the p-th stretch of fanout * WIDTH characters. roots: key and digest.
    """

    nodes: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame
    fanout: int

    @property
    def steps(self) -> int:
        """Levels that a block climbs."""
        return max(1, sum(self.fanout**i <= BLOCK for i in range(1, 7)))

    @property
    def width(self) -> int:
        return self.fanout**self.steps


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with pos (from 0, in the order of `order` within a key) and n, the rows of the key.

    One range sort, numbers within each partition, and starts from one small row a partition and key: no key is
    ever in one task. Rows alike in all of `order` are numbered in the order in which they are read.
    """
    table = written(rows, f"{name}-rows")
    by = ["key", *order, "_tie"]
    at = table.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).drop("_tie")
    at = written(at.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), f"{name}-sorted")
    forget(table)
    runs = at.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("key")
    starts = runs.select("key", "_part", "_first", F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.sum("_n").over(w).alias("n"))
    placed = at.join(starts, ["key", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.coalesce("_before", F.lit(0)))
    out = written(placed.drop("_at", "_part", "_first", "_before"), f"{name}-nodes")
    forget(at)
    return out


def height(n: Column, fanout: int) -> Column:
    """Levels above the leaves: how often fanout divides n, rounded up, until one node remains."""
    out, size = F.lit(0), 1
    while size < 2**62:
        out, size = out + F.when(n > size, 1).otherwise(0), size * fanout
    return out


def _climb(level: Column, up: Column, fanout: int) -> Column:
    """[level, the level above, ...], up levels above it."""
    span = fanout * WIDTH

    def parents(of: Column) -> Column:
        last = F.ceil(F.length(of) / span).cast("int") - 1
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda p: digest(of.substr(p * span + 1, F.lit(span)))), "")

    climbed = F.aggregate(F.sequence(F.lit(1), up), F.array(level), lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1)))))
    return F.when(up > 0, climbed).otherwise(F.array(level))


def build(rows: DataFrame, order: list[str], fanout: int = 2, name: str = "merkle") -> Forest:
    """The trees over rows (key, digest, ...): every fanout consecutive nodes become the digest of their digests.

    Blocks of BLOCK nodes climb several levels at once, so a key of n rows takes log n / log BLOCK rounds.
    """
    if not 2 <= fanout <= BLOCK:
        raise ValueError(f"fanout must be from 2 to {BLOCK}")
    nodes = numbered(rows, order, name)
    forest = Forest(nodes, [], nodes, fanout)
    tallest = nodes.agg(F.max(height(F.col("n"), fanout))).first()[0] or 0
    level = nodes.select("key", "pos", "digest", height(F.col("n"), fanout).alias("rest"))
    for i in range(max(1, -(-tallest // forest.steps))):
        block = level.groupBy("key", F.expr(f"pos div {forest.width}").alias("block")).agg(F.max("rest").alias("rest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]), "").alias("level"))
        up = F.least(F.lit(forest.steps), "rest")
        forest.rounds.append(written(block.select("key", "block", "rest", _climb(F.col("level"), up, fanout).alias("levels")), f"{name}-round"))
        level = forest.rounds[-1].select("key", F.col("block").alias("pos"), F.element_at("levels", -1).alias("digest"), F.greatest(F.lit(0), F.col("rest") - forest.steps).alias("rest"))
    return Forest(nodes, forest.rounds, level.select("key", "digest"), fanout)


def _own_path(at: Column, forest: Forest) -> Column:
    """(preimage, slot) of each ancestor of node `at` of a block, lowest first."""
    powers = F.array(*[F.lit(forest.fanout**i) for i in range(forest.steps + 1)])
    span = forest.fanout * WIDTH

    def step(i: Column) -> Column:
        parent = F.floor(at / F.get(powers, i + 1)).cast("int")
        return F.struct(F.get("levels", i).substr(parent * span + 1, F.lit(span)).alias("preimage"), (F.floor(at / F.get(powers, i)) % forest.fanout).cast("int").alias("slot"))

    empty = F.array().cast("array<struct<preimage:string,slot:int>>")
    return F.when(F.size("levels") > 1, F.transform(F.sequence(F.lit(0), F.size("levels") - 2), step)).otherwise(empty)


def with_paths(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """nodes with path: the preimage of each ancestor, lowest first, and the node's slot in it.

    Nodes join the preimages of their block, and blocks those of the blocks above. above: key and path, of what the
    roots lie under.
    """
    top = forest.rounds[-1].select("key", "block")
    path = top.withColumn("path", F.array().cast("array<struct<preimage:string,slot:int>>")) if above is None else top.join(above, "key")
    for blocks in reversed(forest.rounds[1:]):
        child = F.explode(F.sequence(F.lit(0), (F.length(F.get("levels", F.lit(0))) / WIDTH).cast("int") - 1))
        under = blocks.join(path, ["key", "block"]).withColumn("at", child)
        path = under.select("key", (F.col("block") * forest.width + F.col("at")).alias("block"), F.concat(_own_path(F.col("at"), forest), "path").alias("path"))
    lowest = forest.rounds[0].select("key", "block", "levels").join(path, ["key", "block"])
    nodes = forest.nodes.withColumn("block", F.expr(f"pos div {forest.width}"))
    at = F.pmod("pos", F.lit(forest.width)).cast("int")
    return nodes.join(lowest, ["key", "block"]).withColumn("path", F.concat(_own_path(at, forest), "path")).drop("block", "levels")


def _before(step: Column) -> Column:
    return step["preimage"].substr(F.lit(1), step["slot"] * WIDTH)


def _after(step: Column) -> Column:
    return step["preimage"].substr((step["slot"] + 1) * WIDTH + 1, F.length(step["preimage"]))


def siblings(path: str) -> Column:
    """The digests beside a node and its ancestors, level by level: each preimage without the node's own slot."""
    return F.array_join(F.transform(path, lambda s: F.concat(_before(s), _after(s))), "")


def fold(path: str, leaf: Column) -> Column:
    """The root that a leaf gives: it takes its slot in each preimage, whose digest takes the next one."""
    return F.aggregate(path, leaf, lambda d, s: digest(F.concat(_before(s), d, _after(s))))


def merkle_manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2, tampered: Mapping[str, Column] | None = None) -> DataFrame:
    """For each row: id, group, position, leaf, subroot, root, path, siblings, folded_root.

    A leaf is leaf_digest() of the fields. Leaves of a group ascend by id, then digest; every fanout consecutive nodes
    become the digest of their digests until one remains, the subroot; subroots, by group in the order of its UTF-8
    bytes, null first, likewise give the root. path holds the preimages of the ancestors, siblings the digests of
    the proof. tampered gives the values (columns of docs) of fields that were changed afterwards; folded_root is what
    the leaf of these gives with the original siblings, so a row is proven where it equals root.

    Defined cases: null fields are `-`, so they differ from empty ones; null ids come first in their group, null groups
    are one group; a group of one row has its leaf as subroot, and a single group its subroot as root; repeated ids
    are leaves of their own in the order of their digests, equal rows in any order, which changes no digest of the trees;
    an empty table gives no rows; other columns are ignored.
    """
    id_, group = F.col(f"`{id_col}`"), F.col(f"`{group_col}`").cast("string")
    leaf = leaf_digest([F.col(f"`{c}`") for c in fields])
    changed = leaf
    if tampered:
        old, new = [F.col(f"`{c}`") for c in fields], [tampered.get(c, F.col(f"`{c}`")) for c in fields]
        same = [o.eqNullSafe(n) for c, o, n in zip(fields, old, new) if c in tampered]
        unchanged = same[0]
        for s in same[1:]:
            unchanged = unchanged & s
        changed = F.when(~unchanged, leaf_digest(new))  # null: as it was
    rows = docs.select(F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("key"), id_.alias("id"), leaf.alias("digest"), changed.alias("changed"))
    groups = build(rows, ["id", "digest"], fanout, "merkle-leaf")
    subroots = written(groups.roots, "merkle-subroots")
    whole = build(subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), ["group"], fanout, "merkle-group")
    root = whole.roots.select("key", F.col("digest").alias("root"))  # one row
    ends = with_paths(whole).join(F.broadcast(root), "key").select(F.col("group").alias("key"), "path", F.col("digest").alias("subroot"), "root")
    ends = written(ends, "merkle-above")
    out = with_paths(groups, ends.select("key", "path")).join(ends.select("key", "subroot", "root"), "key")
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias("group"), F.col("pos").alias("position"), F.col("digest").alias("leaf"), "subroot", "root", "path",
        siblings("path").alias("siblings"), fold("path", F.coalesce("changed", "digest")).alias("folded_root"),
    )

"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import forget, written


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _directed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(moved.union(least.select("a", F.col("m").alias("b"))))


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that it reaches.

    Alternates large-star and small-star steps; each round is a written table. The number of rounds grows
    with the logarithm of the nodes. Self loops and repeated edges are allowed; nulls are dropped; an empty
    table gives no rows. No component is ever held in one task.
    """
    nodes = edges.where("a is not null and b is not null")
    now = written(_directed(nodes), f"{name}-0")
    state = _sum(now)
    for i in range(1, most_rounds):
        if not state[0]:
            break
        after = written(_small_star(_large_star(now)), f"{name}-{i}")
        seen = _sum(after)
        forget(now)
        now = after
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not converge")
    roots = now.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def component_ids(joined: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component_id) of components() over numbers that ascend with ids: the smallest node's id. nodes: rep, id."""
    return joined.join(nodes.select(F.col("rep").alias("component"), F.col("id").alias("component_id")), "component").select("node", "component_id")

"""Exact links inside candidate clusters, counted without making rows of pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import by_sorted_groups, out_batches, rows_in_groups

SCHEMA = "rep long, n_links long, root long"
_ARROW = pa.schema([("rep", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])


class Forest:
    """Union by smallest member over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def cluster_links(members: DataFrame, linked: Callable[[list, list], np.ndarray], block: int = 512) -> DataFrame:
    """For members (cluster, size, rep, weight, item): (rep, n_links, root) partial rows.

    A cluster of up to `block` members is compared in one call. A larger one is split by a hash of rep into
    ceil(size / block) parts, and each pair of parts is a group of its own, so no task holds more than a few
    parts whatever the cluster's size. linked(items, items) gives a boolean matrix. n_links adds the weights
    of linked members; it is summed over a rep's rows. root is the smallest rep that the rep reaches inside
    the group, so the (rep, root) rows keep every link's connection.
    """
    parts = F.ceil(F.col("size") / block).cast("int")
    part = F.pmod(F.xxhash64("rep"), parts).cast("int")
    placed = members.select("cluster", "rep", "weight", "item", part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    keyed = placed.select("cluster", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "rep", "weight", "item")

    def run(batches):
        def rows():
            for (_, p, q), group in rows_in_groups(batches, ["cluster", "p", "q"]):
                group.sort(key=lambda r: r["rep"])
                left = [i for i, r in enumerate(group) if r["part"] == p]
                right = left if p == q else [i for i, r in enumerate(group) if r["part"] == q]
                weight = np.array([r["weight"] for r in group], np.int64)
                count, forest = np.zeros(len(group), np.int64), Forest(len(group))
                for at in range(0, len(left), block):
                    rows_ = left[at : at + block]
                    for to in range(0, len(right), block):
                        cols = right[to : to + block]
                        m = linked([group[i]["item"] for i in rows_], [group[i]["item"] for i in cols])
                        if p == q:
                            m = m & (np.array(rows_)[:, None] != np.array(cols)[None, :])
                        count[rows_] += m @ weight[cols]
                        if p != q:
                            count[cols] += m.T @ weight[rows_]
                        # a row's first link and, for other rows, links that join something new
                        for i, j in zip(*np.nonzero(m)):
                            forest.join(rows_[i], cols[j])
                for i, r in enumerate(group):
                    root = forest.find(i)
                    if count[i] or root != i:
                        yield r["rep"], int(count[i]), group[root]["rep"]

        yield from out_batches(rows(), _ARROW)

    return by_sorted_groups(keyed, ["cluster", "p", "q"], [], run, SCHEMA)

"""Connected components of a link table, by alternating large and small stars.

Every round is two aggregations and two equi-joins; links never leave the
executors. The links of a node with very many neighbours aren't gathered in one
task: a bounded number of such hubs is sent to where their links lie. Each round
is cut to the shared folder, so its lineage stays short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, join_hot, release


class Forest:
    """Union-find over the rows of a buffer."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of one orderable type, in any direction, repeats allowed -> (id, component).

    ``component`` is the smallest id reachable. Ids without links to others don't appear;
    links with a null end or to themselves are ignored.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        held = join_hot(both, low, "u", 2 * mark[0]).where("v > u")
        star = cut(held.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        low = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = join_hot(star, low, "u", 2 * mark[0]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        release(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins over the edge list, so nothing is gathered on
the driver but a few sums per round that tell whether the edges still change.  A hub's edges
(any number) are not gathered in one task: heavy nodes are joined by broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_heavy, release, save

#: Distinct edges that one task takes (16 MB of ids): more go through rounds.
FEW = 1 << 20


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """large: every larger neighbour of u goes to u's least; small: every smaller one and u itself do."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    both = join_heavy(near, least, "u", "n", total)
    if large:
        moved = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _distinct(edges: DataFrame) -> DataFrame:
    return save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")


def least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of every end of the edges: roots go to the least root next to them until no edge parts two."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)  # places rise with the nodes
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def linked(edges: DataFrame) -> DataFrame:
    """components() of the edges, written once; FEW or fewer distinct ones are gone through by one task.

    A round over few edges is mostly its tasks, thousands where the session deals to many partitions."""
    now = _distinct(edges)
    release(now.sparkSession)
    if now.count() > FEW:
        return save(_rounds(now), "linked")

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            node, component = least(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])

    out = save(now.coalesce(1).mapInArrow(run, "node long, component long"), "linked")
    drop(now)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u, v) of longs, undirected, any order, repeats and loops allowed -> (node, component).

    component is the least node reachable.  Nodes are those with an edge to another node; a null
    end drops the edge.  The result is a written table."""
    return _rounds(_distinct(edges), most_rounds)


def _rounds(now: DataFrame, most_rounds: int = 60) -> DataFrame:
    mark = None
    for _ in range(most_rounds):
        release(now.sparkSession)  # shuffles of the round before, or of what made the edges
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if tuple(got) == mark or got[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = tuple(got)
        half = save(_star(now, True, 2 * got[0]), "edges")
        then = save(_star(half, False, got[0]), "edges")
        drop(now, half)
        now = then
    raise RuntimeError("components did not settle")

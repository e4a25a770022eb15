"""Connected components as joins: hook to the smallest neighbour, jump to the roots, contract, until no edge is left.

Every round works on stored tables, so a node with very many edges is split by the skew join. No label, edge or
component comes to the driver, only whether a table is empty. There is no limit on the rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node it is connected with."""
    current = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not current.isEmpty():
        both = current.select(F.col("b").alias("node"), F.col("a").alias("to")).union(current.select(F.col("a"), F.col("a")))
        parents = stored(both.groupBy("node").agg(F.min("to").alias("parent")))
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            jumped = stored(parents.join(above, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
            parents = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        if labels is None:
            labels = parents.withColumnRenamed("parent", "label")
        else:
            up = parents.select(F.col("node").alias("label"), "parent")
            labels = stored(labels.join(up, "label", "left").select("node", F.coalesce("parent", "label").alias("label")))
        current = stored(current.join(a, "a").join(b, "b").where("pa <> pb")
                         .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def spanning(neighbours, order: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, member) of the components of a graph on ``order``'s entries; roots come first in ``order``.

    ``neighbours(node, open)`` gives the mask of the still open nodes that are linked with ``node``; a node is
    compared with open nodes only, so tight groups cost little more than their size.
    """
    out, left = [], np.asarray(order)
    while len(left):
        root, left = left[0], left[1:]
        stack = [root]
        while stack and len(left):
            mask = neighbours(stack.pop(), left)
            if mask.any():
                reached = left[mask]
                left = left[~mask]
                out += [(root, x) for x in reached]
                stack += reached.tolist()
    return out

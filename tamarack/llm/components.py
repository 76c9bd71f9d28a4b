"""Connected components of a graph of links, by pointers to smaller neighbours.

Each node with smaller neighbours points to the least of them, its parent. In a round every edge
to a parent moves on to the parent's parent, and any other edge links the parents of its two ends
instead, so trees halve their depth and merge; when nothing moves, every node points to the least
one of its component. Rounds are joins and partial aggregations over edges, so no node's neighbours
are gathered. The parents are written down before they are joined, so that an adaptive plan can
split a hot node's edges in either join. Each round goes to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import discard, new_path, stored

ROUNDS = 60


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components: every node with the least one of its component, but for that one itself."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while (apart := label[x] != label[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while (label[label] != label).any():
            label = label[label]
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node that has a link to another: the smallest reachable node.

    Rows with null, and links of a node to itself, are passed over; no links give no rows."""
    spark = links.sparkSession
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path = new_path(spark, "edges")
    edges = stored(edges, "edges", path)
    for _ in range(ROUNDS):
        over, after = new_path(spark, "parents"), new_path(spark, "edges")
        parents = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "parents", over)
        own = parents.select(F.col("u").alias("_u"), F.col("m").alias("_own")).hint("merge")
        above = parents.select(F.col("u").alias("_v"), F.col("m").alias("_above")).hint("merge")
        both = edges.join(own, F.col("u") == F.col("_u")).join(above, F.col("v") == F.col("_v"), "left")
        to, far = F.col("v") == F.col("_own"), F.coalesce("_above", "v")
        moved = both.select(
            F.when(to, F.col("u")).otherwise(F.greatest("_own", far)).alias("u"),
            F.when(to, far).otherwise(F.least("_own", far)).alias("v"),
            (~to | F.col("_above").isNotNull()).alias("moved"),
        )
        left = stored(moved.where(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.max("moved").alias("moved")), "edges", after)
        going = left.agg(F.max("moved")).first()[0]
        discard(spark, path)
        discard(spark, over)
        edges, path = left.select("u", "v"), after
        if not going:
            break
    else:
        raise RuntimeError(f"no end of the components after {ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

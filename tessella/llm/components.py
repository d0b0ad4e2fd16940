"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written


def merged_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's root, the smallest index it is joined to) once the rows a and b are joined too."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        label = root[label]


def least_of(node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row the least node of those that have its label."""
    out = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(out, label, node)
    return out[label]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, component): component is the smallest node reachable.

    Nodes without an edge to another node are absent. Each round hooks every node to the neighbour
    (or itself) of least hash, salted by the round, and replaces the nodes of each edge by their hooks:
    connected nodes stay connected, and a random order shrinks even a long path by a constant factor,
    so rounds grow with the logarithm of the longest path. In the first round the order is that of the
    nodes themselves, which ends it for stars about their least node, as most edge tables here are. No neighbour list is ever gathered (a hub
    costs one partial minimum per task), and each round is written, so no lineage builds up.

    Null ends and loops are dropped, repeated edges count once, no edges give no rows.
    """
    edges = written(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct(),
        "edges",
    )
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(len(hooks))) if hooks else F.lit(0)).alias("h"), F.col(c).alias("n"))
        hook = written(
            seen.groupBy("u").agg(F.min(rank("v")).alias("best")).select(F.col("u").alias("node"), F.least(rank("u"), "best")["n"].alias("hook")),
            "hooks",
        )
        hooks.append(hook)
        left = hook.select(F.col("node").alias("u"), F.col("hook").alias("a"))
        right = hook.select(F.col("node").alias("v"), F.col("hook").alias("b"))
        edges = written(
            edges.join(left, "u").join(right, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
            "edges",
        )
    if not hooks:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    total = hooks[-1]
    for hook in reversed(hooks[:-1]):
        later = total.select(F.col("node").alias("hook"), F.col("hook").alias("root"))
        total = hook.join(later, "hook", "left").select("node", F.coalesce("root", "hook").alias("hook"))
    total = written(total, "roots")
    least = total.groupBy("hook").agg(F.min("node").alias("component"))
    return total.join(least, "hook").select("node", "component")

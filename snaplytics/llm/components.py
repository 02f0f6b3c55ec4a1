"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplytics.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node of ``edges`` (u, v longs).

    Each round joins every node's edges to the smallest neighbour, found by an aggregation
    that combines before its shuffle, and is checkpointed. Rounds end when nothing changes; their number grows
    with the logarithm of the longest path. Nothing but two sums per round reaches the driver.
    """
    now = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(moved.unionByName(least.withColumnRenamed("m", "v")).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(hashed, F.lit(2**40))), F.lit(0)), F.coalesce(F.bit_xor(hashed), F.lit(0))).first())


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge per node that connect what the edges (a, b) connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)  # the old label moves too, so that long paths are short work
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]

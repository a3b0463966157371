"""Connected components: a spanning forest inside a task, alternating stars between tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.session import freeze


def roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links between positions, the smallest node each one reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids, reduced to one link per node: from it to the smallest id it reaches."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(places[: len(a)], places[len(a) :], len(nodes))
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest id reached.

    Large-star and small-star steps alternate until every node links to its component's
    smallest node. A step takes minima, which combine before the shuffle, and joins them
    back; a node with very many links is a skewed join key, which Spark splits. Self links
    and nulls are ignored; no links give no rows.
    """
    now = freeze(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"))
        least = least.select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(least, "u")
            .where("v <> low")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .union(least.select("u", F.col("low").alias("v")))
        )
        after = freeze(small.distinct())
        new = _state(after)
        now, state, done = after, new, new == state
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

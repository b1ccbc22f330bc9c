"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import join_spread, written


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the links within one task: its nodes and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) between longs to (node, root): the smallest node that each linked node reaches, for nodes that
    are not that root themselves. Every round is written to the shared folder; a node's links are only ever reduced to
    their minimum and joined back to it over several tasks, so a node with very many links is never a group in one task."""

    def joined(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) with the least v of each u, and u itself, as m."""
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")), "star")
        return join_spread(pairs, least, "u", ["v"]).withColumn("m", F.least("u", "m"))

    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(joined(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        small = joined(large)
        ended = written(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "small-star")
        if edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == ended.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first():
            return ended.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = ended

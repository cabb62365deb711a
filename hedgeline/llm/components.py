"""Connected components of links, by alternating large-star and small-star steps.

Links stay DataFrames. A step joins the links with each node's smallest
neighbour, so a node with very many links is no group that one task must
hold, and Spark may split its rows. Each round is written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links a-b: from each node to the smallest of its component, at most one a node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Tie neighbours to the smallest one: a node's larger neighbours, or the node and its smaller ones."""
    if larger:
        links = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    tied = links.join(least, "a")
    if larger:
        tied = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return tied.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (its smallest node) of every node but the smallest of each component.

    links: a, b of any orderable type but null; order, repeats and loops don't matter.
    """
    flat = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark, step = scratch.keep(flat, "links0"), None, 0
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if row[0] == 0 or tuple(row) == mark:
            break
        mark, step = tuple(row), step + 1
        now = scratch.keep(_star(_star(now, True), False), f"links{step}")
        scratch.drop(f"links{step - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))

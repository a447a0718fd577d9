"""Connected components of a graph given as an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _lowered(edges: DataFrame, toward_all: bool) -> DataFrame:
    """One star step. edges: (u, v), u > v. toward_all: of each node, the larger neighbours (large star), else itself and the smaller ones."""
    if toward_all:
        edges = edges.union(edges.select("v", "u"))
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    met = edges.join(least, F.col("u") == F.col("w"))
    if toward_all:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge (a, b) of longs; root is the smallest node of its component.

    Alternates large-star and small-star steps until every edge leads to its root: a few rounds, each with joins and
    partially aggregated minima on all machines, its result in a checkpoint. Loops, repeats and nulls in the edges don't matter."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        if mark == (0, None):
            break
        now = cut(_lowered(_lowered(now, True), False))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError("the components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())

"""Health audits of a tree: growth thresholds, bloat of the index, references, duplication; findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut
from . import references
from .similarity import similar_classes
from .skew import lookup

#: Inclusive thresholds.
MOST_BRANCHES, WARN_LEAVES, MOST_LEAVES, INDEX_LEAVES, DUPLICATE = 9, 30, 50, 15, 0.85
INDEX = r"(?i)-0-|^0[-_]|index|indeks"


def root_branches(branches: DataFrame, most: int = MOST_BRANCHES) -> DataFrame:
    """(file, branches) of roots with too many branches. branches: file, branch_ord."""
    return branches.groupBy("file").agg(F.count("*").alias("branches")).where(F.col("branches") >= most)


def branch_leaves(leaves: DataFrame, warn: int = WARN_LEAVES, most: int = MOST_LEAVES) -> DataFrame:
    """(file, branch_ord, branch, leaves, level) of branches that have grown too large; a branch is an occurrence of its heading."""
    counted = leaves.groupBy("file", "branch_ord", "branch").agg(F.count("*").alias("leaves")).where(F.col("leaves") >= warn)
    return counted.withColumn("level", F.when(F.col("leaves") >= most, "error").otherwise("warn"))


def index_bloat(leaves: DataFrame, most: int = INDEX_LEAVES) -> DataFrame:
    """(file, leaves) of index roots that hold too many leaves."""
    return leaves.where(F.col("file").rlike(INDEX)).groupBy("file").agg(F.count("*").alias("leaves")).where(F.col("leaves") >= most)


def compared(leaves: DataFrame, *more: Column) -> DataFrame:
    """(leaf_id, tokens, and more) of the leaves that are compared for duplication; those that only refer elsewhere don't count."""
    own = leaves.where(~F.coalesce(F.col("text").rlike(r"(?i)\bbkz:"), F.lit(False)))
    return own.select("leaf_id", T.audit_tokens(F.col("text")).alias("tokens"), *more)


def duplicates(leaves: DataFrame, place: Column, least: float = DUPLICATE) -> DataFrame:
    """(similarity, one, two) of near-duplicate leaves (leaf_id, text and what place is made of), by their places: pairs of the first leaves of classes, and of each class's first leaf with every copy of it."""
    # places go with the sets, so that no pair is joined with them
    members, linked = similar_classes(compared(leaves, place.alias("place")), "leaf_id", "tokens", least, "place")
    first = members.where("class = leaf_id and copies > 1").select(F.col("class").alias("of"), "copies", F.col("label").alias("one"))
    copies = lookup(members.where("class <> leaf_id").select("class", F.col("label").alias("two")), "class", cut(first), "of", "copies")
    return linked.select("similarity", "one", "two").unionByName(copies.select(F.lit(1.0).alias("similarity"), "one", "two"))


def findings(leaves: DataFrame, branches: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(level, code, msg) of all audits. leaves: leaf_id, file, branch_ord, branch, line, text, those above the first branch left out.

    edges (source, target, status): of the committed graph; without one, references in texts are held against the roots' names."""
    said = F.format_string
    parts = [
        root_branches(branches).select(F.lit("warn").alias("level"), F.lit("root-branches").alias("code"), said("%s: %d branches", "file", "branches").alias("msg")),
        branch_leaves(leaves).select("level", F.lit("branch-leaves").alias("code"), said("%s › ## %s: %d leaves", "file", "branch", "leaves").alias("msg")),
        index_bloat(leaves).select(F.lit("warn").alias("level"), F.lit("index-bloat").alias("code"), said("%s: index holds %d leaves", "file", "leaves").alias("msg")),
    ]
    pairs = duplicates(leaves, said("%s › ## %s L%d", "file", "branch", "line"))
    parts.append(pairs.select(F.lit("warn").alias("level"), F.lit("duplication").alias("code"), said("near-duplicate (%d%%): %s ≈ %s", F.round(F.col("similarity") * 100).cast("int"), "one", "two").alias("msg")))
    if edges is None:
        lost = references.missing_roots(leaves, leaves.select("file").distinct())
        parts.append(lost.select(F.lit("error").alias("level"), F.lit("broken-ref").alias("code"), said("%s › ## %s (line %d): points to missing %s", "file", "branch", "line", "reference").alias("msg")))
    else:
        broken = references.broken(edges, leaves.select(F.col("leaf_id").alias("id")))
        parts.append(broken.select(F.lit("error").alias("level"), F.lit("broken-ref").alias("code"), said("%s: unresolved reference (%s)", "source", "status").alias("msg")))
        chains = references.chains(edges, leaves.select(F.col("leaf_id").alias("id")))
        parts.append(chains.select(F.lit("warn").alias("level"), F.lit("reference-chain").alias("code"), said("%s → %s → %s", "source", "middle", "target").alias("msg")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_level(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))

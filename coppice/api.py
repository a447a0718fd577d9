"""The engine's tools on one tree, as plain functions: search, append, audit, plans, erasure."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit
from .operators import search as S
from .plans import restructure
from .plans.store import Tree
from .sources import markdown, trees

#: Limits of what callers may ask for.
QUERY_CHARACTERS, LEAF_CHARACTERS, FILES, RESULTS = 4096, 1 << 16, 64, 1000


def search(spark: SparkSession, folder: str, query: str, mode: str = "auto", files: list[str] | None = None, max_results: int = 25, case_sensitive: bool = False, prefix: str = markdown.PREFIX) -> DataFrame:
    """Ranked leaves of a tree for one query; none for an empty one."""
    if len(query) > QUERY_CHARACTERS or len(files or []) > FILES or not 0 <= max_results <= RESULTS:
        raise ValueError("beyond the limits")
    own = spark.createDataFrame([(0, query, [os.path.basename(f) for f in files] if files else None)], "query_id int, query string, files array<string>")
    return S.search(trees.leaves(spark, folder, prefix), own, mode, max_results, case_sensitive=case_sensitive)


def lines(results: DataFrame) -> DataFrame:
    """Results as text, one line each."""
    return results.orderBy("query_id", "rank").select(F.format_string("%s › ## %s › %s", "file", "branch", "text").alias("line"))


def append(folder: str, file: str, branch: str, text: str, **more) -> dict:
    if len(text) > LEAF_CHARACTERS:
        raise ValueError("beyond the limits")
    return Tree(folder).append(file, branch, text, **more)


def findings(spark: SparkSession, folder: str, prefix: str = markdown.PREFIX) -> DataFrame:
    """Findings of all audits; with a log, references are judged by its graph."""
    nodes = markdown.parsed(trees.roots(spark, folder), prefix)
    branches = nodes.where("kind = 'branch'").select("file", "branch_ord")
    leaves = trees.leaves(spark, folder, prefix).where("branch_ord >= 0")
    tree = Tree(folder, prefix)
    if not tree.log.file.exists():
        return audit.findings(leaves, branches)
    edges = spark.createDataFrame([(e["sourceId"], e["targetId"], e["status"]) for e in tree.state().edges.values()], "source string, target string, status string")
    return audit.findings(leaves, branches, edges)


def compile_plan(folder: str) -> dict:
    return restructure.compile_plan(Tree(folder))


def apply_plan(folder: str, plan: dict) -> dict:
    return restructure.apply_plan(Tree(folder), plan)


def forget_leaf(folder: str, leaf: str, reason: str | None = None) -> dict:
    return restructure.forget(Tree(folder), leaf, reason)


def resume_forgetting(folder: str) -> dict:
    return restructure.resume_forgetting(Tree(folder))

"""Deterministic keyword clustering of overgrown branches."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ALGORITHM = "deterministic-keyword-jaccard-v1"
SCHEMA = "file string, branch string, algorithm string, leaf_count long, overall double, cluster string, keyword string, confidence double, evidence array<struct<keyword:string,count:long>>, leaf_ids array<string>"


@dataclass
class Leaf:
    id: str
    index: int
    tokens: frozenset[str]


def three(value: float) -> float:
    """Rounded to three places by the binary value, ties away from zero."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(value).quantize(Decimal("0.001"), ROUND_HALF_UP))


def _alike(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a and b else 0.0


def propose(leaves: list[Leaf], most: int = 4, target: int = 20) -> list[dict] | None:
    """Clusters of a branch's leaves; None if no two words split it.

    Seeds are the words in part of the leaves with the highest n (1 - n / N) whose leaves overlap little with those of
    the seeds before. A leaf with a seed's word joins it (of several, the first by name), any other the cluster whose
    members are on average most alike, as it then stands. Confidence is 0.6 of the share that has the word and 0.4 of
    the mean similarity within."""
    leaves = sorted(leaves, key=lambda x: (x.index, x.id))
    having: dict[str, list[str]] = {}
    for x in leaves:
        for t in sorted(x.tokens):
            having.setdefault(t, []).append(x.id)
    total = len(leaves)
    ranked = sorted((-(len(v) * (1 - len(v) / total)), -len(v), t) for t, v in having.items() if 2 <= len(v) < total) if total > 1 else []
    wanted, seeds = max(2, min(most, ceil(total / target))), []
    for _, _, t in ranked:
        own = frozenset(having[t])
        if all(_alike(own, frozenset(having[s])) < 0.5 for s in seeds):
            seeds.append(t)
        if len(seeds) == wanted:
            break
    if len(seeds) < 2:
        return None
    groups: dict[str, list[Leaf]] = {s: [] for s in seeds}
    later = []
    for x in leaves:
        held = sorted(s for s in seeds if s in x.tokens)
        (groups[held[0]] if held else later).append(x)
    for x in later:
        nearest = min(seeds, key=lambda s: (-(sum(_alike(x.tokens, m.tokens) for m in groups[s]) / len(groups[s]) if groups[s] else 0.0), len(groups[s]), s))
        groups[nearest].append(x)
    out = []
    for seed, own in sorted(groups.items()):
        if own:
            counts = Counter(t for x in own for t in x.tokens)
            pairs = [_alike(a.tokens, b.tokens) for i, a in enumerate(own) for b in own[i + 1 :]]
            share = sum(seed in x.tokens for x in own) / len(own)
            top = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
            out.append({"keyword": seed, "ids": [x.id for x in own], "evidence": top, "confidence": three(0.6 * share + 0.4 * (sum(pairs) / len(pairs) if pairs else 1.0))})
    return out if len(out) > 1 else None


def tokens_of(text: str) -> frozenset[str]:
    """The words of `functions.text.keyword_tokens`, on the driver."""
    plain = re.sub(r"(?a:\b\d{2}\.\d{2}\.\d{4}\b)", " ", text.lower())
    return frozenset(t for t in re.split(r"[^\w-]+|_", plain) if len(t) > 2 and t not in T.CLUSTER_STOP)


def split_branches(leaves: DataFrame, least: int = 2) -> DataFrame:
    """A row for each cluster of every branch with `least` leaves or more. leaves: leaf_id, file, branch, index, text.

    Choosing seeds and members is sequential, so a branch is one group. A branch that has outgrown its threshold has
    tens of leaves; SURVEY's bound on branches is what keeps a group small."""
    own = leaves.select("file", "branch", F.col("leaf_id").cast("string").alias("id"), F.col("index").cast("long").alias("index"), T.keyword_tokens(F.col("text")).alias("tokens"))
    large = own.groupBy("file", "branch").count().where(F.col("count") >= least).select("file", "branch")

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = propose([Leaf(r.id, int(r.index_), frozenset(r.tokens)) for r in rows.rename(columns={"index": "index_"}).itertuples()]) or []
        overall = three(sum(c["confidence"] * len(c["ids"]) for c in found) / len(rows)) if found else None
        return pd.DataFrame(
            [[*key, ALGORITHM, len(rows), overall, f"{key[1]} / {c['keyword'][:1].upper()}{c['keyword'][1:]}", c["keyword"], c["confidence"], [{"keyword": k, "count": n} for k, n in c["evidence"]], c["ids"]] for c in found],
            columns=["file", "branch", "algorithm", "leaf_count", "overall", "cluster", "keyword", "confidence", "evidence", "leaf_ids"],
        )

    return own.join(large, ["file", "branch"], "left_semi").groupBy("file", "branch").applyInPandas(work, SCHEMA)


def seed_scores(leaves: DataFrame) -> DataFrame:
    """(file, branch, token, leaves, score) of words in two or more, but not all, leaves of a branch."""
    sizes = leaves.groupBy("file", "branch").agg(F.count("*").alias("total"))
    held = leaves.select("file", "branch", F.explode(T.keyword_tokens(F.col("text"))).alias("token")).groupBy("file", "branch", "token").agg(F.count("*").alias("leaves"))
    met = held.join(sizes, ["file", "branch"]).where("leaves >= 2 and leaves < total")
    return met.select("file", "branch", "token", "leaves", (F.col("leaves") * (1 - F.col("leaves") / F.col("total"))).alias("score"))


def evidence(members: DataFrame, top: int = 3) -> DataFrame:
    """(cluster, rank, token, leaves): the most frequent words of each cluster. members: cluster, text."""
    counted = members.select("cluster", F.explode(T.keyword_tokens(F.col("text"))).alias("token")).groupBy("cluster", "token").agg(F.count("*").alias("leaves"))
    order = Window.partitionBy("cluster").orderBy(F.desc("leaves"), "token")  # every task keeps its top few only
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster", "rank", "token", "leaves")

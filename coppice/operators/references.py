"""The graph of references between leaves: extraction, resolution, broken edges, chains, moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut
from .skew import flagged, lookup

#: Sources, and targets, of a middle whose chains one task writes.
CELL = 1 << 10


def extract(leaves: DataFrame) -> DataFrame:
    """(leaf_id, place, human, number, branch) of every reference in the leaves' texts."""
    return leaves.select("leaf_id", F.explode(T.references(F.col("text"))).alias("x")).select("leaf_id", "x.*")


def resolve(leaves: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(id, source, target, status, human) of the edges that the leaves' references make.

    A reference is resolved if exactly one leaf is in the branch that it names. explicit (leaf_id, ord, place, target):
    targets given by metadata, for the reference at that place or, with a null place, the next one that has none;
    those left over are edges too."""
    homes = leaves.select("leaf_id", T.root_number(F.col("file")).alias("number"), T.branch_key(F.col("branch")).alias("key"))
    counted = homes.groupBy("number", "key").agg(F.min("leaf_id").alias("only"), F.count("*").alias("n"))
    asked = extract(leaves).withColumn("key", T.branch_key(F.col("branch")))
    if explicit is None:
        named = asked.withColumn("named", F.lit(None).cast(leaves.schema["leaf_id"].dataType)).withColumn("left", F.lit(False))
    else:
        placed = explicit.where("place is not null").groupBy("leaf_id", "place").agg(F.min(F.struct("ord", "target")).alias("x")).select("leaf_id", "place", F.col("x.target").alias("t1"), F.col("x.ord").alias("o1"))
        asked = asked.join(placed, ["leaf_id", "place"], "left")
        free = asked.where("t1 is null").select("leaf_id", "place").withColumn("turn", F.expr("row_number() over (partition by leaf_id order by place)"))
        loose = explicit.where("place is null").withColumn("turn", F.expr("row_number() over (partition by leaf_id order by ord)")).select("leaf_id", "turn", F.col("target").alias("t2"), F.col("ord").alias("o2"))
        matched = free.join(loose, ["leaf_id", "turn"]).select("leaf_id", "place", "t2", "o2")
        asked = asked.join(matched, ["leaf_id", "place"], "left").withColumn("named", F.coalesce("t1", "t2")).withColumn("ord", F.coalesce("o1", "o2"))
        used = asked.where("ord is not null").select("leaf_id", "ord")
        rest = explicit.join(used, ["leaf_id", "ord"], "left_anti").join(extract(leaves).select("leaf_id", "place", "human"), ["leaf_id", "place"], "left")
        rest = rest.select("leaf_id", F.coalesce("human", F.lit("bkz:")).alias("human"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("key"), F.col("target").alias("named"), F.lit(True).alias("left"))
        named = asked.select("leaf_id", "human", "number", "key", "named", F.lit(False).alias("left")).unionByName(rest)
    # places and targets that many references name are looked up by broadcast
    place = F.struct("number", "key")
    named = cut(named.withColumn("at", place))
    wanted = named.groupBy(F.col("at").alias("of")).agg(F.count("*").alias("asked"))
    homes_at = wanted.join(counted.select(place.alias("home"), "only", "n"), F.col("of") == F.col("home")).select("of", "asked", "only", "n")
    met = lookup(named, "at", homes_at, "of", "asked").drop("of", "asked", "at")
    met = cut(met.withColumn("target", F.coalesce("named", F.when(F.col("n") == 1, F.col("only")))))
    there = homes.select("leaf_id", F.col("number").alias("tn"), F.col("key").alias("tk"))
    there = met.groupBy(F.col("target").alias("of")).agg(F.count("*").alias("asked")).join(there, F.col("of") == F.col("leaf_id")).select("of", "asked", "tn", "tk")
    met = lookup(met, "target", there, "of", "asked").drop("of", "asked")
    status = (
        F.when(F.col("target").isNull(), "legacy-unresolved").when(F.col("tk").isNull(), "unresolved").when(~F.col("left") & (F.col("tn") == F.col("number")) & (F.col("tk") == F.col("key")), "resolved").otherwise("resolved-path-mismatch")
    )
    out = met.select(F.col("leaf_id").alias("source"), "target", status.alias("status"), "human")
    return out.withColumn("id", T.edge_id(F.col("source"), F.col("target"), F.col("status"), F.col("human"))).dropDuplicates(["id"])


def _ended(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Edges with has_source and has_target; an end that many edges name is looked up by broadcast."""
    return flagged(flagged(edges, "source", live, "id", "has_source"), "target", live, "id", "has_target")


def valid(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Edges (source, target, status) that are resolved and whose ends are live (id)."""
    return _ended(edges.where("status = 'resolved'"), live).where("has_source and has_target").drop("has_source", "has_target")


def broken(edges: DataFrame, live: DataFrame) -> DataFrame:
    """All other edges, with which end is missing."""
    return _ended(edges, live).where("not (status = 'resolved' and has_source and has_target)")


def middles(edges: DataFrame, live: DataFrame) -> DataFrame:
    """(middle, sources, targets, chains): the chains of two valid edges by their middle, as many as its sources times its targets; none is written out."""
    return middles_of(valid(edges, live).select("source", "target").distinct())


def chains(edges: DataFrame, live: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct (source, middle, target) of two valid edges one after the other; cycles and loops are kept.

    A middle's sources and targets are dealt to cells of CELL by CELL, so a hub's chains are written by many tasks. With
    `most`, middles of more chains than that are left to `middles`, which says the same without writing them out."""
    own = cut(valid(edges, live).select("source", "target").distinct())
    known = middles_of(own)
    if most is not None:
        known = known.where(F.col("chains") <= most)
    known = cut(known)
    cells = lambda c: F.greatest(F.ceil(F.col(c) / CELL), F.lit(1)).cast("int")
    label = known.select(F.col("middle").alias("of"), cells("sources").alias("rows"), cells("targets").alias("columns"), (F.col("sources") + F.col("targets")).alias("n"))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    into = lookup(own.select("source", F.col("target").alias("middle")), "middle", label, "of", "n").where("of is not null")
    into = into.select("source", "middle", slot("source", "rows").alias("x"), every("columns").alias("y"))
    out = lookup(own.select(F.col("source").alias("middle"), "target"), "middle", label, "of", "n").where("of is not null")
    out = out.select("middle", "target", slot("target", "columns").alias("y"), every("rows").alias("x"))
    return into.join(out, ["middle", "x", "y"]).select("source", "middle", "target")


def middles_of(own: DataFrame) -> DataFrame:
    """`middles` of distinct valid edges (source, target)."""
    into = own.groupBy(F.col("target").alias("middle")).agg(F.count("*").alias("sources"))
    out = own.groupBy(F.col("source").alias("middle")).agg(F.count("*").alias("targets"))
    return into.join(out, "middle").withColumn("chains", F.col("sources") * F.col("targets"))


def missing_roots(leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """References by root name in reference leaves that no root's file name (file) begins with: stems are joined with all beginnings of the names."""
    found = F.regexp_extract_all("text", F.lit(r"(?iu)(?:root|kök|kok)-\d+[\p{L}\p{N}-]*(?:\.md)?"), F.lit(0))
    asked = leaves.where(F.col("text").rlike(r"(?i)\bbkz:")).select("file", "branch", "line", F.explode(found).alias("reference"))
    asked = cut(asked.withColumn("stem", F.lower(F.regexp_replace("reference", r"(?i)\.md$", ""))))  # texts are gone over once
    name = F.lower("file")
    begins = roots.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(name, F.lit(1), n))).alias("begins"))
    return flagged(asked, "stem", begins, "begins", "there").where("not there").select("file", "branch", "line", "reference")


def moved(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, source, target, file, branch, human): edges whose target has moved from before to after (leaf_id, file, branch), with its new place."""
    old = before.select(F.col("leaf_id").alias("target"), F.col("file").alias("f0"), F.col("branch").alias("b0"))
    new = after.select(F.col("leaf_id").alias("target"), "file", "branch")
    gone = new.join(old, "target").where("not (file <=> f0 and branch <=> b0)").drop("f0", "b0")
    return edges.join(gone, "target").select(F.col("id").alias("edge"), "source", "target", "file", "branch", "human")

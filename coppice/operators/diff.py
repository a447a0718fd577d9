"""Differences between states: views against a state, three-way reconciliation, edges, files, moves, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .needles import containing
from .scan import numbered

#: Fields in which two versions of a leaf are compared.
FIELDS = ("contentHash", "file", "branch", "index", "kind")


def _differs(a: str, b: str, fields: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | ~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def upserts(current: DataFrame, state: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows of current that are new in state or differ from it in a field."""
    return current.alias("c").join(state.alias("s"), F.col(f"c.{key}") == F.col(f"s.{key}"), "left").where(F.col(f"s.{key}").isNull() | _differs("c", "s", fields)).select("c.*")


def deletes(current: DataFrame, state: DataFrame, key: str = "id") -> DataFrame:
    """(key) of state that current no longer has."""
    return state.select(key).join(current.select(key), key, "left_anti")


def reconcile(base: DataFrame, current: DataFrame, changes: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Three-way: (key, change, conflict) of everything that was edited since the base.

    base: the leaves at their checkpoints, with `checkpoint` (its place in the log); changes: key and `changed`, the
    place of the log's last change. An edit of what the log has changed since the checkpoint is a conflict."""
    met = base.alias("b").join(current.alias("c"), F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer")
    change = F.when(F.col(f"b.{key}").isNull(), "added").when(F.col(f"c.{key}").isNull(), "deleted").when(_differs("b", "c", fields), "changed")
    edited = met.select(F.coalesce(f"b.{key}", f"c.{key}").alias(key), change.alias("change"), F.col("b.checkpoint").alias("checkpoint")).where("change is not null")
    later = edited.join(changes.select(key, "changed"), key, "left")
    return later.select(key, "change", F.coalesce(F.col("changed") > F.col("checkpoint"), F.lit(False)).alias("conflict"))


def edges(new: DataFrame, state: DataFrame, managed: DataFrame) -> DataFrame:
    """(id, op): edges to write and, of managed sources (source), edges to delete. Ids are hashes of all fields, so an id that is there is the same edge."""
    add = new.join(state.select("id"), "id", "left_anti").select("id", F.lit("upsert").alias("op"))
    gone = state.join(managed, "source", "left_semi").join(new.select("id"), "id", "left_anti").select("id", F.lit("delete").alias("op"))
    return add.unionByName(gone)


def dirty(files: DataFrame, checkpoints: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(file) of checkpoints (file, hash) whose file (file, hash) is gone or has another hash, unless that one is expected."""
    met = checkpoints.select("file", F.col("hash").alias("h0")).join(files.select("file", F.col("hash").alias("h1")), "file", "left").where("not (h0 <=> h1)")
    if expected is not None:
        met = met.join(expected.select("file", F.col("hash").alias("h1")), ["file", "h1"], "left_anti")
    return met.select("file")


def selectors(leaves: DataFrame, asked: DataFrame) -> DataFrame:
    """(selector, hits, leaf_id): how many leaves each selector means, by id or by a part of the text, and which if it is one."""
    asked = asked.select("selector").distinct()
    by_id = asked.join(leaves.select(F.col("leaf_id").cast("string").alias("selector"), "leaf_id"), "selector")
    by_text = containing(leaves, "leaf_id", "text", asked).withColumnRenamed("needle", "selector")
    counted = by_id.unionByName(by_text).distinct().groupBy("selector").agg(F.count("*").alias("hits"), F.min("leaf_id").alias("leaf_id"))
    met = asked.join(counted, "selector", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return met.select("selector", "hits", F.when(F.col("hits") == 1, F.col("leaf_id")).alias("leaf_id"))


def newest(rows: DataFrame, group: str, order: str, keep: int, name: str) -> DataFrame:
    """The `keep` newest rows of each group, by order and then name, both descending."""
    w = Window.partitionBy(group).orderBy(F.desc(order), F.desc(name))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def manifest(parts: DataFrame, file: str = "file", at: str = "at", content: str = "content", run: int = 1024) -> DataFrame:
    """(file, hash) of files given in parts, ordered by `at`, a whole number.

    A part's hash is its content's SHA-256; those of `run` neighbouring places are joined and hashed, and so are these
    in turn, so no task holds more than a file's hashes over `run`."""
    own = parts.select(F.col(file).alias("file"), F.floor(F.col(at) / run).alias("r"), F.struct(F.col(at).alias("at"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("h")).alias("x"))
    joined = lambda: F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"])), 256)
    runs = own.groupBy("file", "r").agg(joined().alias("h")).select("file", F.struct(F.col("r").alias("at"), "h").alias("x"))
    return runs.groupBy("file").agg(joined().alias("hash"))


def forward(points: DataFrame, marks: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """As-of join to the next: every mark's row with the first point of its group at or after it (next_value, next_at).

    Points and marks are gone through together from the last to the first, by ranges: a group of any size is many tasks' work."""
    both = points.select(group, at, F.lit(1).alias("_side"), F.struct(F.col(value).alias("v"), F.col(at).alias("t")).alias("_p"), F.lit(None).cast(marks.schema[value].dataType).alias("mark"))
    both = both.unionByName(marks.select(group, at, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_p"].dataType).alias("_p"), F.col(value).alias("mark")))
    order = [F.desc(at), F.desc("_side"), F.desc(F.col("_p.v")), F.desc("mark")]
    near = numbered(both, [group], order, "_place", filled={"_n": "_p"})
    return near.where("_side = 0").select(group, at, "mark", F.col("_n.v").alias("next_value"), F.col("_n.t").alias("next_at"))

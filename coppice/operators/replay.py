"""Replay of an append-only log of operations into current state: committed transactions, last writers, tombstones, folds.

Operations are rows (tx, seq, type, id, ...); `seq` orders the log. Checks of a log's order are prefix scans over ranges
of it. The state of leaves is a fold whose summaries merge in any order and grouping, so it is an aggregate that
combines before its shuffle: no id is a task of its own, however often it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import numbered
from .skew import fresh, lookup


def _placed(log: DataFrame, stream: str, line: str, seq: str, start: int) -> tuple[DataFrame, Column]:
    """The log with its rows' places, and whether seq isn't the place."""
    place = fresh("place", log.columns)
    return numbered(log, [stream], [line], place), ~F.col(seq).eqNullSafe(F.col(place) + (start - 1))


def first_bad(log: DataFrame, stream: str, line: str, seq: str, start: int = 1) -> DataFrame:
    """(stream, bad): per stream the first line (by order) at which seq isn't its place, or null."""
    placed, bad = _placed(log.select(stream, line, seq), stream, line, seq, start)
    return placed.groupBy(stream).agg(F.min(F.when(bad, F.col(line))).alias("bad"))


def valid_prefix(log: DataFrame, stream: str, line: str, seq: str, start: int = 1) -> DataFrame:
    """Rows before their stream's first gap in seq."""
    placed, bad = _placed(log, stream, line, seq, start)
    return before_bad(placed, stream, line, bad).select(log.columns)


def before_bad(log: DataFrame, stream: str, line: str, bad: Column) -> DataFrame:
    """Rows of streams (not null) before the first line at which bad holds. Streams with such a line are a table of a row each; a long one is looked up by broadcast."""
    until, of, n = (fresh(x, log.columns) for x in ("until", "of", "n"))
    label = log.groupBy(F.col(stream).alias(of)).agg(F.min(F.when(bad, F.col(line))).alias(until), F.count("*").alias(n)).where(F.col(until).isNotNull())
    return lookup(log, stream, label, of, n).where(F.col(until).isNull() | (F.col(line) < F.col(until))).drop(until, of, n)


def unchained(log: DataFrame, stream: str, line: str, hash: str, before: str) -> DataFrame:
    """(stream, line, found, wanted): records that don't name the hash of the record before them, as the first of a stream names none."""
    own = log.select(F.col(stream).alias("stream"), F.col(line).alias("line"), F.col(hash).alias("hash"), F.col(before).alias("found"))
    checked = numbered(own, ["stream"], ["line"], "place", {"wanted": "hash"})
    return checked.where(~F.col("found").eqNullSafe(F.col("wanted"))).select(F.col("stream").alias(stream), F.col("line").alias(line), "found", "wanted")


def committed(operations: DataFrame, commits: DataFrame) -> DataFrame:
    """Operations of transactions whose commit names exactly the hashes they have, in order; commit_seq is the commit's place.

    operations: tx, seq, hash, ...; commits: tx, seq, hashes. A commit whose list differs is passed over."""
    own = operations.groupBy("tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "hash"))), lambda x: x["hash"]).alias("own"))
    good = commits.join(own, "tx").where("hashes = own").groupBy("tx").agg(F.min("seq").alias("commit_seq"))
    return operations.join(good, "tx")


def summaries(operations: DataFrame, order: tuple[str, ...] = ("seq",), fields: tuple[str, ...] = ()) -> DataFrame:
    """(id, forgot, gone, ending, told, fields): for each id what its state follows from, whatever operations have been seen.

    operations: id, type (upsert, provenance, delete, forget), value, provenance (map of strings; a key that is present
    with null sets null), seq, and the order's columns. Every part keeps the row of greatest order of its kind:
    gone the last delete or forget, ending the last upsert, delete or forget, told the last provenance, and for each
    field the last provenance that sets it. So summaries of any parts of the log merge into that of the whole (`merge`), in any
    order. It is enough: an id that was ever forgotten has no leaf; else the last ending decides, and a field counts
    where it was set after that."""
    key = F.struct(*order)
    kept = F.struct("type", "value", "seq", key.alias("key"))
    of = lambda *kinds: F.when(F.col("type").isin(*kinds), key)
    return operations.groupBy("id").agg(
        F.coalesce(F.max(F.col("type") == "forget"), F.lit(False)).alias("forgot"),
        F.max_by(kept, of("delete", "forget")).alias("gone"), F.max_by(kept, of("upsert", "delete", "forget")).alias("ending"),
        F.max_by(F.struct("seq", key.alias("key")), of("provenance")).alias("told"),
        *[F.max_by(F.struct(F.col("provenance")[f].alias("value"), key.alias("key")), F.when((F.col("type") == "provenance") & F.map_contains_key("provenance", F.lit(f)), key)).alias(f) for f in fields],
    )


def merge(parts: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """The summaries of the whole from summaries of parts of it, in which an id may have several rows."""
    return parts.groupBy("id").agg(F.max("forgot").alias("forgot"), *[F.max_by(c, F.col(c)["key"]).alias(c) for c in ("gone", "ending", "told", *fields)])


def states(summed: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """(id, live, value, seq, fields) of every id with an operation that took effect; seq is that of the last such."""
    live = ~F.col("forgot") & F.coalesce(F.col("ending.type") == "upsert", F.lit(False))
    since = lambda c: F.coalesce(F.col(c)["key"] > F.col("ending.key"), F.lit(False))
    seq = F.when(F.col("forgot"), F.col("gone.seq")).when(live & since("told"), F.col("told.seq")).otherwise(F.col("ending.seq"))
    return summed.where("ending is not null").select("id", live.alias("live"), F.when(live, F.col("ending.value")).alias("value"), seq.alias("seq"), *[F.when(live & since(f), F.col(f)["value"]).alias(f) for f in fields])


def leaf_state(operations: DataFrame, order: tuple[str, ...] = ("seq",), fields: tuple[str, ...] = ()) -> DataFrame:
    """Live leaves: id, the columns of the last upsert (value), seq of the last change, and the provenance fields set since.

    Upserts after a forget are ignored, as is provenance where there is no leaf; an upsert replaces the whole leaf."""
    return states(summaries(operations, order, fields), fields).where("live").drop("live")


def last_writer(operations: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(id, value, seq) by the last upsert or delete of each id, where it is an upsert; for edges and checkpoints."""
    key = F.struct(*order)
    last = operations.where(F.col("type").isin("upsert", "delete")).groupBy("id").agg(F.max_by(F.struct("type", "value", "seq"), key).alias("x"))
    return last.where("x.type = 'upsert'").select("id", "x.value", "x.seq")


def tombstones(operations: DataFrame) -> DataFrame:
    """(id, seq): ids forgotten for good, and since when."""
    return operations.where("type = 'forget'").groupBy("id").agg(F.min("seq").alias("seq"))


def last_changes(operations: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(id, seq): each leaf's last change that took effect; ignored upserts and provenance without a leaf don't count."""
    own = operations.select("id", "type", F.lit(None).cast("string").alias("value"), "seq", *(c for c in order if c != "seq"))
    return states(summaries(own, order)).select("id", "seq")

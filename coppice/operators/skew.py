"""Joins that no single value can overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a label table that are broadcast whole at most, and the most frequent values of a larger one that are.
FEW_LABELS, HOT = 1 << 14, 1 << 12


def fresh(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as it takes to be none of those taken, upper or lower case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def lookup(rows: DataFrame, key: str, label: DataFrame, of: str, n: str) -> DataFrame:
    """rows with the columns of label (one row for each value of `of`; n: how many rows have that value), null where there is none.

    A label of up to FEW_LABELS rows is broadcast. Of a larger one those values are that a HOT-th of all labelled rows or
    more have, HOT of them at most, and the others are joined by a shuffle, in which no value has more rows."""
    count, total = label.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    if count <= FEW_LABELS:
        return rows.join(F.broadcast(label), F.col(key) == F.col(of), "left")
    hot, rest = label.where(F.col(n) * HOT >= total), label.where(F.col(n) * HOT < total)
    name = fresh("hot", rows.columns)
    spread = rows.join(F.broadcast(hot.select(F.col(of).alias(name))), F.col(key) == F.col(name), "left_anti")
    return rows.join(F.broadcast(hot), F.col(key) == F.col(of)).unionByName(spread.join(rest, F.col(key) == F.col(of), "left"))


def flagged(rows: DataFrame, key: str, ids: DataFrame, of: str, flag: str) -> DataFrame:
    """rows with a boolean column: whether the key is among ids (their column `of`; repeats don't matter, null is in none).

    The keys that a HOT-th of all rows or more have, HOT of them at most, are looked up by broadcast; only the others' rows are shuffled."""
    own, mark = fresh("own", rows.columns), F.lit(True).alias(flag)
    counted = rows.groupBy(F.col(key).alias(own)).agg(F.count("*").alias("n"))
    total = rows.count()
    distinct = ids.select(F.col(of).alias(own)).distinct()
    often = counted.where(F.col("n") * HOT >= total).select(own)
    hot = often.join(distinct.select(own, mark), own, "left").select(own, F.coalesce(flag, F.lit(False)).alias(flag))
    some = rows.join(F.broadcast(hot), F.col(key) == F.col(own)).drop(own)
    rest = rows.join(F.broadcast(often), F.col(key) == F.col(own), "left_anti")
    met = rest.join(distinct.select(own, mark), F.col(key) == F.col(own), "left").drop(own).withColumn(flag, F.coalesce(flag, F.lit(False)))
    return some.unionByName(met)

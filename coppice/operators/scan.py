"""Places and previous rows in ordered groups by a two-level prefix scan, so that a group of any length is many tasks' work.

Rows are dealt by ranges of (group, order) and sorted in their range. Every range numbers its own rows and sums itself up
in one row: how many rows it has, how many of them belong to the group it begins with, and its last row. These few rows,
one for each range, are folded in order on the driver; what a range gets from the ranges before it concerns only the
rows of the group it begins with, and is broadcast back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..sources.shared import cut
from .skew import fresh


def _differs(column: pa.Array) -> np.ndarray:
    """For each value but the first, whether it isn't the one before it; null is a value."""
    a, b = column[1:], column[:-1]
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _filled(first: pa.Array, column: pa.Array, new: np.ndarray) -> pa.Array:
    """Of each row of column the last value in its group that isn't null; first has the value that goes on from before, if any."""
    skip = len(first)
    both = pa.concat_arrays([first, column]) if skip else column
    at = np.arange(len(both))
    there = np.where(both.is_valid().to_numpy(zero_copy_only=False), at, -1)
    begin = np.maximum.accumulate(np.where(np.concatenate((np.ones(skip, bool), new)), at, 0))
    last = np.maximum.accumulate(there)
    return both.take(pa.array(last[skip:], pa.int64(), mask=(last < begin)[skip:]))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], place: str = "place", previous: dict[str, str] | None = None, filled: dict[str, str] | None = None) -> DataFrame:
    """df with each row's place in its group, from 1 by the order, and what other columns have in the row before it, or had last.

    previous: from new names to columns; their values are those of the row before, null in a group's first row. filled:
    likewise; their values are the last ones up to the row that aren't null. The order's columns may be descending. Nulls
    of the group's columns are a group; rows of equal order are numbered in any order. The rows are written to a
    checkpoint once, so they should have only the columns that are needed."""
    previous, filled = previous or {}, filled or {}
    taken = [*df.columns, place, *previous, *filled]
    part, n, head = (fresh(x, taken) for x in ("part", "n", "head"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = StructType([*df.schema.fields, *(StructField(new, kinds[old]) for new, old in (*previous.items(), *filled.items())), StructField(part, LongType()), StructField(n, LongType()), StructField(head, BooleanType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, count, in_head = TaskContext.get().partitionId(), None, 0, True
        kept: dict[str, pa.Array] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            skip = rows.num_rows - batch.num_rows  # the last row of the batch before stands first
            keys = [rows.column(g).chunk(0) for g in group]
            new = np.concatenate(([last is None], np.any([_differs(k) for k in keys], axis=0) if rows.num_rows > 1 else np.zeros(0, bool)))
            at = np.arange(rows.num_rows)
            begins = np.where(new, at, -(1 << 62))
            if skip:
                begins[0] = 1 - count  # as if the whole group stood here
            own = (at - np.maximum.accumulate(begins) + 1)[skip:]
            heads = np.cumsum(np.where(at == 0, False, new))[skip:] == 0
            heads &= in_head
            before = pa.array(np.arange(skip, rows.num_rows) - 1, pa.int64(), mask=new[skip:])
            columns = [*batch.columns, *(rows.column(old).chunk(0).take(before) for old in previous.values())]
            for old in filled.values():
                kept[old] = _filled(kept.get(old, batch.column(old).slice(0, 0)), batch.column(old), new[skip:])
                columns.append(kept[old])
                kept[old] = kept[old].slice(batch.num_rows - 1)
            columns += [pa.array(np.full(batch.num_rows, number)), pa.array(own.astype(np.int64)), pa.array(heads)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])
            last, count, in_head = batch.slice(batch.num_rows - 1), int(own[-1]), bool(heads[-1])

    by = [*group, *order]
    local = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(step, schema))
    names = [*previous.values(), *filled]  # of the last row: what the next one has before it, and what is filled in so far
    kept = F.struct(*(F.col(c).alias(f"g{i}") for i, c in enumerate(group)), *(F.col(c).alias(f"v{i}") for i, c in enumerate(names)), F.col(n).alias("n"))
    at = fresh("at", taken)
    ends = local.withColumn(at, F.monotonically_increasing_id())
    sums = ends.groupBy(part).agg(F.count("*").alias("rows"), F.sum(F.col(head).cast("long")).alias("heads"), F.min_by(kept, at).alias("first"), F.max_by(kept, at).alias("last")).orderBy(part).collect()
    carries, carry = [], None
    for r in sums:
        key = lambda x: tuple(x[f"g{i}"] for i in range(len(group)))
        given = carry if carry is not None and carry[0] == key(r["first"]) else None
        if given:
            carries.append((r[part], given[1], *given[2]))
        whole = given and r["heads"] == r["rows"]  # the group goes through the whole range
        values = [r["last"][f"v{i}"] for i in range(len(names))]
        if whole:
            values = [given[2][i] if i >= len(previous) and v is None else v for i, v in enumerate(values)]
        carry = (key(r["last"]), r["last"]["n"] + (given[1] if whole else 0), values)
    of, more, *given_as = [fresh(x, [*taken, part, n, head]) for x in ("of", "more", *(f"was{i}" for i in range(len(names))))]
    kind = StructType([StructField(of, LongType()), StructField(more, LongType()), *(StructField(g, local.schema[c].dataType) for g, c in zip(given_as, names))])
    met = local.join(F.broadcast(df.sparkSession.createDataFrame(carries, kind)), F.col(part) == F.col(of), "left")
    first = F.col(head) & (F.col(n) == 1)
    return met.select(
        *(F.col(c) for c in df.columns),
        (F.col(n) + F.when(F.col(head), F.coalesce(more, F.lit(0))).otherwise(0)).alias(place),
        *(F.when(first, F.col(g)).otherwise(F.col(new)).alias(new) for g, new in zip(given_as, previous)),
        *(F.coalesce(F.col(new), F.when(F.col(head), F.col(g))).alias(new) for g, new in zip(given_as[len(previous) :], filled)),
    )

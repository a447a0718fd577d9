"""Which texts contain which of many needles: one pass over the texts by an automaton of a block of needles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Needles, and bytes of them, that are looked for together; more are taken in further blocks over all texts.
NEEDLES, NEEDLE_BYTES = 1 << 15, 8 << 20


def automaton(needles):
    """Of (value, needle) pairs; a match gives the tuple of the values of its needle. None without needles."""
    from ahocorasick import Automaton

    own, held = Automaton(), {}
    for value, needle in needles:
        if needle:
            held.setdefault(needle, []).append(value)
    for needle, values in held.items():
        own.add_word(needle, tuple(values))
    if held:
        own.make_automaton()
    return own if held else None


def met(own, text: str | None) -> set:
    """The values of all needles that the text contains."""
    return set().union(*{values for _, values in own.iter(text)}) if own and text else set()


def containing(texts: DataFrame, key: str, text: str, needles: DataFrame) -> DataFrame:
    """(needle, key) of every row of texts and every distinct needle (the only column of needles) that it contains. Empty and null needles and texts meet nothing."""
    column = needles.columns[0]
    distinct = needles.select(F.col(column).alias("needle")).where(F.length("needle") > 0).distinct()
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()
    blocks = max(1, -(-n // NEEDLES), -(-size // NEEDLE_BYTES))
    kind, out = texts.schema[key].dataType.simpleString(), None
    for b in range(blocks):
        part = [r.needle for r in distinct.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).collect()]
        got = texts.select(key, text).mapInArrow(_search(texts.sparkSession.sparkContext.broadcast(part), key), f"needle string, `{key}` {kind}")
        out = got if out is None else out.unionByName(got)
    return out


def _search(share, key: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton((n, n) for n in share.value)
        for batch in batches:
            found = [(i, n) for i, t in enumerate(batch.column(1).to_pylist()) for n in sorted(met(own, t))]
            yield pa.RecordBatch.from_arrays([pa.array([n for _, n in found], pa.string()), batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))], ["needle", key])

    return work

"""Regex matching that can be stopped: a pattern that runs away gives no rows and a flag, and the session goes on."""

from __future__ import annotations

import multiprocessing
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_MS, USUAL_MS = 10, 300
#: Texts that are matched under one deadline.
AT_ONCE = 4096


def _match(send, pattern: str, flags: int, texts: list[str | None]) -> None:
    rule = re.compile(pattern, flags)
    send.send([i for i, t in enumerate(texts) if t is not None and rule.search(t)])


def matches(leaves: DataFrame, query: str, deadline_ms: int = USUAL_MS, case_sensitive: bool = False) -> DataFrame:
    """(leaf_id, timeout): leaves (leaf_id, text) that match, and a row with a null leaf_id and true for texts at which time ran out.

    The JVM's matcher can't be interrupted, so this is Python's, in a child process for every AT_ONCE texts, which is
    killed at the deadline. A pattern that doesn't compile is taken literally."""
    try:
        re.compile(query)
        pattern = query
    except re.error:
        pattern = re.escape(query)
    flags, seconds = 0 if case_sensitive else re.I, max(LEAST_MS, deadline_ms) / 1000

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = multiprocessing.get_context("fork")
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                receive, send = own.Pipe(False)
                child = own.Process(target=_match, args=(send, pattern, flags, part.column(1).to_pylist()))
                child.start()
                send.close()
                found = receive.recv() if receive.poll(seconds) else None
                child.kill()
                child.join()
                ids = part.column(0).take(pa.array(found, pa.int64())) if found is not None else pa.nulls(1, part.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array([found is None] * len(ids), pa.bool_())], ["leaf_id", "timeout"])

    kind = leaves.schema["leaf_id"].dataType.simpleString()
    return leaves.select("leaf_id", "text").mapInArrow(work, f"leaf_id {kind}, timeout boolean")


def search(leaves: DataFrame, query: str, deadline_ms: int = USUAL_MS, case_sensitive: bool = False) -> tuple[DataFrame, bool]:
    """Matching leaves, and whether time ran out anywhere; if it did, there are no rows."""
    found = matches(leaves, query, deadline_ms, case_sensitive)
    late = bool(found.where("timeout").limit(1).count())
    rows = leaves.join(found.where("not timeout").select("leaf_id"), "leaf_id", "left_semi")
    return (rows.where(F.lit(False)) if late else rows), late

"""The log as a stream: transactions wait for their commit, leaves keep their last state, counters are kept up to date.

State is kept by key in the session's state store; with many keys that should be the RocksDB provider, which
`configure` sets. Checkpoints make all of it resume after a failure."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import replay

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPERATION = "tx string, seq long, hash string, type string, id string, value double"
LEAF = "id string, live boolean, value double, seq long, confidence double"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _mark(hash: str | None) -> int:
    return int.from_bytes(blake2b(repr(hash).encode(), digest_size=7).digest(), "big")


class Transactions(StatefulProcessor):
    """Operations of a transaction, given out once a commit names exactly their hashes in order.

    Whichever comes last, an operation or the commit, in whatever batch, completes the transaction; a commit that names
    others waits on. With a time to live, what has waited for longer is forgotten.

    Operations are kept by their place in the log, and beside them only their number and the sum of a mark of each hash. A
    batch adds what arrives; the operations are read again only when a waiting commit has the same number and sum."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "seq long", OPERATION.replace("tx string, seq long, ", ""), self.ttl_ms)
        self.have = handle.getValueState("have", "n long, total long", self.ttl_ms)
        self.asked = handle.getListState("asked", "number long, n long, total long", self.ttl_ms)
        self.hashes = handle.getMapState("hashes", "number long", "hashes array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, total = self.have.get() if self.have.exists() else (0, 0)
        asked = [tuple(r) for r in self.asked.get()] if self.asked.exists() else []
        fresh = max((a[0] for a in asked), default=-1) + 1
        for batch in rows:
            for r in batch.itertuples():
                if r.kind == "commit":
                    named = list(r.hashes)
                    self.hashes.updateValue((fresh,), (named,))
                    asked.append((fresh, len(named), sum(map(_mark, named)) % (1 << 62)))
                    fresh += 1
                    continue
                place = (int(r.seq),)
                if self.held.containsKey(place):  # the same place again takes the former's
                    n, total = n - 1, total - _mark(self.held.getValue(place)[0])
                self.held.updateValue(place, (r.hash, r.type, r.id, None if pd.isna(r.value) else float(r.value)))
                n, total = n + 1, (total + _mark(r.hash)) % (1 << 62)
        out, left = [], []
        for a in asked:
            if n and a[1:] == (n, total):
                waiting = sorted((int(k[0]), *v) for k, v in self.held.iterator())
                if [w[1] for w in waiting] == list(self.hashes.getValue((a[0],))[0]):
                    out += [(key[0], *w) for w in waiting]
                    n, total = 0, 0
                    self.held.clear()
                    self.hashes.removeKey((a[0],))
                    continue
            left.append(a)
        self.have.update((n, total))
        self.asked.clear()
        if left:
            self.asked.put(left)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OPERATION.split(", ")])

    def close(self) -> None:
        pass


def committed(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Operations of committed transactions. log: tx, seq, kind (operation or commit), hash, hashes, type, id, value; streaming or not.

    ttl_ms: how long operations wait for their commit, and a commit for its operations, before they are dropped from the state; None: for ever. With it, a stream that
    is to end when its data does needs spark.sql.streaming.noDataMicroBatches.enabled to be false."""
    return log.groupBy("tx").transformWithStateInPandas(Transactions(ttl_ms), OPERATION, "Append", "None" if ttl_ms is None else "ProcessingTime")


def leaf_states(operations: DataFrame) -> DataFrame:
    """Updates of leaves' states (LEAF), a row for each leaf that a batch touches. operations: id, seq, type, value (of a provenance, its confidence).

    The state is the batch fold's summary (`replay.summaries`), kept by Spark's own aggregation; operations may come in any order."""
    given = F.create_map(F.lit("confidence"), F.col("value").cast("string"))
    summed = replay.summaries(operations.withColumn("provenance", F.when(F.col("type") == "provenance", given)), fields=("confidence",))
    return replay.states(summed, ("confidence",)).select("id", "live", "value", "seq", F.col("confidence").cast("double").alias("confidence"))


def counters(outcomes: DataFrame) -> DataFrame:
    """(outcome, n) so far, to be written in complete mode."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling window; events later than the watermark are left out. A timestamp without a zone is taken as UTC's."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def write_batches(stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d):
    """A query that writes every batch to a folder of its own, whole or anew: a batch that is run again takes its own place."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)

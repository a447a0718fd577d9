from __future__ import annotations

import random

import pytest

from coppice.operators import replay
from coppice.streaming import replay as R

LOG = "tx string, seq long, kind string, hash string, hashes array<string>, type string, id string, value double"


@pytest.fixture
def log(spark, tmp_path):
    """A log in three files: one transaction spans two of them, one is never committed, one commit is wrong."""
    rng, rows, seq = random.Random(2), [], 0
    for t in range(12):
        own = []
        for _ in range(rng.randint(1, 4)):
            seq += 1
            own.append(f"h{seq}")
            rows.append((f"t{t}", seq, "operation", f"h{seq}", None, rng.choice(["upsert", "upsert", "provenance", "delete"] + ["forget"] * (t == 5)), rng.choice("abcde"), float(seq)))
        seq += 1
        if t != 7:
            rows.append((f"t{t}", seq, "commit", None, own if t != 3 else ["wrong"], None, None, None))
    step = len(rows) // 3 + 1
    for i in range(3):
        spark.createDataFrame(rows[i * step : (i + 1) * step], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return str(tmp_path / "log")


def collect(spark, df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_equals_batch(spark, log, tmp_path):
    R.configure(spark)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(log)
    out = collect(spark, R.committed(stream), "append", "ops", tmp_path)
    batch = spark.read.schema(LOG).parquet(log)
    want = replay.committed(batch.where("kind = 'operation'").select("tx", "seq", "hash", "type", "id", "value"), batch.where("kind = 'commit'").select("tx", "seq", "hashes"))
    assert sorted(r.seq for r in out.collect()) == sorted(r.seq for r in want.collect())
    out.write.parquet(str(tmp_path / "ops_files"))
    ops = spark.readStream.schema(R.OPERATION).parquet(str(tmp_path / "ops_files"))
    states = collect(spark, R.leaf_states(ops), "update", "leaves", tmp_path)
    last = {}
    for r in states.orderBy("seq").collect():
        last[r.id] = r
    live = {i: (r.value, r.seq) for i, r in last.items() if r.live}
    assert live == {r.id: (r.value, r.seq) for r in replay.leaf_state(want.selectExpr("*", "cast(null as map<string,string>) provenance")).collect()}


def test_batches_take_their_own_place(spark, log, tmp_path):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(log)
    for _ in range(2):
        R.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.where("kind = 'operation'")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(log).where("kind = 'operation'").count()


def test_counters_and_windows(spark, tmp_path):
    spark.createDataFrame([("hit",), ("miss",), ("hit",)], "outcome string").write.parquet(str(tmp_path / "o"))
    out = collect(spark, R.counters(spark.readStream.schema("outcome string").parquet(str(tmp_path / "o"))), "complete", "counted", tmp_path)
    assert {r.outcome: r.n for r in out.collect()} == {"hit": 2, "miss": 1}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    counted = collect(spark, R.windowed(stream, "ts", "1 day", "1 hour", "event_type"), "append", "windows", tmp_path)
    assert 0 < counted.count() <= events.selectExpr("date(ts) d", "event_type").distinct().count()


def test_operations_after_their_commit(spark, tmp_path):
    """A commit that comes before its operations completes them; with a time to live the same."""
    R.configure(spark)
    rows = [("t", 3, "commit", None, ["a", "b"], None, None, None), ("t", 1, "operation", "a", None, "upsert", "x", 1.0), ("t", 2, "operation", "b", None, "upsert", "y", 2.0), ("u", 1, "operation", "c", None, "upsert", "z", 3.0)]
    for r in rows:
        spark.createDataFrame([r], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a stream with a time to live goes on for ever
    for name, ttl in (("kept", None), ("timed", 3_600_000)):
        out = collect(spark, R.committed(stream, ttl), "append", name, tmp_path)
        assert sorted((r.tx, r.seq, r.hash) for r in out.collect()) == [("t", 1, "a"), ("t", 2, "b")]

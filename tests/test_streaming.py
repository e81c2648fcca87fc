"""The shuffle buffer and the event-time groups against step-by-step versions."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from rollspark.streaming import rollouts as ST


def buffered(batches, size, batch_size, seed=0):
    """Rows in the order in which they leave the buffer, as batch numbers; the rest is left."""
    place, out, arrival = {}, [], 0
    for rows in batches:
        for key in sorted(rows, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k)):
            at = arrival if arrival < size else int(hashlib.md5(f"{seed}|place|{arrival}".encode()).hexdigest()[:8], 16) % size
            if at in place:
                out.append(place[at])
            place[at] = key
            arrival += 1
    return {k: i // batch_size for i, k in enumerate(out[:len(out) // batch_size * batch_size])}


def test_rows_of_different_files_meet_in_a_batch_and_replays_agree(spark):
    batches = [list(range(0, 70)), list(range(100, 105)), list(range(200, 290)), []]
    frames = [spark.createDataFrame([(k,) for k in b], "k long") for b in batches]
    out = ST.stream_path(spark, "buffer") + "/data"
    fn = ST.shuffled_batches(frames[0], out, 10, "k", buffer_size=40)
    for epoch, f in enumerate(frames):
        fn(f, epoch)
        if epoch in (1, 2):
            fn(f, epoch)  # the same micro-batch again, as after a restart
    got = {r["k"]: r["batch_id"] for r in spark.read.parquet(out).collect()}
    assert got == buffered(batches, 40, 10)
    left = {r["k"] for r in ST.pending(spark, out).collect()}
    assert left | set(got) == {k for b in batches for k in b} and not left & set(got)
    mixed = [b for b in set(got.values()) if len({k // 100 for k, x in got.items() if x == b}) > 1]
    assert mixed


@pytest.fixture
def rocksdb(spark):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(store, before) if before else spark.conf.unset(store)


def test_idle_groups_end_without_a_running_clock(spark, rocksdb):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    files = [[(1, "a", 1.0, t(0)), (1, "b", 0.0, t(0)), (2, "a", 1.0, t(0)), (3, "a", 1.0, t(1))],
             [(2, "b", 0.0, t(5)), (3, "b", 1.0, t(5)), (3, "c", 0.0, t(5)), (3, "d", 0.0, t(5))],
             [(1, "c", 1.0, t(30)), (9, "z", 1.0, t(30))]]
    schema = "uid long, sample_key string, reward double, arrived timestamp"
    path = ST.stream_path(spark, "timed_input")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    waiting = spark.createDataFrame([(9, "y", 0.0, t(0)), (8, "x", 1.0, t(0))], schema)
    stream = ST.file_stream(spark, path + "/*", waiting.schema)
    out = ST.stream_path(spark, "timed")
    q = ST.timed_groups(stream, 3, "10 hours", initial=waiting).writeStream.format("parquet").option("path", out + "/data") \
        .option("checkpointLocation", out + "/ck").outputMode("append").trigger(availableNow=True).start()
    ST.run_available(q)
    got = {}
    for r in spark.read.parquet(out + "/data").collect():
        got.setdefault((r["uid"], r["group_no"], r["complete"]), set()).add(r["sample_key"])
    assert got[(3, 0, True)] == {"a", "b", "c"} and got[(3, 1, False)] == {"d"}
    assert got[(2, 0, False)] == {"a", "b"} and got[(8, 0, False)] == {"x"}
    assert all(len(keys) < 3 for (_, _, complete), keys in got.items() if not complete)
    assert sum(len(k) for k in got.values()) + 2 >= sum(map(len, files))  # only what came last may still wait

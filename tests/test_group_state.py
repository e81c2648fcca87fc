"""One call of T1's state function works on all uids of its key, each with its own samples and its own idle time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rollspark.operators import advantages as ADV
from rollspark.streaming import rollouts as ST


class State:
    """What the state function uses of Spark's group state."""

    def __init__(self):
        self.value, self.now, self.hasTimedOut, self.timeout = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms

    def getCurrentProcessingTimeMs(self):
        return self.now


def rows(*samples):
    return pd.DataFrame(samples, columns=["uid", "sample_key", "reward"])


def test_uids_of_one_key_fill_and_time_out_apart():
    fn, state = ST._group_fn(2, 1e-6, 100), State()
    got = [list(fn((0,), iter([rows((7, "b", 1.0), (5, "a", 1.0)), rows((7, "a", 0.0), (7, "c", 1.0))]), state))]
    assert state.timeout == 100
    state.now = 60
    got.append(list(fn((0,), iter([rows((5, "b", 0.0), (ST.NO_UID, "n", 1.0))]), state)))
    state.now, state.hasTimedOut = 100, True
    got.append(list(fn((0,), iter([]), state)))
    assert state.timeout == 60
    state.now = 160
    got.append(list(fn((0,), iter([]), state)))
    assert not state.exists
    told = [[(None if pd.isna(r.uid) else int(r.uid), r.group_no, r.sample_key, r.n_in_group, r.complete) for f in frames for r in f.itertuples()] for frames in got]
    assert told == [[(7, 0, "a", 2, True), (7, 0, "b", 2, True)], [(5, 0, "a", 2, True), (5, 0, "b", 2, True)],
                    [(7, 1, "c", 1, False)], [(None, 0, "n", 1, False)]]
    first = got[0][0]["advantage"].tolist()
    assert abs(first[0] + 0.5 / (0.5 ** 0.5 + 1e-6)) < 1e-9 and abs(first[0] + first[1]) < 1e-12


def test_state_has_few_keys_and_tells_who_waits(spark):
    schema = "uid long, sample_key string, reward double"
    path, out = ST.stream_path(spark, "state_input"), ST.stream_path(spark, "state")
    spark.createDataFrame([(i, k, 1.0) for i in range(40) for k in "abc"] + [(None, "z", 1.0)], schema).coalesce(1).write.parquet(path)
    q = ST.complete_groups(ST.file_stream(spark, path, schema), 2, timeout_ms=None).writeStream.format("parquet").option("path", out + "/data") \
        .option("checkpointLocation", out + "/ck").outputMode("append").trigger(availableNow=True).start()
    ST.run_available(q)
    assert spark.read.parquet(out + "/data").groupBy("uid").count().where("count = 2").count() == 40
    left = {(r["uid"], r["sample_key"]) for r in ST.waiting_samples(spark, out + "/ck").collect()}
    assert left == {(i, "c") for i in range(40)} | {(None, "z")}
    assert spark.read.format("statestore").load(out + "/ck").schema["key"].dataType.names == ["state_key"]


def test_gae_takes_rows_without_tokens(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1, 1]), (2, [], [])], "id int, v array<double>, m array<int>").coalesce(1)
    got = {r["id"]: r["returns"] for r in ADV.gae(df, "v", "v", "m").select("id", F.col("returns")).collect()}
    assert got == {1: [3.0, 2.0], 2: []}

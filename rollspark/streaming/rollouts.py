"""Structured Streaming jobs for rollouts that are still arriving.

Sources are file streams (a directory, or a glob for one file); state lives in
the checkpoint under the shared folder named by ``spark.checkpoint.dir``, and
``foreachBatch`` sinks overwrite their own ``epoch=`` partition, so a
restarted job resumes exactly once. What a micro-batch cannot finish is carried
over: it is written to ``<out>_pending`` with the epoch and joins the next
micro-batch, so the sink does not depend on how the input was cut into files.
:func:`pending` reads what is left when a stream ends.

- T1 ``complete_groups``: state (``applyInPandasWithState``), kept for many uids
  under one key, holds samples until ``n`` have arrived, then emits exactly ``n`` as a group with
  its GRPO advantages and keeps the rest; :func:`waiting_samples` reads the
  samples that still wait. ``timed_groups`` does so by event time
  (``transformWithState``: list state, timers, an initial state), so idle groups
  end in a drained run as well.
- T2 ``accumulate_kept_groups``: whole groups with reward variance are appended
  until the target number of groups is reached.
- T3 ``release_minibatches``: whole groups wait until ``m`` of them fill a
  minibatch, numbered after the ones already released.
- T4 ``route_stale``: current step read per micro-batch, two sinks.
- T5 ``shuffled_batches``: rows pass through a shuffle buffer into fixed
  batches, numbered on; the buffer and the incomplete batch stay pending.
- T6 ``rolling_metrics``: streaming ``groupBy(step, source)`` aggregate.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from rollspark.session import checkpoint_dir


def stream_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "streams", name, uuid.uuid4().hex)


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet file stream; ``path`` is a directory or a glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(query) -> None:
    """Block until an ``availableNow`` query has drained its source."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def write_epoch(df: DataFrame, path: str, epoch_id: int) -> None:
    """Write one micro-batch's output as partition ``epoch=<epoch_id>`` of
    ``path``, replacing that partition if it exists: a micro-batch replayed
    after a restart overwrites its own earlier output instead of appending a
    second copy, so ``foreachBatch`` sinks stay exactly-once."""
    df.withColumn("epoch", F.lit(epoch_id).cast("long")).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


# ----------------------------------------------------------------- T1

GROUP_OUT = "uid long, group_no long, sample_key string, reward double, advantage double, n_in_group long, complete boolean"
#: Keys of the state: uids are dealt to so many by a hash, and one call works on all of a key's uids at once. Part of a checkpoint.
STATE_KEYS = 4096
UID_STATE = "uids array<long>, released array<long>, last array<long>"  # groups released, and when samples came last, by uid
GROUP_STATE = "waiting array<struct<uid: long, sample_key: string, reward: double>>, " + UID_STATE
_SAMPLE = "uid long, sample_key string, reward double"
NO_UID = -(1 << 63)  # stands for a null uid in the state and inside a call


def _by_state_key(rows: DataFrame, *more) -> DataFrame:
    """The rows with the state key of their uid, a null uid replaced."""
    uid = F.coalesce("uid", F.lit(NO_UID)).cast("long")
    return rows.select(F.pmod(F.xxhash64("uid"), F.lit(STATE_KEYS)).alias("state_key"), uid.alias("uid"), "sample_key", F.col("reward").cast("double").alias("reward"), *more)


def _frame(samples):
    """(uid, sample_key, reward) tuples as a frame."""
    import numpy as np
    import pandas as pd
    uids, keys, rewards = zip(*samples, strict=True) if samples else ((), (), ())
    return pd.DataFrame({"uid": np.array(uids, np.int64), "sample_key": np.array(keys, object), "reward": np.array(rewards, float)})


def _arrived(came):
    """The frames that came, in one order whatever the tasks."""
    import pandas as pd
    came = pd.concat(list(came))
    return came.sort_values("sample_key", kind="stable").reset_index(drop=True)


def _samples(frame) -> list[tuple]:
    return list(zip(frame["uid"].tolist(), frame["sample_key"].tolist(), frame["reward"].astype(float).tolist(), strict=True))


def _advantages(rows, eps):
    """``rows`` (uid, group_no, sample_key, reward, complete), whose groups stand together, with their advantages."""
    import numpy as np
    import pandas as pd
    if not len(rows):
        return None
    uid, no, r = (rows[c].to_numpy() for c in ("uid", "group_no", "reward"))
    new = np.concatenate([[True], (uid[1:] != uid[:-1]) | (no[1:] != no[:-1])])
    first = np.flatnonzero(new)
    n, of = np.diff(np.concatenate([first, [len(r)]])), np.cumsum(new) - 1
    mean = np.add.reduceat(r, first) / n
    off = r - mean[of]
    std = np.sqrt(np.add.reduceat(off * off, first) / np.maximum(n - 1, 1))
    adv = np.where(n[of] == 1, r / (1.0 + eps), off / (std[of] + eps))
    ids = pd.array(uid, "Int64")
    ids[uid == NO_UID] = pd.NA
    return pd.DataFrame({"uid": ids, "group_no": no, "sample_key": rows["sample_key"].to_numpy(), "reward": r, "advantage": adv,
                         "n_in_group": n[of], "complete": rows["complete"].to_numpy()})


def _release(held, came, released: dict, n: int):
    """(samples of full groups with their group numbers, samples that wait): the held samples of a uid come first."""
    import numpy as np
    import pandas as pd
    rows = pd.concat([held, came[held.columns]], ignore_index=True)
    rows = rows.iloc[np.argsort(rows["uid"].to_numpy(), kind="stable")]
    uid = rows["uid"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])) if len(uid) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(uid)]]))
    before = np.array([released.get(u, 0) for u in uid[first].tolist()], np.int64)
    place = np.arange(len(uid)) - np.repeat(first, size)
    full = place < np.repeat(size // n * n, size)
    rows = rows.assign(group_no=np.repeat(before, size) + place // n, complete=True)
    released.update(zip(uid[first].tolist(), (before + size // n).tolist(), strict=True))
    return rows[full], rows.loc[~full, list(held.columns)]


def _idle(held, due, released: dict):
    """(samples of the uids in ``due`` as incomplete groups, samples that wait on)."""
    out = held["uid"].isin(due)
    gone = held[out]
    gone = gone.assign(group_no=[released.get(u, 0) for u in gone["uid"].tolist()], complete=False)
    for u in set(gone["uid"].tolist()):
        released[u] = released.get(u, 0) + 1
    return gone, held[~out]


def _group_fn(n: int, eps: float, timeout_ms: int | None):
    def fn(key, pdfs, state):
        held, released, last = _frame([]), {}, {}
        if state.exists:
            waiting, uids, numbers, times = state.get
            held = _frame([tuple(x) for x in waiting])
            released, last = dict(zip(uids, numbers, strict=True)), dict(zip(uids, times, strict=True))
        now = 0 if timeout_ms is None else state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            rows, held = _idle(held, [u for u in set(held["uid"].tolist()) if last[u] + timeout_ms <= now], released)
            # as if the uid had not been seen: its next samples begin at group 0
            for u in set(rows["uid"].tolist()) | {u for u in released if last[u] + timeout_ms <= now}:
                del released[u], last[u]
        else:
            came = _arrived(pdfs)
            rows, held = _release(held, came, released, n)
            last.update(dict.fromkeys(came["uid"].tolist(), now))
        if not released:
            state.remove()
        else:
            uids = list(released)
            state.update((_samples(held), uids, [released[u] for u in uids], [last[u] for u in uids]))
            if timeout_ms is not None:
                state.setTimeoutDuration(max(1, min(last.values()) + timeout_ms - now))
        out = _advantages(rows, eps)
        if out is not None:
            yield out

    return fn


def complete_groups(stream: DataFrame, n: int, eps: float = 1e-6, timeout_ms: int | None = 10 * 60 * 1000) -> DataFrame:
    """Emit a uid's samples ``n`` at a time as they arrive, with GRPO
    advantages computed inside the group. The state has ``STATE_KEYS`` keys; that of
    one holds fewer than n samples of each of its uids and how many groups they
    released, so a call does the work of all its uids at once. With ``timeout_ms`` an incomplete
    group idle that long is emitted as incomplete; that needs a continuously
    running query, because a processing-time timeout makes Spark schedule a
    batch after every batch. A run that drains its source (``availableNow``)
    passes ``None`` and reads what is left with :func:`waiting_samples`."""
    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return _by_state_key(stream).groupBy("state_key").applyInPandasWithState(_group_fn(n, eps, timeout_ms), GROUP_OUT, GROUP_STATE, "append", timeout)


class _TimedGroups(StatefulProcessor):
    """Samples of the uids of one state key until ``n`` of a uid have come or it is idle too long; one timer, for the uid that is idle first."""

    def __init__(self, n: int, eps: float, idle_ms: int):
        self.n, self.eps, self.idle_ms = n, eps, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", _SAMPLE)
        self.counts = handle.getValueState("counts", UID_STATE + ", timer long")

    def _load(self):
        got = self.counts.get() if self.counts.exists() else None
        released, last, timer = (dict(zip(got[0], got[1], strict=True)), dict(zip(got[0], got[2], strict=True)), int(got[3])) if got else ({}, {}, 0)
        return _frame([tuple(x) for x in self.samples.get()] if self.samples.exists() else []), released, last, timer

    def _keep(self, held, released, last, timer: int) -> None:
        """State and timer after some samples; without waiting samples there is no timer."""
        waiting = set(held["uid"].tolist())
        due = min((last[u] for u in waiting), default=0) + self.idle_ms if waiting else 0
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if due and timer != due:
            self.handle.registerTimer(due)
        if waiting:
            self.samples.put(_samples(held))
        elif self.samples.exists():
            self.samples.clear()
        uids = list(released)
        self.counts.update((uids, [released[u] for u in uids], [last.get(u, 0) for u in uids], due))

    def _came(self, came):
        last = came.groupby("uid")["arrived"].max()
        return dict(zip(last.index.tolist(), [int(x.value // 10**6) for x in last], strict=True))

    def handleInputRows(self, key, rows, timerValues):
        came = _arrived(rows)
        held, released, last, timer = self._load()
        full, held = _release(held, came, released, self.n)
        self._keep(held, released, last | self._came(came), timer)
        out = _advantages(full, self.eps)
        if out is not None:
            yield out

    def handleInitialState(self, key, initialState, timerValues) -> None:
        import pandas as pd
        held, released, last, timer = self._load()  # a key's rows may come in several pieces
        held = pd.concat([held, initialState[held.columns]], ignore_index=True)
        self._keep(held, dict.fromkeys(held["uid"].tolist(), 0) | released, last | self._came(initialState), timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, released, last, timer = self._load()
        at, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        due = [u for u in set(held["uid"].tolist()) if last[u] + self.idle_ms <= at or last[u] + self.idle_ms < mark]
        gone, held = _idle(held, due, released)
        self._keep(held, released, last, 0 if timer == at else timer)
        out = _advantages(gone.iloc[gone["uid"].to_numpy().argsort(kind="stable")], self.eps)
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def timed_groups(stream: DataFrame, n: int, idle: str, eps: float = 1e-6, arrived: str = "arrived", delay: str = "0 seconds",
                 initial: DataFrame | None = None) -> DataFrame:
    """T1 by event time: like :func:`complete_groups`, and a uid whose waiting samples saw no other for ``idle`` (an
    interval such as '90 minutes') is emitted as incomplete when the watermark of ``arrived`` has passed that time.

    The time is that of the data, so it needs no running clock: a run that
    drains its source ends the idle groups too. Samples that come later start
    the uid's next group. ``initial`` (uid, sample_key, reward, ``arrived``) are
    samples that wait already, as read with :func:`waiting_samples` from an
    earlier query. The session's state store must be RocksDB."""
    spark = stream.sparkSession
    at = F.lit(0).cast("timestamp")
    idle_ms = spark.range(1).select(F.unix_millis(at + F.expr(f"interval {idle}")) - F.unix_millis(at)).first()[0]
    cols = ["uid", "sample_key", "reward", F.col(arrived).alias("arrived")]
    rows = _by_state_key(stream.select(*cols).withWatermark("arrived", delay), "arrived")
    return rows.groupBy("state_key").transformWithStateInPandas(
        _TimedGroups(n, eps, idle_ms), GROUP_OUT, "append", "EventTime",
        initialState=None if initial is None else _by_state_key(initial.select(*cols), "arrived").groupBy("state_key"))


def waiting_samples(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(uid, sample_key, reward) of the samples that wait in T1's state, read from the query's checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    waits = state.select(F.explode("value.groupState.waiting").alias("w")).select("w.uid", "w.sample_key", "w.reward")
    return waits.withColumn("uid", F.nullif("uid", F.lit(NO_UID)))


# ----------------------------------------------------------------- T2 / T3 / T4 / T5

def read_epochs(spark: SparkSession, path: str, condition, schema) -> DataFrame:
    """Rows of the epochs of a sink that meet ``condition``; empty if nothing was written yet.

    Only a missing folder counts as "not yet"; any other failure to read surfaces."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).filter(condition)


def pending(spark: SparkSession, out_path: str) -> DataFrame | None:
    """The rows that the last micro-batch carried over; None before the first."""
    path = out_path.rstrip("/") + "_pending"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    epoch = spark.read.parquet(out_path.rstrip("/") + "_status").agg(F.max("epoch")).first()[0]
    return spark.read.parquet(path).filter(F.col("epoch") == epoch).drop("epoch")


def _carried(batch: DataFrame, out_path: str, epoch_id: int, extra: str = "") -> DataFrame:
    """The rows that the micro-batch before ``epoch_id`` carried over (columns of ``batch`` and ``extra``)."""
    from pyspark.sql.types import StructType
    fields = [*batch.schema.fields, *(StructType.fromDDL(extra).fields if extra else [])]
    schema = StructType(fields).add("epoch", "long")
    return read_epochs(batch.sparkSession, out_path.rstrip("/") + "_pending", F.col("epoch") == epoch_id - 1, schema).drop("epoch")


def _status(spark: SparkSession, out_path: str, epoch_id: int, schema: str) -> dict:
    """The status row of the last epoch before ``epoch_id``, or an empty dict."""
    rows = read_epochs(spark, out_path.rstrip("/") + "_status", F.col("epoch") < epoch_id, schema + ", epoch long") \
        .orderBy(F.desc("epoch")).limit(1).collect()
    return rows[0].asDict() if rows else {}


def _whole_groups(rows: DataFrame, group: str, size) -> tuple[DataFrame, DataFrame]:
    """(rows of groups that have all their samples, rows of the others); ``size`` is a number or the name
    of a column with the group's size. Null groups count as one group."""
    want = F.lit(size) if isinstance(size, int) else F.max(size)
    state = rows.groupBy(group).agg((F.count(F.lit(1)) >= want).alias("_whole")).withColumnRenamed(group, "_g")
    j = rows.join(state, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return j.filter("_whole").drop("_whole"), j.filter("not _whole").drop("_whole")


def accumulate_kept_groups(stream: DataFrame, out_path: str, target_groups: int, group="uid", score="reward",
                           n_samples_per_prompt: int = 2, max_sample_batches: int = 0, group_size=None):
    """Keep groups with reward variance and append them to ``out_path``
    until ``target_groups`` groups are kept; further ones are not written.

    ``group_size`` (a number or a column name) tells when a group has all its
    samples; until then its rows are carried over, so a group split over
    micro-batches is judged once, as a whole. Without it the groups of a
    micro-batch are taken as whole, as generation returns them. Groups of one
    micro-batch are taken in the order of their key. A one-row-per-batch status
    table (``<out_path>_status``: kept_groups running total, keep_sampling)
    records progress. Hitting ``max_sample_batches`` (> 0) while still short of
    the target raises. Returns the foreachBatch function."""
    from rollspark.operators.select import dynamic_filter
    status_schema = "kept_groups long, keep_sampling boolean"

    def fn(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        before = int(_status(spark, out_path, epoch_id, status_schema).get("kept_groups", 0))
        rows, rest = batch, None
        if group_size is not None:
            rows, rest = _whole_groups(batch.unionByName(_carried(batch, out_path, epoch_id)), group, group_size)
        kept = dynamic_filter(rows, group, score, n_samples_per_prompt=n_samples_per_prompt)
        # an ordered top-k whose limit is the number of groups still wanted
        taken = kept.select(F.col(group).alias("_t")).distinct().orderBy(F.col("_t")).limit(max(0, target_groups - before))
        write_epoch(kept.join(taken, F.col(group).eqNullSafe(F.col("_t"))).drop("_t"), out_path, epoch_id)
        if rest is not None:
            write_epoch(rest, out_path.rstrip("/") + "_pending", epoch_id)
        from pyspark.sql.types import StructType
        written = read_epochs(spark, out_path, F.col("epoch") == epoch_id, StructType(list(kept.schema.fields)).add("epoch", "long"))
        new_groups = written.select(group).distinct().count()
        total = before + int(new_groups)
        keep_sampling = total < target_groups
        write_epoch(spark.createDataFrame([(total, keep_sampling)], status_schema), out_path.rstrip("/") + "_status", epoch_id)
        if keep_sampling and max_sample_batches > 0 and epoch_id + 1 >= max_sample_batches:
            raise RuntimeError(f"{total} groups kept after {max_sample_batches} sample batches; {target_groups} are wanted")
    return fn


def release_minibatches(stream: DataFrame, out_path: str, groups_per_minibatch: int, group="uid", seed: int = 0, group_size=None):
    """Release minibatches of exactly ``groups_per_minibatch`` whole groups.

    Groups become ready when they have ``group_size`` samples (a number or a
    column name; without it a micro-batch's groups are whole), wait in the order
    in which they became ready, seeded within a micro-batch, and are released
    when they fill a minibatch. Rows of waiting groups are carried over; the
    next minibatch number is kept in ``<out_path>_status``. A replayed
    micro-batch reads only earlier epochs."""
    from rollspark.plans.batching import seeded_order
    status_schema = "next_minibatch long"

    def fn(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        base = int(_status(spark, out_path, epoch_id, status_schema).get("next_minibatch", 0))
        carried = _carried(batch, out_path, epoch_id, "_place long")  # a place in the queue once the group is ready
        queued = carried.filter("_place is not null")
        fresh = carried.filter("_place is null").drop("_place").unionByName(batch)
        whole, rest = (fresh, fresh.limit(0)) if group_size is None else _whole_groups(fresh, group, group_size)
        waiting = queued.agg(F.max("_place")).first()[0]
        first = 0 if waiting is None else int(waiting) + 1
        order = seeded_order(whole.select(group).distinct(), group, seed).select(F.col(group).alias("_g"), (F.col("idx") + first).alias("_place"))
        ready = queued.unionByName(whole.join(order, F.col(group).eqNullSafe(F.col("_g"))).drop("_g"))
        released = (first + order.count()) // groups_per_minibatch
        mb = F.floor(F.col("_place") / groups_per_minibatch)
        write_epoch(ready.filter(mb < released).withColumn("minibatch", (F.lit(base) + mb).cast("bigint")).drop("_place"), out_path, epoch_id)
        left = ready.filter(mb >= released).withColumn("_place", F.col("_place") - released * groups_per_minibatch)
        write_epoch(left.unionByName(rest.withColumn("_place", F.lit(None).cast("long"))), out_path.rstrip("/") + "_pending", epoch_id)
        write_epoch(spark.createDataFrame([(base + released,)], status_schema), out_path.rstrip("/") + "_status", epoch_id)
    return fn


def route_stale(stream: DataFrame, current_step: DataFrame, kept_path: str, requeue_path: str,
                max_steps_off_policy: int):
    """T4: read the current step from its one-row table at each micro-batch
    (the trainer advances it between batches) and write fresh rollouts to
    ``kept_path``, stale ones to ``requeue_path``."""
    def fn(batch: DataFrame, epoch_id: int):
        step = current_step.agg(F.max("current_step")).first()[0]  # a single scalar
        j = batch.withColumn("current_step", F.lit(step))
        lag = F.col("current_step") - F.col("sampler_step")
        write_epoch(j.filter(lag <= max_steps_off_policy), kept_path, epoch_id)
        write_epoch(j.filter(lag > max_steps_off_policy), requeue_path, epoch_id)
    return fn


def shuffled_batches(stream: DataFrame, out_path: str, batch_size: int, key, seed: int = 0, buffer_size: int = 1024):
    """T5: rows pass through a shuffle buffer of ``buffer_size`` places and fill
    batches of ``batch_size``, numbered on over micro-batches.

    Rows arrive in seeded order within their micro-batch. The first ones fill
    the places; from then on each arriving row takes a seeded place, and the row
    that stood there goes out. So rows of different micro-batches meet in a
    batch. What a row waits for is the next arrival at its place: a window per
    place, no state outside the carried rows. Carried over are the rows in the
    buffer (at most ``buffer_size``) and those of the incomplete batch; those
    left when the stream ends are read with :func:`pending`, in places from 0 on."""
    from pyspark.sql import Window

    from rollspark.functions.cols import hash_int, seeded_hash
    from rollspark.plans.batching import seeded_order
    status_schema = "next_batch long, arrived long"

    def fn(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        status = _status(spark, out_path, epoch_id, status_schema)
        before = int(status.get("arrived", 0))
        came = seeded_order(batch, key, seed).withColumn("_arrival", F.col("idx") + before).drop("idx")
        place = F.when(F.col("_arrival") < buffer_size, F.col("_arrival")) \
            .otherwise(hash_int(seeded_hash(seed, F.lit("place"), "_arrival"), buffer_size).cast("long"))
        carried = _carried(batch, out_path, epoch_id, "_arrival long, _place long, _out long")
        rows = carried.unionByName(came.withColumn("_place", place).withColumn("_out", F.lit(None).cast("long")))
        # a row that has gone out has its turn and takes no part in the places any more
        taken = F.lead("_arrival").over(Window.partitionBy("_place", F.col("_out").isNull()).orderBy("_arrival"))
        rows = rows.withColumn("_out", F.coalesce("_out", taken - buffer_size))
        arrived = before + batch.count()
        full = max(0, arrived - buffer_size) // batch_size
        b = F.floor(F.col("_out") / batch_size)
        done = F.col("_out").isNotNull() & (b < full)
        write_epoch(rows.filter(done).withColumn("batch_id", b.cast("bigint")).drop("_arrival", "_place", "_out"), out_path, epoch_id)
        write_epoch(rows.filter(~done), out_path.rstrip("/") + "_pending", epoch_id)
        write_epoch(spark.createDataFrame([(full, arrived)], status_schema), out_path.rstrip("/") + "_status", epoch_id)
    return fn


# ----------------------------------------------------------------- T6

def rolling_metrics(stream: DataFrame, step="step", source="data_source", reward="reward") -> DataFrame:
    """Per (step, source) running mean reward, sample count and pass rate
    as rollouts land; run with outputMode('update') or 'complete'."""
    return stream.groupBy(step, source).agg(
        F.avg(F.col(reward).cast("double")).alias("avg_reward"), F.count(F.lit(1)).alias("n_samples"),
        F.avg(F.when(F.col(reward) > 0, 1.0).otherwise(0.0)).alias("frac_positive"))

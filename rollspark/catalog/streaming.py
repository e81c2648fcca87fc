"""Streaming queries (T1-T6): each writes the lineitem rows into several folders, so
that groups are split over micro-batches, runs a Structured Streaming job over
them (``availableNow``, a folder a micro-batch), with its checkpoint and sink in
the shared checkpoint folder, and returns the sink as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.cols import hash_int, rnd, seeded_hash
from rollspark.sources.fixtures import rollout_columns, with_views
from rollspark.sources.tables import table
from rollspark.streaming import rollouts as ST

FOLDERS, FILES = 3, 4
SHUFFLE_BUFFER = 1000


def _rollout_stream(spark, d):
    """The rollouts as a stream of ``FOLDERS`` folders of ``FILES`` files, written one after another: the folder of a row follows from its hash."""
    li = table(spark, d, "lineitem")
    sizes = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("group_n"))
    li = li.join(sizes, F.col("l_orderkey").eqNullSafe(F.col("k"))).drop("k")
    key = F.md5(F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint")))
    path = ST.stream_path(spark, "input")
    for i in range(FOLDERS):  # a folder a micro-batch, in this order
        li.filter(hash_int(seeded_hash("file", "l_orderkey", key), FOLDERS) == i).repartition(FILES).write.parquet(f"{path}/{i}")
    stream = ST.file_stream(spark, path + "/*", li.schema, max_files=FILES)
    return rollout_columns(stream, False, keep=("group_n",)), stream


def _fb(spark, name, stream, fn):
    ck = ST.stream_path(spark, name)
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", ck + "/ck") \
        .trigger(availableNow=True).start()
    ST.run_available(q)


# the file of a rollout, as SQL
FILED = f"""
, filed AS (SELECT *, ('0x' || md5('file|' || CAST(uid AS VARCHAR) || '|' || sample_key)[1:8])::BIGINT % {FOLDERS} AS part FROM rollouts)"""


@query("stream_complete_groups", with_views(FILED + f"""
, k AS (SELECT uid, sample_key, reward, CAST(floor((row_number() OVER (PARTITION BY uid ORDER BY part, sample_key) - 1) / 4) AS BIGINT) AS group_no,
               CAST(floor(count(*) OVER (PARTITION BY uid) / 4) AS BIGINT) AS released FROM filed)
, g AS (SELECT uid, group_no, avg(reward) AS m, stddev_samp(reward) AS s FROM k GROUP BY uid, group_no)
SELECT uid, group_no, sample_key, CASE WHEN group_no < released THEN {R("(reward - m) / (s + 1e-6)")} END AS advantage,
       CASE WHEN group_no < released THEN CAST(4 AS BIGINT) END AS n_in_group, group_no < released AS complete
FROM k JOIN g USING (uid, group_no)""", "rollouts"))
def q_complete_groups(spark, d):
    """Groups of exactly 4 and, from the state, the samples that still wait."""
    rs, _ = _rollout_stream(spark, d)
    out = ST.stream_path(spark, "complete_groups")
    q = ST.complete_groups(rs, 4, timeout_ms=None).writeStream.format("parquet").option("path", out + "/data") \
        .option("checkpointLocation", out + "/ck").outputMode("append").trigger(availableNow=True).start()
    ST.run_available(q)
    done = spark.read.parquet(out + "/data").select("uid", "group_no", "sample_key", rnd("advantage").alias("advantage"), "n_in_group", "complete")
    number = spark.read.parquet(out + "/data").groupBy(F.col("uid").alias("u")).agg(F.max("group_no").alias("last"))
    left = ST.waiting_samples(spark, out + "/ck").join(number, F.col("uid").eqNullSafe(F.col("u")), "left").select(
        "uid", (F.coalesce("last", F.lit(-1)) + 1).cast("bigint").alias("group_no"), "sample_key", F.lit(None).cast("double").alias("advantage"),
        F.lit(None).cast("bigint").alias("n_in_group"), F.lit(False).alias("complete"))
    return done.unionByName(left)


@query("stream_timed_groups", with_views(FILED + f"""
, k AS (SELECT uid, sample_key, reward, CAST(floor((row_number() OVER (PARTITION BY uid ORDER BY part, sample_key) - 1) / 4) AS BIGINT) AS group_no,
               CAST(floor(count(*) OVER (PARTITION BY uid) / 4) AS BIGINT) AS released, max(part) OVER (PARTITION BY uid) AS last FROM filed)
, g AS (SELECT uid, group_no, avg(reward) AS m, stddev_samp(reward) AS s, count(*) AS n FROM k GROUP BY uid, group_no)
SELECT uid, group_no, sample_key, {R("CASE WHEN n = 1 THEN reward / (1.0 + 1e-6) ELSE (reward - m) / (s + 1e-6) END")} AS advantage, CAST(n AS BIGINT) AS n_in_group, group_no < released AS complete
FROM k JOIN g USING (uid, group_no) WHERE group_no < released OR last = 0""", "rollouts"))
def q_timed_groups(spark, d):
    """Folder i arrives on day i; samples that wait for 36 hours end as incomplete groups, which those of folder 0 do."""
    rs, _ = _rollout_stream(spark, d)
    part = hash_int(seeded_hash("file", "uid", "sample_key"), FOLDERS)
    rs = rs.withColumn("arrived", F.timestamp_seconds(F.lit(1704067200) + part * 86400))
    out = ST.stream_path(spark, "timed_groups")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = ST.timed_groups(rs, 4, "36 hours").writeStream.format("parquet").option("path", out + "/data") \
            .option("checkpointLocation", out + "/ck").outputMode("append").trigger(availableNow=True).start()
        ST.run_available(q)
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    return spark.read.parquet(out + "/data").select("uid", "group_no", "sample_key", rnd("advantage").alias("advantage"), "n_in_group", "complete")


@query("stream_kept_groups", with_views(FILED + """
, g AS (SELECT uid, max(part) AS ready FROM filed GROUP BY uid HAVING stddev_pop(reward) > 0)
, taken AS (SELECT uid FROM (SELECT uid, row_number() OVER (ORDER BY ready, uid) AS n FROM g) WHERE n <= 1000)
SELECT uid, sample_key FROM rollouts WHERE uid IN (SELECT uid FROM taken)""", "rollouts"))
def q_kept(spark, d):
    rs, _ = _rollout_stream(spark, d)
    out = ST.stream_path(spark, "kept_groups") + "/data"
    _fb(spark, "kept_groups", rs, ST.accumulate_kept_groups(rs, out, 1000, group_size="group_n"))
    return spark.read.parquet(out).select("uid", "sample_key")


@query("stream_minibatches", with_views(FILED + """
, g AS (SELECT uid, max(part) AS ready FROM filed GROUP BY uid)
, o AS (SELECT uid, CAST(floor((row_number() OVER (ORDER BY ready, md5('0|' || CAST(uid AS VARCHAR)), uid) - 1) / 64) AS BIGINT) AS minibatch,
               CAST(floor(count(*) OVER () / 64) AS BIGINT) AS released FROM g)
SELECT r.uid, r.sample_key, CASE WHEN minibatch < released THEN minibatch END AS minibatch FROM rollouts r JOIN o USING (uid)""", "rollouts"))
def q_minibatches(spark, d):
    """Every row with its minibatch; null for those of the groups that still wait."""
    rs, _ = _rollout_stream(spark, d)
    out = ST.stream_path(spark, "minibatches") + "/data"
    _fb(spark, "minibatches", rs, ST.release_minibatches(rs, out, 64, group_size="group_n"))
    left = ST.pending(spark, out).select("uid", "sample_key", F.lit(None).cast("bigint").alias("minibatch"))
    return spark.read.parquet(out).select("uid", "sample_key", "minibatch").unionByName(left)


@query("stream_stale_routing", with_views("""
SELECT uid, sample_key, CASE WHEN 50 - resp_len <= 8 THEN 'kept' ELSE 'requeue' END AS route
FROM rollouts""", "rollouts"))
def q_stale_stream(spark, d):
    rs, _ = _rollout_stream(spark, d)
    rs = rs.withColumn("sampler_step", F.col("resp_len"))
    base = ST.stream_path(spark, "stale")
    current = spark.range(1).select(F.lit(50).alias("current_step"))
    _fb(spark, "stale", rs, ST.route_stale(rs, current, base + "/kept", base + "/requeue", 8))
    kept = spark.read.parquet(base + "/kept").select("uid", "sample_key", F.lit("kept").alias("route"))
    schema = rs.schema.add("current_step", "integer").add("epoch", "long")
    req = ST.read_epochs(spark, base + "/requeue", F.lit(True), schema).select("uid", "sample_key", F.lit("requeue").alias("route"))
    return kept.unionByName(req)


@query("stream_shuffled_batches", with_views(FILED + f"""
, a AS (SELECT uid, sample_key, row_number() OVER (ORDER BY part, md5('0|' || CAST(uid AS VARCHAR) || '|' || sample_key), uid, sample_key) - 1 AS j,
               count(*) OVER () AS n FROM filed)
, p AS (SELECT *, CASE WHEN j < {SHUFFLE_BUFFER} THEN j ELSE ('0x' || md5('0|place|' || CAST(j AS VARCHAR))[1:8])::BIGINT % {SHUFFLE_BUFFER} END AS place FROM a)
, o AS (SELECT *, lead(j) OVER (PARTITION BY place ORDER BY j) - {SHUFFLE_BUFFER} AS leaves FROM p)
SELECT uid, sample_key, CASE WHEN leaves // 256 < greatest(n - {SHUFFLE_BUFFER}, 0) // 256 THEN CAST(leaves // 256 AS BIGINT) END AS batch_id FROM o""", "rollouts"))
def q_shuffled(spark, d):
    """Every row with its batch; null for the buffer and the incomplete batch that are left at the end."""
    rs, _ = _rollout_stream(spark, d)
    out = ST.stream_path(spark, "shuffled") + "/data"
    _fb(spark, "shuffled", rs, ST.shuffled_batches(rs, out, 256, ["uid", "sample_key"], buffer_size=SHUFFLE_BUFFER))
    left = ST.pending(spark, out).select("uid", "sample_key", F.lit(None).cast("bigint").alias("batch_id"))
    return spark.read.parquet(out).select("uid", "sample_key", "batch_id").unionByName(left)


@query("stream_rolling_metrics", f"""
SELECT CAST(l_linenumber AS INTEGER) AS step, l_linestatus AS data_source,
       {R("avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)")} AS avg_reward, CAST(count(*) AS BIGINT) AS n_samples,
       {R("avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)")} AS frac_positive
FROM lineitem GROUP BY 1, 2""")
def q_rolling(spark, d):
    _, li = _rollout_stream(spark, d)
    stream = li.select(F.col("l_linenumber").cast("int").alias("step"), F.col("l_linestatus").alias("data_source"),
                       F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"))
    out = ST.stream_path(spark, "rolling") + "/data"

    def snapshot(batch, epoch_id):  # complete mode: each batch is the full current table
        batch.write.mode("overwrite").parquet(out)
    ck = ST.stream_path(spark, "rolling")
    q = ST.rolling_metrics(stream).writeStream.outputMode("complete").foreachBatch(snapshot) \
        .option("checkpointLocation", ck + "/ck").trigger(availableNow=True).start()
    ST.run_available(q)
    res = spark.read.parquet(out)
    return res.select("step", "data_source", rnd("avg_reward").alias("avg_reward"),
                      F.col("n_samples").cast("bigint").alias("n_samples"), rnd("frac_positive").alias("frac_positive"))

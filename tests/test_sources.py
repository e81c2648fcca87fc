import pytest
from pyspark.sql import functions as F

from rollspark.sources import files as S


def test_read_prompts_rejects_unknown_extension(spark):
    with pytest.raises(ValueError):
        S.read_prompts(spark, ["/nowhere/data.csv"])


def test_read_conversations_requires_messages(spark):
    path = S.scratch_path(spark, "bad_conv") + "/c.jsonl"
    spark.createDataFrame([("x",)], "other STRING").write.json(path)
    with pytest.raises(ValueError):
        S.read_conversations(spark, path)


def test_read_traces_whole_files(spark):
    path = S.scratch_path(spark, "traces_whole")
    rows = ['[[{"role":"user","content":"a"}],[{"role":"user","content":"b"},{"role":"assistant","content":"c"}]]',
            '[{"role":"user","content":"d"}]', '{"role":"user","content":"e"}']
    for i, r in enumerate(rows):
        spark.createDataFrame([(r,)], "value STRING").coalesce(1).write.text(f"{path}/f{i}")
    got = sorted(len(r.messages) for r in S.read_traces(spark, path + "/*", whole_files=True).collect())
    assert got == [1, 1, 1, 2]


def test_load_batch_prunes_partitions(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.dayofmonth("ts").alias("step"))
    path = S.scratch_path(spark, "batches_test")
    S.save_batch(ev, path)
    one = S.load_batch(spark, path, step=3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(step" in plan
    assert one.count() == ev.filter("step = 3").count()


def test_stream_kept_groups_raises_at_batch_limit(spark, sf_dir):
    import pytest
    from rollspark.catalog.streaming import _fb, _rollout_stream
    from rollspark.streaming import rollouts as ST
    rs, _ = _rollout_stream(spark, sf_dir)
    out = ST.stream_path(spark, "kept_limit") + "/data"
    with pytest.raises(Exception, match="groups kept after 1 sample batches"):
        _fb(spark, "kept_limit", rs, ST.accumulate_kept_groups(rs, out, 10 ** 9, max_sample_batches=1))
    status = spark.read.parquet(out + "_status").collect()
    assert len(status) == 1 and status[0].keep_sampling


def test_stream_minibatch_numbers_continue_across_batches(spark, sf_dir):
    from pyspark.sql import functions as F
    from rollspark.catalog.streaming import _fb
    from rollspark.sources.fixtures import rollout_columns
    from rollspark.streaming import rollouts as ST
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    src = S.scratch_path(spark, "two_files")
    li.filter(F.col("l_returnflag") == "R").coalesce(1).write.parquet(src + "/a")
    li.filter(F.col("l_returnflag") != "R").coalesce(1).write.parquet(src + "/b")
    stream = rollout_columns(ST.file_stream(spark, src + "/*/*.parquet", li.schema, max_files=1))
    out = ST.stream_path(spark, "mb_two") + "/data"
    _fb(spark, "mb_two", stream, ST.release_minibatches(stream, out, 16))
    res = spark.read.parquet(out)
    per_epoch = {r.epoch: (r.lo, r.hi) for r in res.groupBy("epoch").agg(
        F.min("minibatch").alias("lo"), F.max("minibatch").alias("hi")).collect()}
    assert sorted(per_epoch) == [0, 1]
    assert per_epoch[0][0] == 0 and per_epoch[1][0] == per_epoch[0][1] + 1


def test_foreach_batch_replay_is_idempotent(spark, sf_dir):
    from rollspark.sources.fixtures import rollouts
    from rollspark.streaming import rollouts as ST
    batch = rollouts(spark, sf_dir).select("uid", "sample_key", "reward")
    out = ST.stream_path(spark, "replay") + "/data"
    fn = ST.accumulate_kept_groups(batch, out, 10 ** 9)
    fn(batch, 0)
    first = spark.read.parquet(out).count()
    fn(batch, 0)  # the same micro-batch again, as after a restart
    assert spark.read.parquet(out).count() == first
    status = spark.read.parquet(out + "_status").collect()
    assert len(status) == 1
    fn(batch, 1)  # the next micro-batch counts on top of epoch 0 only
    totals = {r.epoch: r.kept_groups for r in spark.read.parquet(out + "_status").collect()}
    assert totals[1] == 2 * totals[0]


def test_eval_dump_sanitises_source_folders(spark):
    import os
    rows = spark.createDataFrame([(1, 1.0, "math/hard"), (2, 0.0, None), (3, 1.0, "qa")],
                                 "uid int, score double, data_source string")
    metrics = rows.groupBy().avg("score")
    path = S.scratch_path(spark, "eval_dump_test")
    S.dump_eval(rows, path, metrics)
    folders = sorted(f for f in os.listdir(os.path.join(path, "per_source")) if f.startswith("source_file="))
    assert folders == ["source_file=math_hard", "source_file=qa", "source_file=unknown"]
    back = {r.uid: r.source_file for r in S.read_eval_dump(spark, path).collect()}
    assert back == {1: "math_hard", 2: "unknown", 3: "qa"}
    assert spark.read.json(os.path.join(path, "aggregated_results")).count() == 1

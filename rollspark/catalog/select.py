"""Selection and reward shaping (F3-F9, O4, J8, V25-V27) over the rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.arrays import dsum
from rollspark.functions.cols import rnd
from rollspark.operators import rewards as RW
from rollspark.operators import select as S
from rollspark.sources.fixtures import rollouts, with_views


@query("drop_constant_groups", with_views("""
SELECT uid, sample_key FROM rollouts
WHERE uid IN (SELECT uid FROM rollouts GROUP BY uid HAVING min(reward) < max(reward))""", "rollouts"))
def q_drop_constant(spark, d):
    return S.drop_constant_groups(rollouts(spark, d)).select("uid", "sample_key")


@query("dynamic_filter_groups", with_views("""
SELECT uid, sample_key FROM rollouts
WHERE uid IN (SELECT uid FROM rollouts GROUP BY uid HAVING stddev_pop(reward) > 0)""", "rollouts"))
def q_dynamic_filter(spark, d):
    return S.dynamic_filter(rollouts(spark, d), n_samples_per_prompt=4).select("uid", "sample_key")


# current step 50, sampler step = resp_len, at most 8 steps off policy
@query("stale_rollout_split", with_views("""
SELECT uid, sample_key, CASE WHEN 50 - resp_len <= 8 THEN 'kept' ELSE 'requeue' END AS route
FROM rollouts""", "rollouts"))
def q_stale(spark, d):
    df = rollouts(spark, d).withColumn("step", F.lit(50)).withColumn("sampler_step", F.col("resp_len"))
    kept, requeue = S.split_stale(df, "step", "sampler_step", 8)
    return kept.select("uid", "sample_key", F.lit("kept").alias("route")).unionByName(
        requeue.select("uid", "sample_key", F.lit("requeue").alias("route")))


@query("overlong_filter", with_views("""
SELECT uid, sample_key,
       CAST(CASE WHEN len(response_ids) > 0 AND response_ids[-1] = 2 THEN list_sum(loss_mask) ELSE 0 END AS BIGINT) AS mask_sum,
       CAST(len(loss_mask) AS BIGINT) AS mask_len
FROM rollouts""", "rollouts"))
def q_overlong(spark, d):
    df = S.overlong_filter(rollouts(spark, d, with_tokens=True), eos_token_id=2)
    return df.select("uid", "sample_key", dsum("loss_mask").cast("bigint").alias("mask_sum"),
                     F.size("loss_mask").cast("bigint").alias("mask_len"))


@query("finish_reason_mask", with_views("""
SELECT uid, sample_key,
       CAST(CASE WHEN stop_reason = 'length' THEN 0 ELSE list_sum(loss_mask) END AS BIGINT) AS mask_sum
FROM rollouts""", "rollouts"))
def q_finish_mask(spark, d):
    df = rollouts(spark, d, with_tokens=True).withColumn(
        "finish_reason", F.when(F.col("stop_reason") == "length", "MAX_ITERATIONS_REACHED").otherwise("FINISH"))
    df = S.mask_by_finish_reason(df)
    return df.select("uid", "sample_key", dsum("loss_mask").cast("bigint").alias("mask_sum"))


@query("zero_reward_unless_stop", with_views("""
SELECT uid, sample_key, CASE WHEN stop_reason = 'stop' THEN reward ELSE 0.0 END AS reward
FROM rollouts""", "rollouts"))
def q_zero_unless_stop(spark, d):
    return S.zero_unless_stop(rollouts(spark, d)).select("uid", "sample_key", "reward")


@query("validate_rollouts", with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN len(loss_mask) <> len(response_ids) THEN 1 ELSE 0 END) AS BIGINT) AS bad_mask_len,
       CAST(sum(list_sum(loss_mask)) AS BIGINT) AS mask_total,
       CAST(sum(CASE WHEN len(rollout_logprobs) <> len(response_ids) THEN 1 ELSE 0 END) AS BIGINT) AS bad_logprob_len,
       coalesce(sum(list_sum(loss_mask)), 0) = 0 AS all_masked
FROM rollouts""", "rollouts"))
def q_validate(spark, d):
    rep = S.validate_rollouts(rollouts(spark, d, with_tokens=True), logprobs="rollout_logprobs")
    return rep.select(F.col("n_rows").cast("bigint").alias("n_rows"),
                      F.col("bad_mask_len").cast("bigint").alias("bad_mask_len"),
                      F.col("mask_total").cast("bigint").alias("mask_total"),
                      F.col("bad_logprob_len").cast("bigint").alias("bad_logprob_len"), "all_masked")


@query("rollout_violations", with_views("""
, b AS (SELECT uid, sample_key, resp_len, CASE WHEN resp_len % 7 = 0 THEN [] ELSE response_ids END AS r,
               CASE WHEN resp_len % 5 = 0 THEN list_slice(loss_mask, 1, 3) WHEN resp_len % 11 = 0 THEN list_transform(loss_mask, lambda m: 0) ELSE loss_mask END AS m,
               CASE WHEN resp_len % 3 = 0 THEN NULL WHEN resp_len % 13 = 0 THEN list_slice(rollout_logprobs, 2, len(rollout_logprobs)) ELSE rollout_logprobs END AS lp FROM rollouts)
SELECT uid, sample_key, 'empty_response' AS violation, CAST(len(r) AS BIGINT) AS found, CAST(len(r) AS BIGINT) AS expected FROM b WHERE len(r) = 0
UNION ALL SELECT uid, sample_key, 'mask_length', len(m), len(r) FROM b WHERE len(m) <> len(r)
UNION ALL SELECT uid, sample_key, 'all_masked', 0, len(r) FROM b WHERE coalesce(list_sum(m), 0) = 0
UNION ALL SELECT uid, sample_key, 'logprob_length', len(lp), len(r) FROM b WHERE lp IS NOT NULL AND len(lp) <> len(r)""", "rollouts"))
def q_violations(spark, d):
    n = F.col("resp_len")
    df = rollouts(spark, d, with_tokens=True).withColumns({
        "response_ids": F.when(n % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.col("response_ids")),
        "loss_mask": F.when(n % 5 == 0, F.slice("loss_mask", 1, 3)).when(n % 11 == 0, F.transform("loss_mask", lambda m: F.lit(0))).otherwise(F.col("loss_mask")),
        "rollout_logprobs": F.when(n % 3 == 0, None).when(n % 13 == 0, F.slice("rollout_logprobs", 2, F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.col("rollout_logprobs"))})
    return S.rollout_violations(df, logprobs="rollout_logprobs")


DS_TARGET, DS_N = 1000, 4
_KEPT = "kept AS (SELECT uid FROM rollouts GROUP BY uid HAVING stddev_pop(reward) > 0)"


@query("dynamic_sampling_cut", with_views(f""", {_KEPT},
first_groups AS (SELECT uid FROM kept ORDER BY uid LIMIT {DS_TARGET})
SELECT uid, sample_key FROM rollouts WHERE uid IN (SELECT uid FROM first_groups)
ORDER BY uid, sample_key LIMIT {DS_TARGET * DS_N}""", "rollouts"))
def q_ds_cut(spark, d):
    batch, _ = S.dynamic_sampling_cut(rollouts(spark, d), DS_TARGET, DS_N)
    return batch.select("uid", "sample_key")


@query("dynamic_sampling_status", with_views(f""", {_KEPT}
SELECT CAST(count(*) AS BIGINT) AS n_kept_groups, count(*) < {DS_TARGET} AS keep_sampling FROM kept""",
                                             "rollouts"))
def q_ds_status(spark, d):
    _, status = S.dynamic_sampling_cut(rollouts(spark, d), DS_TARGET, DS_N)
    return status


@query("replace_bad_groups", with_views("""
, st AS (SELECT uid, stddev_pop(reward) > 0 AS good, md5('0|' || CAST(uid AS VARCHAR)) AS h
        FROM rollouts GROUP BY uid),
cnt AS (SELECT sum(CASE WHEN good THEN 1 ELSE 0 END) AS n_good, count(*) AS n_groups FROM st),
g AS (SELECT uid AS partner, row_number() OVER (ORDER BY h) - 1 AS gr FROM st WHERE good),
b AS (SELECT uid, row_number() OVER (ORDER BY h) - 1 AS br FROM st WHERE NOT good),
pairs AS (SELECT b.uid, g.partner FROM b, cnt, g
          WHERE n_good > n_groups * 0.3 AND n_good > 0 AND g.gr = b.br % n_good),
bad_rows AS (SELECT r.*, p.partner FROM rollouts r JOIN pairs p USING (uid)),
repl AS (SELECT CASE WHEN q.uid IS NOT NULL THEN q.uid ELSE b.uid END AS uid,
                CASE WHEN q.uid IS NOT NULL THEN q.sample_key ELSE b.sample_key END AS sample_key,
                CASE WHEN q.uid IS NOT NULL THEN q.reward ELSE b.reward END AS reward,
                CASE WHEN q.uid IS NOT NULL THEN b.uid END AS replaced_uid
         FROM bad_rows b LEFT JOIN rollouts q ON q.uid = b.partner AND q.sample_idx = b.sample_idx)
SELECT uid, sample_key, reward, CAST(NULL AS BIGINT) AS replaced_uid FROM rollouts
WHERE uid NOT IN (SELECT uid FROM pairs)
UNION ALL SELECT * FROM repl""", "rollouts"))
def q_replace(spark, d):
    rows, _ = S.replace_bad_groups(rollouts(spark, d, with_index=True), DS_N, 0.3)
    return rows.select("uid", "sample_key", "reward", "replaced_uid")


@query("soft_overlong_reward", with_views(f"""
SELECT uid, sample_key,
       {R("CASE WHEN resp_len > 50 - prompt_len AND resp_len <= 60 - prompt_len "
          "THEN reward - CAST(resp_len - (50 - prompt_len) AS DOUBLE) / 10.0 * 1.0 "
          "WHEN resp_len > 60 - prompt_len THEN 0.0 ELSE reward END")} AS reward
FROM rollouts""", "rollouts"))
def q_soft_overlong(spark, d):
    df = RW.soft_overlong(rollouts(spark, d), max_context_length=60, buffer_len=10, penalty_factor=1.0)
    return df.select("uid", "sample_key", rnd("reward").alias("reward"))


@query("pgfc_reward", with_views(f"""
SELECT uid, sample_key, {R("CASE WHEN is_correct THEN 0.2 ELSE 0.2 - 1.0 END")} AS reward
FROM rollouts""", "rollouts"))
def q_pgfc(spark, d):
    return RW.pgfc_reward(rollouts(spark, d), 0.2).select("uid", "sample_key", rnd("reward").alias("reward"))


@query("problem_reward", with_views(f"""
SELECT uid, sample_key,
       {R("0.1 * (CASE WHEN stop_reason = 'stop' THEN 1.0 ELSE 0.0 END - 1.0) + CASE WHEN is_correct THEN 1.0 ELSE 0.0 END")} AS reward
FROM rollouts""", "rollouts"))
def q_problem_reward(spark, d):
    df = rollouts(spark, d).withColumn("format_ok", F.col("stop_reason") == "stop")
    return RW.problem_reward(df, 0.1).select("uid", "sample_key", rnd("reward").alias("reward"))


@query("representative_picks", with_views("""
, r AS (SELECT uid, sample_key, resp_len AS score,
               row_number() OVER (ORDER BY resp_len, md5('0|' || CAST(uid AS VARCHAR) || '|' || sample_key)) - 1 AS rk,
               count(*) OVER () AS n FROM rollouts),
p AS (SELECT i, CASE WHEN i = 9 THEN n - 1
                     ELSE CAST(floor(CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / CAST(9 AS DOUBLE))) AS BIGINT) END AS pos
      FROM (SELECT DISTINCT n FROM r), range(10) t(i))
SELECT CAST(p.i AS BIGINT) AS pick, r.uid, r.sample_key, r.score FROM r JOIN p ON r.rk = p.pos""", "rollouts"))
def q_representative(spark, d):
    r = rollouts(spark, d).select("uid", "sample_key", F.col("resp_len").alias("score"))
    return S.representative_picks(r, "score", ["uid", "sample_key"], 10).select("pick", "uid", "sample_key", "score")

"""Sequence queries (W1-W7, A5, A9) over conversation-derived transitions and
lineitem-derived rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.arrays import dsum
from rollspark.functions.cols import rnd
from rollspark.operators import advantages as ADV
from rollspark.operators import sequences as S
from rollspark.plans.batching import seeded_order
from rollspark.sources.fixtures import rollouts, transitions, with_views
from rollspark.sources.tables import table

_MERGE = """
, p AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY step) - 1 AS pos FROM transitions),
j AS (SELECT a.*, b.ob || b.ac AS prev_full FROM p a LEFT JOIN p b ON a.traj_id = b.traj_id AND a.pos = b.pos + 1),
k AS (SELECT *, prev_full IS NULL OR NOT (len(ob) >= len(prev_full) AND list_slice(ob, 1, len(prev_full)) = prev_full)
                AS is_new FROM j),
m AS (SELECT *, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY step) - 1 AS BIGINT)
                AS seq_no,
             CASE WHEN is_new THEN ob ELSE list_slice(ob, len(prev_full) + 1, len(ob)) END AS delta_ob FROM k)"""


@query("merge_turns", with_views(_MERGE + """
SELECT traj_id, step, seq_no, is_new, CAST(len(delta_ob) AS BIGINT) AS n_delta FROM m""", "transitions"))
def q_merge(spark, d):
    m = S.merge_turns(transitions(spark, d))
    return m.select("traj_id", "step", "seq_no", "is_new", F.size("delta_ob").cast("bigint").alias("n_delta"))


@query("training_sequences", with_views(_MERGE + f"""
, tot AS (SELECT group_id, traj_id, sum(reward) AS total FROM transitions GROUP BY 1, 2),
adv AS (SELECT traj_id, total - avg(total) OVER (PARTITION BY group_id) AS advantage FROM tot),
ch AS (SELECT m.traj_id, seq_no, step, delta_ob || ac AS tok,
              list_transform(delta_ob, lambda x: CAST(0 AS DOUBLE)) || ac_logprobs AS lp,
              list_transform(delta_ob, lambda x: CAST(0 AS DOUBLE)) || list_transform(ac, lambda x: advantage) AS av,
              list_transform(delta_ob, lambda x: CAST(0 AS DOUBLE)) || list_transform(ac, lambda x: CAST(1 AS DOUBLE)) AS mk
       FROM m JOIN adv USING (traj_id)),
sq AS (SELECT traj_id, seq_no, flatten(list(tok ORDER BY step)) AS tok, flatten(list(lp ORDER BY step)) AS lp,
              flatten(list(av ORDER BY step)) AS av, flatten(list(mk ORDER BY step)) AS mk FROM ch GROUP BY 1, 2)
SELECT traj_id, seq_no, CAST(greatest(len(tok) - 1, 0) AS BIGINT) AS n_tokens,
       md5(array_to_string(list_slice(tok, 2, len(tok)), ' ')) AS target_md5,
       {R("coalesce(list_sum(list_slice(mk, 2, len(mk))), 0)")} AS mask_sum,
       {R("coalesce(list_sum(list_slice(lp, 2, len(lp))), 0)")} AS logprob_sum,
       {R("coalesce(list_sum(list_slice(av, 2, len(av))), 0)")} AS advantage_sum
FROM sq""", "transitions"))
def q_training_sequences(spark, d):
    t = transitions(spark, d)
    tot = S.trajectory_totals(t)
    adv = ADV.group_centered(tot, group="group_id", score="total_reward", by_join=True).select("traj_id", "advantage")
    seqs = S.training_sequences(S.merge_turns(t).join(adv, "traj_id"))
    return seqs.select("traj_id", "seq_no", F.size("input_tokens").cast("bigint").alias("n_tokens"),
                       F.md5(F.array_join("target_tokens", " ")).alias("target_md5"),
                       rnd(dsum("mask")).alias("mask_sum"), rnd(dsum("logprobs")).alias("logprob_sum"),
                       rnd(dsum("advantages")).alias("advantage_sum"))


@query("training_sequences_cut", with_views(_MERGE + """
, sq AS (SELECT traj_id, seq_no, list_slice(flatten(list(delta_ob || ac ORDER BY step)), 1, 48) AS tok FROM m GROUP BY 1, 2)
SELECT traj_id, seq_no, CAST(greatest(len(tok) - 1, 0) AS BIGINT) AS n_tokens, md5(array_to_string(list_slice(tok, 1, len(tok) - 1), ' ')) AS input_md5 FROM sq""", "transitions"))
def q_training_sequences_cut(spark, d):
    merged = S.merge_turns(transitions(spark, d)).withColumn("advantage", F.lit(0.0))
    seqs = S.training_sequences(merged, max_length=48)
    return seqs.select("traj_id", "seq_no", F.size("input_tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("input_tokens", " ")).alias("input_md5"))


@query("trajectory_totals", with_views(f"""
SELECT group_id, traj_id, {R("sum(reward)")} AS total_reward, CAST(count(*) AS BIGINT) AS n_turns
FROM transitions GROUP BY 1, 2""", "transitions"))
def q_totals(spark, d):
    t = S.trajectory_totals(transitions(spark, d))
    return t.select("group_id", "traj_id", rnd("total_reward").alias("total_reward"),
                    F.col("n_turns").cast("bigint").alias("n_turns"))


@query("trajectory_metrics", with_views(f"""
, t AS (SELECT traj_id, count(*) AS turns, sum(len(ac)) AS ac_tokens, sum(len(ob)) AS ob_tokens,
              sum(reward) AS total_reward, arg_max(reward, step) AS last_reward FROM transitions GROUP BY 1)
SELECT {R("sum(ac_tokens) / sum(turns)")} AS ac_tokens_per_turn, {R("sum(ob_tokens) / sum(turns)")} AS ob_tokens_per_turn,
       {R("avg(turns)")} AS turns_per_episode, CAST(sum(ac_tokens) AS BIGINT) AS total_ac_tokens,
       CAST(sum(ob_tokens) AS BIGINT) AS total_ob_tokens, {R("avg(total_reward)")} AS reward_total,
       {R("avg(CASE WHEN last_reward = 1 THEN 1.0 ELSE 0.0 END)")} AS correct FROM t""", "transitions"))
def q_traj_metrics(spark, d):
    m = S.trajectory_metrics(transitions(spark, d))
    return m.select(rnd("ac_tokens_per_turn").alias("ac_tokens_per_turn"),
                    rnd("ob_tokens_per_turn").alias("ob_tokens_per_turn"),
                    rnd("turns_per_episode").alias("turns_per_episode"),
                    F.col("total_ac_tokens").cast("bigint").alias("total_ac_tokens"),
                    F.col("total_ob_tokens").cast("bigint").alias("total_ob_tokens"),
                    rnd("reward_total").alias("reward_total"), rnd("correct").alias("correct"))


@query("truncate_prompt_tokens", """
SELECT conv_id, turn, md5(array_to_string(list_slice(string_split(text, ' '), 1, 32), ' ')) AS head_md5,
       CAST(len(list_slice(string_split(text, ' '), 1, 32)) AS BIGINT) AS n_tokens
FROM conversations""")
def q_truncate(spark, d):
    c = table(spark, d, "conversations")
    head = S.truncate_tokens("text", 32)
    return c.select("conv_id", "turn", F.md5(F.array_join(head, " ")).alias("head_md5"),
                    F.size(head).cast("bigint").alias("n_tokens"))


@query("pad_unpad_roundtrip", with_views("""
, r AS (SELECT uid, sample_key, prompt_len, resp_len,
              CAST(floor((row_number() OVER (ORDER BY md5('0|' || CAST(uid AS VARCHAR) || '|' || sample_key), uid, sample_key) - 1) / 64) AS BIGINT) AS batch_id
        FROM rollouts),
mx AS (SELECT batch_id, max(prompt_len) AS mp, max(resp_len) AS mr FROM r GROUP BY 1)
SELECT uid, sample_key, batch_id, CAST(mp - prompt_len AS BIGINT) AS left_pad, CAST(mr - resp_len AS BIGINT) AS right_pad,
       true AS roundtrip_ok
FROM r JOIN mx USING (batch_id)""", "rollouts"))
def q_pad(spark, d):
    r = rollouts(spark, d, with_tokens=True).withColumn(
        "prompt_ids", F.transform(F.when(F.col("prompt_len") >= 1, F.sequence(F.lit(1).cast("bigint"), "prompt_len"))
                   .otherwise(F.array().cast("array<bigint>")), lambda i: i + 100))
    r = seeded_order(r, ["uid", "sample_key"], whole=64).withColumn("batch_id", F.floor(F.col("idx") / 64).cast("bigint"))
    p = S.unpad(S.pad_batch(r, within="part"))
    ok = (F.col("prompt_unpadded") == F.col("prompt_ids")) & \
        (F.col("response_unpadded") == F.col("response_ids").cast("array<bigint>"))
    return p.select("uid", "sample_key", "batch_id",
                    (F.size("prompt_padded") - F.size("prompt_ids")).cast("bigint").alias("left_pad"),
                    (F.size("response_padded") - F.size("response_ids")).cast("bigint").alias("right_pad"),
                    ok.alias("roundtrip_ok"))

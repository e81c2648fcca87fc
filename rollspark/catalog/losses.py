"""KL, policy/value loss and report queries.

Inputs: lineitem-derived rollouts with token arrays. Trainer log-probs =
``log_probs``, sampler / old log-probs = ``rollout_logprobs``, reference (base
or teacher) = ``base_log_probs``; token advantages = ``values - 0.6``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.arrays import dsum, masked_mean, masked_sum
from rollspark.functions.cols import rnd
from rollspark.operators import losses as L
from rollspark.sources.fixtures import rollouts, with_views

ADV_SHIFT = 0.6


def _tok(spark, d, source=False):
    df = rollouts(spark, d, with_tokens=True, with_source=source)
    return df.withColumn("adv", F.transform("values", lambda v: v - F.lit(ADV_SHIFT)))


_CELLS = f"""
, cells AS (SELECT uid, sample_key, data_source, unnest(generate_series(1, len(log_probs))) AS k,
                  unnest(log_probs) AS lp, unnest(rollout_logprobs) AS old, unnest(base_log_probs) AS b,
                  unnest("values") AS v, unnest("values") - {ADV_SHIFT} AS adv,
                  unnest(loss_mask) AS m FROM rollouts)"""

K3 = "least(greatest(exp(least(greatest(b - lp, -20.0), 20.0)) - least(greatest(b - lp, -20.0), 20.0) - 1, -10.0), 10.0)"


@query("approx_kl", with_views(_CELLS + f"""
SELECT uid, sample_key, {R("sum((lp - b) * m)")} AS kl_k1, {R("sum(abs(lp - b) * m)")} AS kl_abs,
       {R("sum(0.5 * (lp - b) * (lp - b) * m)")} AS kl_k2, {R(f"sum({K3} * m)")} AS kl_k3
FROM cells GROUP BY uid, sample_key""", "rollouts"))
def q_approx_kl(spark, d):
    df = _tok(spark, d)
    return df.select("uid", "sample_key", *[
        rnd(dsum(L.approx_kl("log_probs", "base_log_probs", "loss_mask", k))).alias(f"kl_{k}")
        for k in ("k1", "abs", "k2", "k3")])


@query("kl_penalized_rewards", with_views(_CELLS + f"""
SELECT uid, sample_key, {R("sum(v - (lp - b) * m * 0.1)")} AS reward_sum
FROM cells GROUP BY uid, sample_key""", "rollouts"))
def q_kl_rewards(spark, d):
    df = _tok(spark, d)
    kl = L.approx_kl("log_probs", "base_log_probs", "loss_mask", "k1")
    return df.select("uid", "sample_key", rnd(dsum(L.kl_penalized_rewards("values", kl, 0.1))).alias("reward_sum"))


@query("kl_loss_term", with_views(_CELLS + f"""
, r AS (SELECT uid, sample_key, sum({K3} * m) / greatest(sum(m), 1) AS km FROM cells GROUP BY 1, 2)
SELECT {R("0.01 * avg(km)")} AS kl_loss FROM r""", "rollouts"))
def q_kl_loss(spark, d):
    df = _tok(spark, d)
    kl = L.approx_kl("log_probs", "base_log_probs", None, "k3")
    return df.agg(rnd(F.lit(0.01) * F.avg(masked_mean(kl, "loss_mask"))).alias("kl_loss"))


def _ppo_sql(loss_expr: str, clip_expr: str, reductions=("token_mean", "sequence_mean", "seq_mean_token_sum_norm"),
             extra_cte: str = "") -> str:
    parts = []
    for red in reductions:
        if red == "token_mean":
            lv = "sum(l * m) / greatest(sum(m), 1)"
            src = "t"
        elif red == "sequence_mean":
            lv = "avg(ls / greatest(mc, 1))"
            src = "rows_"
        else:
            lv = "avg(ls / 64.0)"
            src = "rows_"
        parts.append(f"SELECT '{red}' AS reduction, {R(lv)} AS loss, "
                     f"(SELECT {R('sum(c * m) / greatest(sum(m), 1)')} FROM t) AS clip_ratio FROM {src}")
    return with_views(_CELLS + extra_cte + f"""
, t AS (SELECT *, {loss_expr} AS l, {clip_expr} AS c FROM cells{' JOIN seq USING (uid, sample_key)' if extra_cte else ''}),
rows_ AS (SELECT uid, sample_key, sum(l * m) AS ls, sum(m) AS mc FROM t GROUP BY 1, 2)
""" + "\nUNION ALL\n".join(parts), "rollouts")


_RATIO = "exp(lp - old)"
_S1 = f"({_RATIO} * adv)"
_S2 = f"(least(greatest({_RATIO}, 0.8), 1.2) * adv)"
PPO_LOSS = f"(-least({_S1}, {_S2}))"
PPO_CLIP = f"(CASE WHEN -{_S2} > -{_S1} THEN 1.0 ELSE 0.0 END)"


def _reduced(df, loss, clip, reductions, max_seq_len=64):
    out = L.reduce_tokens_many(df, loss, "loss_mask", reductions, max_seq_len, clip=clip)
    return out.select("reduction", rnd("loss").alias("loss"), rnd("clip_ratio").alias("clip_ratio"))


@query("ppo_policy_loss", _ppo_sql(PPO_LOSS, PPO_CLIP))
def q_ppo(spark, d):
    df = _tok(spark, d)
    loss, clip = L.ppo_tokens("log_probs", "rollout_logprobs", "adv")
    return _reduced(df, loss, clip, ("token_mean", "sequence_mean", "seq_mean_token_sum_norm"))


@query("dual_clip_policy_loss", _ppo_sql(f"(CASE WHEN adv < 0 THEN least(-adv * 3.0, {PPO_LOSS}) ELSE {PPO_LOSS} END)",
                                         PPO_CLIP, ("token_mean",)))
def q_dual_clip(spark, d):
    df = _tok(spark, d)
    loss, clip = L.ppo_tokens("log_probs", "rollout_logprobs", "adv", dual_clip=3.0)
    return _reduced(df, loss, clip, ("token_mean",))


@query("tis_policy_loss", _ppo_sql(f"({PPO_LOSS} * least(exp(old - b), 2.0))", PPO_CLIP, ("token_mean",)))
def q_tis(spark, d):
    df = _tok(spark, d)
    loss, clip = L.ppo_tokens("log_probs", "rollout_logprobs", "adv")
    w = L.tis_weights("rollout_logprobs", "base_log_probs", 2.0)
    return _reduced(df, F.zip_with(loss, w, lambda a, b: a * b), clip, ("token_mean",))


_GSPO_SEQ = """
, seq AS (SELECT uid, sample_key, exp(least(sum((lp - old) * m) / greatest(sum(m), 1), 10.0)) AS sr
          FROM cells GROUP BY 1, 2)"""
_GS1 = "(sr * adv)"
_GS2 = "(least(greatest(sr, 1 - 3e-4), 1 + 4e-4) * adv)"


@query("gspo_policy_loss", _ppo_sql(f"(-least({_GS1}, {_GS2}))", f"(CASE WHEN -{_GS2} > -{_GS1} THEN 1.0 ELSE 0.0 END)",
                                    ("sequence_mean",), extra_cte=_GSPO_SEQ))
def q_gspo(spark, d):
    df = _tok(spark, d).withColumn("seq_ratio", L.gspo_seq_ratio("log_probs", "rollout_logprobs", "loss_mask"))
    loss, clip = L.gspo_tokens("adv", "seq_ratio")
    return _reduced(df, loss, clip, ("sequence_mean",))


_TAU = "(CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END)"


@query("sapo_policy_loss", _ppo_sql(f"(-(1.0 / (1.0 + exp(-{_TAU} * ({_RATIO} - 1))) * 4.0 / {_TAU}) * adv)", "0.0",
                                    ("sequence_mean",)))
def q_sapo(spark, d):
    df = _tok(spark, d)
    loss = L.sapo_tokens("log_probs", "rollout_logprobs", "adv")
    return _reduced(df, loss, F.transform("adv", lambda a: F.lit(0.0)), ("sequence_mean",))


@query("reinforce_loss", _ppo_sql("(-lp * adv)", "0.0", ("token_mean",)))
def q_reinforce(spark, d):
    df = _tok(spark, d)
    return _reduced(df, L.reinforce_tokens("log_probs", "adv"), F.transform("adv", lambda a: F.lit(0.0)),
                    ("token_mean",))


@query("service_losses", with_views(_CELLS + f"""
SELECT {R("sum(-lp * m)", 2)} AS cross_entropy, {R("sum(-(exp(lp - old) * adv))", 2)} AS importance_sampling,
       {R("sum(-(least(greatest(exp(lp - old), 0.8), 1.2) * lp * adv))", 2)} AS cispo,
       {R("sum(-(lp * adv - 0.05 * (lp - old) * (lp - old)))", 2)} AS dro
FROM cells""", "rollouts"))
def q_service_losses(spark, d):
    df = _tok(spark, d)
    return df.agg(
        rnd(F.sum(dsum(L.cross_entropy_tokens("log_probs", "loss_mask"))), 2).alias("cross_entropy"),
        rnd(F.sum(dsum(L.importance_sampling_tokens("log_probs", "rollout_logprobs", "adv"))), 2)
        .alias("importance_sampling"),
        rnd(F.sum(dsum(L.cispo_tokens("log_probs", "rollout_logprobs", "adv", 0.8, 1.2))), 2).alias("cispo"),
        rnd(F.sum(dsum(L.dro_tokens("log_probs", "rollout_logprobs", "adv", 0.1))), 2).alias("dro"))


@query("value_loss", with_views(_CELLS + f"""
, t AS (SELECT *, greatest(((v - 0.1) + 0.05 + b) * ((v - 0.1) + 0.05 + b),
                          (v + b) * (v + b)) AS l,
              CASE WHEN ((v - 0.1) + 0.05 + b) * ((v - 0.1) + 0.05 + b) > (v + b) * (v + b) THEN 1.0 ELSE 0.0 END AS c FROM cells),
r AS (SELECT uid, sample_key, sum(l * m) / greatest(sum(m), 1) AS lm FROM t GROUP BY 1, 2)
SELECT {R("0.5 * avg(lm)")} AS value_loss, (SELECT {R("sum(c * m) / greatest(sum(m), 1)")} FROM t) AS clipfrac
FROM r""", "rollouts"))
def q_value_loss(spark, d):
    df = _tok(spark, d).withColumn("old_values", F.transform("values", lambda v: v - 0.1)) \
        .withColumn("returns", F.transform("base_log_probs", lambda b: -b))
    loss, clip = L.value_loss_tokens("values", "old_values", "returns", 0.05)
    return df.agg(rnd(F.lit(0.5) * F.avg(masked_mean(loss, "loss_mask"))).alias("value_loss"),
                  rnd(F.sum(masked_sum(clip, "loss_mask")) / F.sum(dsum("loss_mask"))).alias("clipfrac"))


@query("kl_sample_train", with_views(_CELLS + f"""
SELECT {R("avg(old - lp)")} AS kl_v1, {R("0.5 * avg((old - lp) * (old - lp))")} AS kl_v2,
       {R("-avg(old)")} AS entropy, CAST(count(*) AS BIGINT) AS n_tokens FROM cells WHERE m > 0""", "rollouts"))
def q_kl_sample_train(spark, d):
    out = L.kl_sample_train(_tok(spark, d), "rollout_logprobs", "log_probs", "loss_mask")
    return out.select(rnd("kl_v1").alias("kl_v1"), rnd("kl_v2").alias("kl_v2"), rnd("entropy").alias("entropy"),
                      F.col("n_tokens").cast("bigint").alias("n_tokens"))


@query("kl_pre_post_update", with_views(_CELLS + f"""
SELECT {R("avg(lp - b)")} AS kl_v1, {R("0.5 * avg((lp - b) * (lp - b))")} AS kl_v2 FROM cells WHERE m > 0""",
                                        "rollouts"))
def q_kl_pre_post(spark, d):
    out = L.kl_sample_train(_tok(spark, d), "log_probs", "base_log_probs", "loss_mask")
    return out.select(rnd("kl_v1").alias("kl_v1"), rnd("kl_v2").alias("kl_v2"))


@query("teacher_kl_by_dataset", with_views(_CELLS + f"""
SELECT CASE WHEN grouping(data_source) = 1 THEN 'overall' ELSE data_source END AS data_source,
       {R("sum((lp - b) * m) / sum(m)")} AS teacher_kl
FROM cells GROUP BY GROUPING SETS ((data_source), ())""", "rollouts"))
def q_teacher_kl(spark, d):
    out = L.teacher_kl(_tok(spark, d, source=True), "log_probs", "base_log_probs", "loss_mask")
    return out.select("data_source", rnd("teacher_kl").alias("teacher_kl"))


@query("prob_gap", with_views(_CELLS + f"""
SELECT {R("avg(abs(exp(old) - exp(lp)))")} AS prob_diff_mean, {R("stddev_samp(abs(exp(old) - exp(lp)))")} AS prob_diff_std
FROM cells WHERE m > 0""", "rollouts"))
def q_prob_gap(spark, d):
    out = L.prob_gap(_tok(spark, d), "rollout_logprobs", "log_probs", "loss_mask")
    return out.select(rnd("prob_diff_mean").alias("prob_diff_mean"), rnd("prob_diff_std").alias("prob_diff_std"))


@query("prob_gap_padded", with_views(_CELLS + f"""
, g AS (SELECT abs(exp(old) - exp(lp)) AS g FROM cells),
pad AS (SELECT count(*) * max(len(loss_mask)) - sum(len(loss_mask)) AS n FROM rollouts),
allc AS (SELECT g FROM g UNION ALL SELECT 0.0 FROM pad, range(CAST(pad.n AS BIGINT)))
SELECT {R("avg(g)")} AS prob_diff_mean, {R("stddev_samp(g)")} AS prob_diff_std FROM allc""", "rollouts"))
def q_prob_gap_padded(spark, d):
    out = L.prob_gap(_tok(spark, d), "rollout_logprobs", "log_probs", "loss_mask", padded=True)
    return out.select(rnd("prob_diff_mean").alias("prob_diff_mean"), rnd("prob_diff_std").alias("prob_diff_std"))


@query("kl_reward_stats", with_views(_CELLS + f"""
, r AS (SELECT uid, sample_key, sum((lp - b) * m) / greatest(sum(m), 1) AS km, max(abs((lp - b) * m)) AS kx
        FROM cells GROUP BY 1, 2)
SELECT {R("avg(km)")} AS avg_kl, {R("avg(kx)")} AS avg_kl_max FROM r""", "rollouts"))
def q_kl_reward_stats(spark, d):
    df = _tok(spark, d).withColumn("kl", L.approx_kl("log_probs", "base_log_probs", "loss_mask", "k1"))
    out = L.kl_reward_stats(df, "kl", "loss_mask")
    return out.select(rnd("avg_kl").alias("avg_kl"), rnd("avg_kl_max").alias("avg_kl_max"))


@query("advantage_stats", with_views(_CELLS + f"""
SELECT (SELECT {R('avg(list_sum("values"))')} FROM rollouts) AS avg_rewards, {R("avg(adv)")} AS avg_advantages,
       {R("avg(abs(adv))")} AS avg_advantages_abs FROM cells WHERE m > 0""", "rollouts"))
def q_adv_stats(spark, d):
    out = L.advantage_stats(_tok(spark, d), "values", "adv", "loss_mask")
    return out.select(*[rnd(c).alias(c) for c in ("avg_rewards", "avg_advantages", "avg_advantages_abs")])


@query("weighted_nll", with_views(_CELLS + f"""
SELECT {R("-sum(lp * m) / sum(m)")} AS nll FROM cells""", "rollouts"))
def q_nll(spark, d):
    return L.weighted_nll(_tok(spark, d), "log_probs", "loss_mask").select(rnd("nll").alias("nll"))

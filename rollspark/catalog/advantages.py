"""Advantage estimators (V1-V9) over the lineitem-derived rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.arrays import dsum
from rollspark.functions.cols import array_sums, array_wsum, rnd
from rollspark.operators import advantages as ADV
from rollspark.sources.fixtures import rollouts, with_views

_STATS = """g AS (SELECT uid, count(*) AS g_n, avg(reward) AS g_mean,
                 stddev_samp(reward) AS g_std FROM rollouts GROUP BY uid)"""


def _adv_out(df):
    return df.select("uid", "sample_key", rnd("advantage").alias("advantage"),
                     rnd(dsum("advantage_tokens")).alias("adv_token_sum"))


@query("grpo_advantage", with_views(f""", {_STATS}
SELECT r.uid, r.sample_key,
       {R("CASE WHEN g_n = 1 THEN reward / (1.0 + 1e-6) ELSE (reward - g_mean) / (g_std + 1e-6) END")} AS advantage,
       {R("(CASE WHEN g_n = 1 THEN reward / (1.0 + 1e-6) ELSE (reward - g_mean) / (g_std + 1e-6) END) * list_sum(loss_mask)")} AS adv_token_sum
FROM rollouts r JOIN g USING (uid)""", "rollouts"))
def q_grpo(spark, d):
    df = rollouts(spark, d, with_tokens=True)
    return _adv_out(ADV.grpo(df, mask="loss_mask"))


@query("grpo_no_std_advantage", with_views(f""", {_STATS}
SELECT r.uid, r.sample_key,
       {R("CASE WHEN g_n = 1 THEN reward ELSE reward - g_mean END")} AS advantage,
       {R("(CASE WHEN g_n = 1 THEN reward ELSE reward - g_mean END) * list_sum(loss_mask)")} AS adv_token_sum
FROM rollouts r JOIN g USING (uid)""", "rollouts"))
def q_grpo_no_std(spark, d):
    df = rollouts(spark, d, with_tokens=True)
    return _adv_out(ADV.grpo(df, norm_by_std=False, mask="loss_mask"))


@query("rloo_advantage", with_views(f""", {_STATS}
SELECT r.uid, r.sample_key,
       {R("CASE WHEN g_n = 1 THEN 0.0 ELSE (reward - g_mean) * g_n / (g_n - 1) END")} AS advantage,
       {R("(CASE WHEN g_n = 1 THEN 0.0 ELSE (reward - g_mean) * g_n / (g_n - 1) END) * list_sum(loss_mask)")} AS adv_token_sum
FROM rollouts r JOIN g USING (uid)""", "rollouts"))
def q_rloo(spark, d):
    df = rollouts(spark, d, with_tokens=True)
    return _adv_out(ADV.rloo(df, mask="loss_mask"))


@query("group_centered_advantage", with_views(f""", {_STATS}
SELECT r.uid, r.sample_key, {R("reward - g_mean")} AS advantage
FROM rollouts r JOIN g USING (uid)""", "rollouts"))
def q_centered(spark, d):
    df = rollouts(spark, d)
    return ADV.group_centered(df).select("uid", "sample_key", rnd("advantage").alias("advantage"))


@query("batch_mean_advantage", with_views(f"""
SELECT uid, sample_key, {R("reward - (SELECT avg(reward) FROM rollouts)")} AS advantage
FROM rollouts""", "rollouts"))
def q_batch_mean(spark, d):
    df = rollouts(spark, d)
    return ADV.batch_mean_baseline(df).select("uid", "sample_key", rnd("advantage").alias("advantage"))


# --- token-level estimators: long form in SQL (position k, 1-based) --------

_CELLS = """cells AS (
  SELECT uid, sample_key, k, r, v, m,
         sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY uid, sample_key ORDER BY k
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zc
  FROM (SELECT uid, sample_key, unnest(generate_series(1, len("values"))) AS k,
               unnest("values") AS r, unnest("values") AS v, unnest(loss_mask) AS m FROM rollouts))"""

GAMMA_RPP = 0.9


@query("reinforce_pp_advantage", with_views(f""", {_CELLS},
ret AS (
  SELECT *, power({GAMMA_RPP}, -k) * sum(power({GAMMA_RPP}, k) * r) OVER (
      PARTITION BY uid, sample_key, zc ORDER BY k DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ret FROM cells),
st AS (SELECT sum(ret * m) / sum(m) AS mu,
              (sum(ret * ret * m) - sum(ret * m) * sum(ret * m) / sum(m)) / (sum(m) - 1) AS var FROM ret)
SELECT uid, sample_key, {R("sum(ret)", 4)} AS ret_sum, {R("sum(ret * k)", 4)} AS ret_wsum,
       {R("sum((ret - mu) / sqrt(var + 1e-8) * m)", 4)} AS adv_sum,
       {R("sum((ret - mu) / sqrt(var + 1e-8) * m * k)", 4)} AS adv_wsum
FROM ret, st GROUP BY uid, sample_key""", "rollouts"))
def q_reinforce_pp(spark, d):
    df = rollouts(spark, d, with_tokens=True).select("uid", "sample_key", "values", "loss_mask")
    out = ADV.reinforce_pp(df, "values", "loss_mask", gamma=GAMMA_RPP)
    out = out.select("uid", "sample_key", array_sums("returns").alias("ret"), array_sums("advantage_tokens").alias("adv"))
    return out.select("uid", "sample_key", *[rnd(f"{x}.{y}", 4).alias(f"{x}_{y}") for x in ("ret", "adv") for y in ("sum", "wsum")])


GAE_GAMMA, GAE_LAMBDA = 1.0, 0.95


@query("gae_advantage", with_views(f""", {_CELLS},
dl AS (SELECT *, r + {GAE_GAMMA} * coalesce(lead(v) OVER (PARTITION BY uid, sample_key ORDER BY k), 0.0) - v AS delta
       FROM cells),
adv AS (SELECT *, power({GAE_GAMMA * GAE_LAMBDA}, -k) * sum(power({GAE_GAMMA * GAE_LAMBDA}, k) * delta) OVER (
      PARTITION BY uid, sample_key ORDER BY k DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM dl),
st AS (SELECT sum(a * m) / sum(m) AS mu,
              (sum(a * a * m) - sum(a * m) * sum(a * m) / sum(m)) / (sum(m) - 1) AS var FROM adv)
SELECT uid, sample_key, {R("sum(a + v)", 4)} AS ret_sum,
       {R("sum((a - mu) / sqrt(var + 1e-8))", 4)} AS adv_sum,
       {R("sum((a - mu) / sqrt(var + 1e-8) * k)", 4)} AS adv_wsum
FROM adv, st GROUP BY uid, sample_key""", "rollouts"))
def q_gae(spark, d):
    df = rollouts(spark, d, with_tokens=True).select("uid", "sample_key", "values", "loss_mask")
    out = ADV.gae(df, "values", "values", "loss_mask", gamma=GAE_GAMMA, lam=GAE_LAMBDA)
    return out.select("uid", "sample_key", rnd(dsum("returns"), 4).alias("ret_sum"),
                      rnd(dsum("advantage_tokens"), 4).alias("adv_sum"),
                      rnd(array_wsum("advantage_tokens"), 4).alias("adv_wsum"))


@query("normalized_advantages", with_views(f""", {_STATS},
a AS (SELECT r.uid, r.sample_key, r.loss_mask,
             CASE WHEN g_n = 1 THEN 0.0 ELSE (reward - g_mean) * g_n / (g_n - 1) END AS adv
      FROM rollouts r JOIN g USING (uid)),
c AS (SELECT uid, sample_key, adv, unnest(loss_mask) AS m, unnest(generate_series(1, len(loss_mask))) AS k FROM a),
st0 AS (SELECT sum(adv * m) AS sa, sum(adv * m) AS sam, sum(adv * adv * m) AS sa2m, sum(m) AS sm FROM c),
dims AS (SELECT count(*) AS nrows, max(len(loss_mask)) AS maxlen FROM a),
st AS (SELECT sa / (nrows * maxlen) AS mu, sam, sa2m, sm FROM st0, dims),
st2 AS (SELECT mu, 1.0 / sqrt(greatest((sa2m - 2 * mu * sam + mu * mu * sm) / sm, 1e-8)) AS rstd FROM st)
SELECT uid, sample_key, {R("sum((adv * m - mu) * rstd)")} AS adv_sum,
       {R("sum((adv * m - mu) * rstd * k)")} AS adv_wsum
FROM c, st2 GROUP BY uid, sample_key""", "rollouts"))
def q_normalized(spark, d):
    df = ADV.rloo(rollouts(spark, d, with_tokens=True).select("uid", "sample_key", "reward", "loss_mask"), mask="loss_mask")
    out = ADV.normalize_advantages(df, "advantage_tokens", "loss_mask")
    return out.select("uid", "sample_key", rnd(dsum("advantage_tokens")).alias("adv_sum"),
                      rnd(array_wsum("advantage_tokens")).alias("adv_wsum"))


@query("masked_whiten_stats", with_views(f"""
, c AS (SELECT unnest(log_probs) AS v, unnest(loss_mask) AS m FROM rollouts)
SELECT {R("sum(v * m) / sum(m)")} AS w_mean,
       {R("(sum(v * v * m) - sum(v * m) * sum(v * m) / sum(m)) / (sum(m) - 1)")} AS w_var,
       {R("sum(m)")} AS w_count
FROM c""", "rollouts"))
def q_whiten_stats(spark, d):
    st = ADV.masked_batch_stats(rollouts(spark, d, with_tokens=True), "log_probs", "loss_mask")
    return st.select(rnd("w_mean").alias("w_mean"), rnd("w_var").alias("w_var"), rnd("w_count").alias("w_count"))


@query("token_rewards_last", with_views(f"""
SELECT uid, sample_key, CAST(len(response_ids) AS BIGINT) AS n_tokens,
       {R("reward")} AS last_reward, {R("reward * len(response_ids)")} AS wsum
FROM rollouts""", "rollouts"))
def q_token_rewards(spark, d):
    df = ADV.sequence_to_token_rewards(rollouts(spark, d, with_tokens=True), "reward", "response_ids")
    return df.select("uid", "sample_key", F.size("token_rewards").cast("bigint").alias("n_tokens"),
                     rnd(F.try_element_at("token_rewards", F.lit(-1))).alias("last_reward"),
                     rnd(array_wsum("token_rewards")).alias("wsum"))


@query("advantage_registry", with_views(f""", {_STATS},
a AS (SELECT r.uid, r.sample_key, reward, g_n, g_mean, g_std, avg(reward) OVER () AS b_mean FROM rollouts r JOIN g USING (uid))
SELECT 'grpo' AS estimator, uid, sample_key, {R("CASE WHEN g_n = 1 THEN reward / (1.0 + 1e-6) ELSE (reward - g_mean) / (g_std + 1e-6) END")} AS advantage FROM a
UNION ALL SELECT 'rloo', uid, sample_key, {R("CASE WHEN g_n = 1 THEN 0.0 ELSE (reward - g_mean) * g_n / (g_n - 1) END")} FROM a
UNION ALL SELECT 'group_centered', uid, sample_key, {R("reward - g_mean")} FROM a
UNION ALL SELECT 'batch_mean', uid, sample_key, {R("reward - b_mean")} FROM a""", "rollouts"))
def q_registry(spark, d):
    """The sequence-level estimators by their registered names."""
    from functools import reduce
    df = rollouts(spark, d).select("uid", "sample_key", "reward")
    parts = [ADV.get_estimator(n)(df).select(F.lit(n).alias("estimator"), "uid", "sample_key", rnd("advantage").alias("advantage"))
             for n in ADV.list_estimators() if n in ("grpo", "rloo", "group_centered", "batch_mean")]
    return reduce(lambda a, b: a.unionByName(b), parts)

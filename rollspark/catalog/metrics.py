"""Rollout reports (A1-A4) over the lineitem-derived rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.cols import rnd
from rollspark.operators import metrics as M
from rollspark.sources.fixtures import rollouts, with_views

PASS_AT_N_SQL = with_views(f"""
, u AS (SELECT coalesce(replace(data_source, '/', '_'), 'unknown') AS src, uid,
              sum(reward) AS r_sum, count(*) AS r_n FROM rollouts GROUP BY 1, 2)
SELECT CASE WHEN grouping(src) = 1 THEN 'overall' ELSE src END AS data_source,
       {R("sum(r_sum) / sum(r_n)")} AS avg_score,
       {R("avg(CASE WHEN r_sum > 0 THEN 1.0 ELSE 0.0 END)")} AS pass_at_n,
       CAST(count(*) AS BIGINT) AS n_prompts, CAST(sum(r_n) AS BIGINT) AS n_samples
FROM u GROUP BY GROUPING SETS ((src), ())""", "rollouts")


def pass_at_n_by_source(spark, d):
    df = rollouts(spark, d, with_source=True)
    out = M.pass_at_n(df, source="data_source")
    return out.select("data_source", rnd("avg_score").alias("avg_score"),
                      rnd("pass_at_n").alias("pass_at_n"), "n_prompts", "n_samples")


query("pass_at_n_by_source", PASS_AT_N_SQL)(pass_at_n_by_source)


@query("rollout_length_metrics", with_views(f"""
SELECT {R("min(resp_len)")} AS min_num_tokens, {R("max(resp_len)")} AS max_num_tokens,
       {R("avg(resp_len)")} AS avg_num_tokens, {R("stddev_pop(resp_len)")} AS std_num_tokens,
       {R("coalesce(avg(CASE WHEN reward > 0 THEN resp_len END), 0.0)")} AS avg_tokens_non_zero_rewards,
       {R("coalesce(avg(CASE WHEN reward = 0 THEN resp_len END), 0.0)")} AS avg_tokens_zero_rewards,
       {R("coalesce(avg(CASE WHEN reward < 0 THEN resp_len END), 0.0)")} AS avg_tokens_negative_rewards
FROM rollouts""", "rollouts"))
def q_lengths(spark, d):
    out = M.rollout_length_metrics(rollouts(spark, d))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("group_mix", with_views(f"""
, g AS (SELECT uid, min(reward) AS mn, max(reward) AS mx FROM rollouts GROUP BY uid)
SELECT {R("avg(CASE WHEN mn = mx AND mn >= 0.5 THEN 1.0 ELSE 0.0 END)")} AS frac_all_good,
       {R("avg(CASE WHEN mn = mx AND mn < 0.5 THEN 1.0 ELSE 0.0 END)")} AS frac_all_bad,
       {R("avg(CASE WHEN mn <> mx THEN 1.0 ELSE 0.0 END)")} AS frac_mixed,
       CAST(count(*) AS BIGINT) AS n_groups
FROM g""", "rollouts"))
def q_group_mix(spark, d):
    out = M.group_mix(rollouts(spark, d))
    return out.select(rnd("frac_all_good").alias("frac_all_good"), rnd("frac_all_bad").alias("frac_all_bad"),
                      rnd("frac_mixed").alias("frac_mixed"), "n_groups")

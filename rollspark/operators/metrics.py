"""Reports over rollouts, trajectories and labels.

Every report is an aggregation: a partial (map-side) aggregate per group, then
a small second level. Overall rows come from GROUPING SETS in the same pass
rather than a second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollspark.functions.cols import col, with_scalars


def sanitize_source(c) -> "F.Column":
    """NULL -> 'unknown', '/' -> '_' (P15)."""
    return F.coalesce(F.replace(col(c), F.lit("/"), F.lit("_")), F.lit("unknown"))


def uid_rollup(df: DataFrame, uid="uid", reward="reward", source=None) -> DataFrame:
    """First level: one row per (source, uid) with reward sum and sample count."""
    keys = ([sanitize_source(source).alias("data_source")] if source else []) + [col(uid).alias("uid")]
    return df.groupBy(*keys).agg(F.sum(col(reward).cast("double")).alias("r_sum"),
                                 F.count(F.lit(1)).alias("r_n"))


def pass_at_n(df: DataFrame, uid="uid", reward="reward", source=None,
              overall_label: str = "overall") -> DataFrame:
    """Mean score and pass@n (share of uids whose reward sum is > 0) (A1).

    With ``source`` the same metrics are computed per sanitised source and for
    everything, in one aggregation with GROUPING SETS (A2).
    """
    u = uid_rollup(df, uid, reward, source)
    metrics = [
        (F.sum("r_sum") / F.sum("r_n")).alias("avg_score"),
        F.avg(F.when(F.col("r_sum") > 0, 1.0).otherwise(0.0)).alias("pass_at_n"),
        F.count(F.lit(1)).alias("n_prompts"),
        F.sum("r_n").alias("n_samples"),
    ]
    if source is None:
        return u.agg(*metrics)
    g = u.groupingSets([["data_source"], []], "data_source").agg(
        F.grouping("data_source").alias("_g"), *metrics)
    return g.withColumn("data_source", F.when(F.col("_g") == 1, F.lit(overall_label))
                        .otherwise(F.col("data_source"))).drop("_g")


def token_reward_score(df: DataFrame, token_rewards: str) -> DataFrame:
    """Token-level rewards: mean of per-row sums; pass@n is not defined (NULL)."""
    from rollspark.functions.arrays import dsum
    return df.agg(F.avg(dsum(token_rewards)).alias("avg_score"),
                  F.lit(None).cast("double").alias("pass_at_n"))


def rollout_length_metrics(df: DataFrame, length="resp_len", reward="reward", by=None) -> DataFrame:
    """min, max, mean, population std of response length; mean length of rows with
    reward > 0, == 0 and < 0 (0 when there is none) (A3)."""
    n = col(length).cast("double")
    r = col(reward)
    aggs = [
        F.min(n).alias("min_num_tokens"), F.max(n).alias("max_num_tokens"),
        F.avg(n).alias("avg_num_tokens"), F.stddev_pop(n).alias("std_num_tokens"),
        F.coalesce(F.avg(F.when(r > 0, n)), F.lit(0.0)).alias("avg_tokens_non_zero_rewards"),
        F.coalesce(F.avg(F.when(r == 0, n)), F.lit(0.0)).alias("avg_tokens_zero_rewards"),
        F.coalesce(F.avg(F.when(r < 0, n)), F.lit(0.0)).alias("avg_tokens_negative_rewards"),
    ]
    return df.groupBy(*([by] if isinstance(by, str) else (by or []))).agg(*aggs)


def group_mix(df: DataFrame, group="uid", reward="reward", threshold: float = 0.5,
              by=None) -> DataFrame:
    """Share of groups whose rewards are all equal and >= threshold (all good),
    all equal and below it (all bad), or not all equal (mixed) (A4)."""
    keys = [by] if isinstance(by, str) else list(by or [])
    g = df.groupBy(*keys, group).agg(F.min(col(reward)).alias("mn"), F.max(col(reward)).alias("mx"))
    same = F.col("mn") == F.col("mx")
    good = same & (F.col("mn") >= threshold)
    bad = same & (F.col("mn") < threshold)
    return g.groupBy(*keys).agg(
        F.avg(F.when(good, 1.0).otherwise(0.0)).alias("frac_all_good"),
        F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("frac_all_bad"),
        F.avg(F.when(~same, 1.0).otherwise(0.0)).alias("frac_mixed"),
        F.count(F.lit(1)).alias("n_groups"))


def clean_class_name(c) -> "F.Column":
    """Class name cleanup (P15): '_', '.', '-' become spaces, lower case, stripped."""
    return F.trim(F.lower(F.translate(col(c), "_.-", "   ")))


def per_tag_metrics(groups: DataFrame, tags="tags", group="group_id", by_traj: DataFrame | None = None,
                    traj_total="total_reward", last_reward="last_reward", turns="turns") -> DataFrame:
    """Trajectory metrics for each tag of the group tag lists, emitted only
    when some tag covers a strict subset of the groups, plus an 'all' row.
    ``groups(group, tags)``; ``by_traj(group, traj metrics...)``."""
    n_groups = groups.agg(F.countDistinct(group).alias("_ng"))
    tagged = groups.select(group, F.explode(tags).alias("tag"))
    cover = with_scalars(tagged.groupBy("tag").agg(F.countDistinct(group).alias("_tg")), n_groups)
    nontrivial = cover.agg(F.max(F.when(F.col("_tg") < F.col("_ng"), 1).otherwise(0)).alias("_nt"))
    t = with_scalars(by_traj.join(tagged, group), nontrivial).filter(F.col("_nt") == 1) \
        .drop("_nt").unionByName(by_traj.withColumn("tag", F.lit("all")))
    return t.groupBy("tag").agg(
        F.count(F.lit(1)).alias("total_episodes"), F.sum(turns).alias("total_turns"),
        F.avg(traj_total).alias("reward_total"),
        F.avg(F.when(F.col(last_reward) == 1, 1.0).otherwise(0.0)).alias("correct"))


def dict_mean(df: DataFrame, metrics="metrics") -> DataFrame:
    """Mean of every key over the rows that have it (sparse metric maps)."""
    return df.select(F.explode(col(metrics)).alias("key", "value")).groupBy("key").agg(
        F.avg(F.col("value").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def metric_list_mean(df: DataFrame, name="name", value="value") -> DataFrame:
    """Plain mean of each metric's values."""
    return df.groupBy(col(name).alias("name")).agg(F.avg(col(value).cast("double")).alias("mean"))


def accuracy_by_source(df: DataFrame, source="data_source", correct="is_correct",
                       overall_label: str = "overall") -> DataFrame:
    """Total, correct and accuracy per source and overall (ROLLUP)."""
    g = df.select(col(source).alias("data_source"), col(correct).alias("_c")).rollup("data_source").agg(
        F.grouping("data_source").alias("_g"), F.count(F.lit(1)).alias("total"),
        F.sum(F.col("_c").cast("int")).alias("correct"))
    return g.select(F.when(F.col("_g") == 1, F.lit(overall_label)).otherwise(F.col("data_source")).alias("data_source"),
                    "total", "correct", (F.col("correct") / F.col("total")).alias("accuracy"))


def classifier_accuracy(df: DataFrame, pred="pred", label="label") -> DataFrame:
    """Share of rows whose cleaned predicted class equals the cleaned label."""
    return df.agg(F.avg(F.when(clean_class_name(pred) == clean_class_name(label), 1.0).otherwise(0.0))
                  .alias("accuracy"), F.count(F.lit(1)).alias("n"))


def agent_run_report(df: DataFrame, instance="instance_id", turns="turns", resolved="resolved",
                     reason="finish_reason", masked_reasons=("CONTEXT_WINDOW_EXCEEDED", "RUNTIME_ERROR",
                                                             "EVALUATION_ERROR", "MAX_ITERATIONS_REACHED")):
    """Average turns, instances with all / no trajectories resolved, share
    of each finish reason, and the number of trajectories whose loss is masked
    out. Returns (summary, per_reason)."""
    inst = df.groupBy(instance).agg(F.min(col(resolved).cast("int")).alias("_all"),
                                    F.max(col(resolved).cast("int")).alias("_any"))
    summary = with_scalars(
        df.agg(F.avg(col(turns)).alias("avg_turns"), F.count(F.lit(1)).alias("n_trajectories"),
               F.sum(F.when(col(reason).isin(*masked_reasons), 1).otherwise(0)).alias("n_masked")),
        inst.agg(F.sum("_all").alias("all_resolved"),
                 F.sum(F.when(F.col("_any") == 0, 1).otherwise(0)).alias("none_resolved")))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    per_reason = with_scalars(df.groupBy(col(reason).alias("finish_reason")).agg(F.count(F.lit(1)).alias("n")),
                              total).select("finish_reason", (F.col("n") / F.col("_n")).alias("ratio"))
    return summary, per_reason


def sampler_stats(df: DataFrame, step="sampler_step", seconds="sample_seconds") -> DataFrame:
    """Min, max and mean of sampler step and sampling time."""
    return df.agg(F.max(step).alias("step_max"), F.min(step).alias("step_min"), F.avg(step).alias("step_mean"),
                  F.max(seconds).alias("time_max"), F.min(seconds).alias("time_min"),
                  F.avg(seconds).alias("time_mean"))

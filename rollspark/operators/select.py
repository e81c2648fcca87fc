"""Rollout selection: group filters, masks, staleness, batch cut, replacement
(F3-F9, O4, J8).

Group membership decisions are computed on a per-group aggregate and attached to
the rows by ``plans.groups.with_group``, which keeps null groups and spreads the
rows of the largest ones; row-level masks are plain projections with no shuffle
at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollspark.functions.cols import col, seeded_hash, with_scalars
from rollspark.plans.groups import keys_of, with_group
from rollspark.plans.index import hashed_index


def drop_constant_groups(df: DataFrame, group="uid", score="reward") -> DataFrame:
    """Keep only groups whose scores are not all equal."""
    d = with_group(df, group, [F.min(col(score)).alias("_mn"), F.max(col(score)).alias("_mx")])
    return d.filter(F.col("_mn") < F.col("_mx")).drop("_mn", "_mx")


def dynamic_filter(df: DataFrame, group="uid", score="reward", n_samples_per_prompt: int = 2) -> DataFrame:
    """Keep groups with population std > 0; keep everything when one sample
    per prompt (F4)."""
    if n_samples_per_prompt == 1:
        return df
    return with_group(df, group, [F.stddev_pop(col(score).cast("double")).alias("_sd")]).filter(F.col("_sd") > 0).drop("_sd")


def split_stale(df: DataFrame, step, sampler_step, max_steps_off_policy: int):
    """(kept, requeue): rows sampled at most ``max_steps_off_policy`` steps
    before ``step`` are kept, older ones go back to the queue (F5)."""
    lag = col(step) - col(sampler_step)
    return df.filter(lag <= max_steps_off_policy), df.filter(lag > max_steps_off_policy)


def overlong_filter(df: DataFrame, mask="loss_mask", response="response_ids", eos_token_id: int = 2,
                    out=None) -> DataFrame:
    """Zero the whole loss mask when the response is empty or does not end with
    EOS (F6)."""
    out = out or mask
    r = col(response)
    ok = (F.size(r) > 0) & (F.try_element_at(r, F.lit(-1)) == F.lit(eos_token_id))
    return df.withColumn(out, F.when(ok, col(mask)).otherwise(F.transform(col(mask), lambda m: m * 0)))


FAILED_FINISH_REASONS = ("CONTEXT_WINDOW_EXCEEDED", "RUNTIME_ERROR", "EVALUATION_ERROR", "MAX_ITERATIONS_REACHED")


def mask_by_finish_reason(df: DataFrame, mask="loss_mask", reason="finish_reason",
                          reasons=FAILED_FINISH_REASONS, out=None) -> DataFrame:
    """Zero loss masks of trajectories that ended for one of ``reasons``."""
    out = out or mask
    return df.withColumn(out, F.when(col(reason).isin(*reasons), F.transform(col(mask), lambda m: m * 0))
                         .otherwise(col(mask)))


def zero_unless_stop(df: DataFrame, reward="reward", stop_reason="stop_reason", out=None) -> DataFrame:
    """Reward 0 unless the stop reason is 'stop' (F8)."""
    out = out or reward
    return df.withColumn(out, F.when(col(stop_reason) == "stop", col(reward)).otherwise(F.lit(0.0)))


def validate_rollouts(df: DataFrame, response="response_ids", mask="loss_mask",
                      token_rewards=None, logprobs=None, prompts: DataFrame | None = None) -> DataFrame:
    """One-row report of violations: empty batch, per-row length mismatches of
    mask / token rewards / logprobs against the response, and whether every
    token is masked (F9). ``prompts`` (optional) is compared by count."""
    n = F.size(col(response))
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.when(F.size(col(mask)) != n, 1).otherwise(0)).alias("bad_mask_len"),
            F.sum(F.aggregate(col(mask), F.lit(0).cast("bigint"), lambda a, m: a + m)).alias("mask_total")]
    if token_rewards:
        aggs.append(F.sum(F.when(F.size(col(token_rewards)) != n, 1).otherwise(0)).alias("bad_reward_len"))
    if logprobs:
        aggs.append(F.sum(F.when(col(logprobs).isNotNull() & (F.size(col(logprobs)) != n), 1)
                          .otherwise(0)).alias("bad_logprob_len"))
    rep = df.agg(*aggs).withColumn("all_masked", F.coalesce(F.col("mask_total"), F.lit(0)) == 0)
    if prompts is not None:
        rep = with_scalars(rep, prompts.agg(F.count(F.lit(1)).alias("n_prompts")))
        rep = rep.withColumn("count_mismatch", F.col("n_prompts") != F.col("n_rows"))
    return rep


def rollout_violations(df: DataFrame, keys=("uid", "sample_key"), response="response_ids", mask="loss_mask",
                       token_rewards=None, logprobs=None) -> DataFrame:
    """The rows that :func:`validate_rollouts` counts, one per violation (F9): ``keys``, ``violation`` (empty_response,
    mask_length, reward_length, logprob_length, all_masked), ``found`` and ``expected`` lengths."""
    n = F.coalesce(F.size(col(response)), F.lit(0))

    def length(c):
        return F.coalesce(F.size(col(c)), F.lit(0))

    def broken(name, wrong, found):
        return F.when(wrong, F.struct(F.lit(name).alias("violation"), found.cast("bigint").alias("found"), n.cast("bigint").alias("expected")))

    kept = F.aggregate(col(mask), F.lit(0).cast("bigint"), lambda a, m: a + m)
    rules = [broken("empty_response", n == 0, n), broken("mask_length", length(mask) != n, length(mask)),
             broken("all_masked", F.coalesce(kept, F.lit(0)) == 0, F.coalesce(kept, F.lit(0)))]
    if token_rewards:
        rules.append(broken("reward_length", length(token_rewards) != n, length(token_rewards)))
    if logprobs:
        rules.append(broken("logprob_length", col(logprobs).isNotNull() & (length(logprobs) != n), length(logprobs)))
    return df.select(*keys, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("_v")) \
        .select(*keys, "_v.violation", "_v.found", "_v.expected")


def dynamic_sampling_cut(df: DataFrame, target_batch_size: int, n_samples_per_prompt: int,
                         group="uid", score="reward", arrival=("uid",), sample_order=("sample_key",)):
    """Collect kept groups (F4) in arrival order until ``target_batch_size``
    groups, and cut to ``target_batch_size * n_samples_per_prompt`` rows (O4).

    Returns ``(batch, status)``; status has the kept-group count and
    ``keep_sampling`` (fewer kept groups than the target). Both cuts are
    ordered top-k (limits bounded by the configured batch size).
    """
    g = keys_of(group)
    arr = list(arrival)
    aggs = [F.min(c).alias(f"_a{i}") for i, c in enumerate(arr) if c not in g]
    groups = df.groupBy(*g).agg(F.stddev_pop(col(score).cast("double")).alias("_sd"), *aggs)
    if n_samples_per_prompt != 1:
        groups = groups.filter(F.col("_sd") > 0)
    groups = groups.drop("_sd")
    order_cols = [f"_a{i}" if c not in g else c for i, c in enumerate(arr)]
    first = groups.orderBy(*order_cols, *g).limit(target_batch_size).withColumnsRenamed({k: f"_f{i}" for i, k in enumerate(g)})
    same = F.lit(True)
    for i, k in enumerate(g):
        same = same & F.col(k).eqNullSafe(F.col(f"_f{i}"))
    if target_batch_size <= 100_000:  # the bound of what is broadcast; so a group's rows stay where they are
        first = F.broadcast(first)
    rows = df.join(first, same).drop(*[f"_f{i}" for i in range(len(g))])
    batch = rows.orderBy(*order_cols, *g, *sample_order).limit(target_batch_size * n_samples_per_prompt)
    batch = batch.drop(*[c for c in order_cols if c not in g])
    status = groups.agg(F.count(F.lit(1)).alias("n_kept_groups")) \
        .withColumn("keep_sampling", F.col("n_kept_groups") < target_batch_size)
    return batch, status


def replace_bad_groups(df: DataFrame, n_samples_per_prompt: int, min_replace_ratio: float,
                       group="uid", score="reward", sample_idx="sample_idx", seed: int = 0,
                       materialize: bool = True):
    """Replace every zero-variance group by the samples of a good group.

    Good = population std > 0. Only when good groups are more than
    ``min_replace_ratio`` of all groups: good and bad groups are ranked by a
    seeded hash, bad rank r takes good rank r mod n_good (distinct partners
    while there are enough), and each bad sample i takes every column of the
    partner's sample i. Returns ``(rows, status)``.

    The input is read four times (group statistics, partner rows, bad rows,
    kept rows). With ``materialize`` it is written once as a table under the
    shared ``spark.checkpoint.dir`` first, so an expensive upstream plan runs
    once and the four reads start from the written copy (which also survives
    the loss of executors).
    """
    if materialize:
        from rollspark.session import materialize as write_once
        df = write_once(df, "replace_bad_groups")
    g = keys_of(group)
    if len(g) != 1:
        raise ValueError("replace_bad_groups takes one group column")
    k = g[0]
    st = df.groupBy(k).agg(F.stddev_pop(col(score).cast("double")).alias("_sd"))
    good_flag = (F.col("_sd") > 0) | F.lit(n_samples_per_prompt == 1)
    st = st.withColumn("_good", good_flag).withColumn("_h", seeded_hash(seed, k))
    counts = st.agg(F.sum(F.when(F.col("_good"), 1).otherwise(0)).alias("n_good"),
                    F.count(F.lit(1)).alias("n_groups"))
    status = counts.withColumn("replaced", F.col("n_good") > F.col("n_groups") * F.lit(min_replace_ratio)) \
        .withColumn("keep_sampling", ~F.col("replaced"))
    good = hashed_index(st.filter("_good").select(k, "_h"), "_h", name="_gr")
    bad = hashed_index(st.filter(~F.col("_good")).select(k, "_h"), "_h", name="_br")
    # one-row status, attached as a scalar
    bad = with_scalars(bad, status.select("n_good", "replaced")) \
        .filter(F.col("replaced") & (F.col("n_good") > 0)) \
        .withColumn("_gr", F.pmod(F.col("_br"), F.col("n_good")))
    pairs = bad.join(good.select(F.col(k).alias("_partner"), "_gr"), "_gr").select(k, "_partner")
    # rows of bad groups: take partner's sample with the same sample index
    cols = [c for c in df.columns if c != k]
    partner_rows = df.select(F.col(k).alias("_partner"), *[F.col(c).alias("_p_" + c) for c in cols])
    bad_rows = df.join(pairs, k)
    j = bad_rows.join(partner_rows, (bad_rows["_partner"] == partner_rows["_partner"])
                      & (bad_rows[sample_idx] == partner_rows["_p_" + sample_idx]), "left")
    hit = partner_rows["_partner"].isNotNull()
    # a bad sample whose partner has no sample with the same index stays as it is
    replaced = j.select(F.when(hit, partner_rows["_partner"]).otherwise(bad_rows[k]).alias(k),
                        *[F.when(hit, F.col("_p_" + c)).otherwise(bad_rows[c]).alias(c) for c in cols],
                        F.when(hit, bad_rows[k]).alias("replaced_uid"))
    kept = df.join(pairs, k, "left_anti").withColumn("replaced_uid", F.lit(None).cast(df.schema[k].dataType))
    return kept.unionByName(replaced), status


def representative_picks(df: DataFrame, score: str, key, k: int, seed: int = 0) -> DataFrame:
    """O3: the rows at ``k`` evenly spaced ranks of the score order
    (numpy ``linspace(0, n - 1, k)`` truncated to integers, last = n - 1),
    with ``pick`` = 0..k-1. Ties are ordered by a seeded hash of ``key``
    (the reference's sort is not stable, so any order of ties is valid)."""
    from rollspark.plans.ordered import score_rank
    keys = [key] if isinstance(key, str) else list(key)
    d = score_rank(df.withColumn("_tb", seeded_hash(seed, *keys)), score, "_tb", name="_rank")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    d = with_scalars(d, n)
    if k == 1:
        pos = F.array(F.lit(0).cast("bigint"))
    else:
        step = (F.col("_n") - 1).cast("double") / F.lit(float(k - 1))
        pos = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(
            i == k - 1, F.col("_n") - 1).otherwise(F.floor(i.cast("double") * step)).cast("bigint"))
    d = d.withColumn("_pick", F.array_position(pos, F.col("_rank")) - 1)
    return d.filter(F.col("_pick") >= 0).withColumnRenamed("_pick", "pick").drop("_tb", "_n", "_rank")

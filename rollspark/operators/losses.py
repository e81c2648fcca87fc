"""Token-level KL, policy / value losses and their reductions as offline reports
over logged rollouts (V10-V24, A12-A18).

Token quantities are array expressions (``zip_with``/``transform``) evaluated
per row inside whole-stage stages; reductions are plain aggregates (sums and
counts, combined map-side). No gradient is computed: these are the numbers a
trainer logs, recomputed at table scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollspark.functions.arrays import dsum, masked_mean, masked_moments, masked_sum, mask_count, tokens
from rollspark.functions.cols import col, with_scalars
from rollspark.operators.advantages import merged_moments
from rollspark.session import materialize as write_once


def approx_kl(log_probs, base_log_probs, mask=None, kind: str = "k3") -> Column:
    """Per-token KL estimate (V10): k1 = lp - base, abs, k2 = 0.5 (lp - base)^2,
    k3 = exp(c) - c - 1 with c = clamp(base - lp, -20, 20), result clamped to
    [-10, 10]; multiplied by the mask when given."""
    def k(lp, b):
        if kind == "k1":
            return lp - b
        if kind == "abs":
            return F.abs(lp - b)
        if kind == "k2":
            return F.lit(0.5) * (lp - b) * (lp - b)
        if kind == "k3":
            c = F.least(F.greatest(b - lp, F.lit(-20.0)), F.lit(20.0))
            return F.least(F.greatest(F.exp(c) - c - 1, F.lit(-10.0)), F.lit(10.0))
        raise ValueError(f"no KL estimator is called {kind!r}")
    kl = F.zip_with(col(log_probs), col(base_log_probs), lambda a, b: k(a.cast("double"), b.cast("double")))
    if mask is None:
        return kl
    return F.zip_with(kl, col(mask), lambda x, m: x * m.cast("double"))


def kl_penalized_rewards(token_rewards, kl, coef: float) -> Column:
    """r_t - kl_t * max(0, coef)."""
    c = max(0.0, coef)
    return F.zip_with(col(token_rewards), col(kl), lambda r, k: r.cast("double") - k * F.lit(c))


def ratio_tokens(log_probs, old_log_probs) -> Column:
    return F.zip_with(col(log_probs), col(old_log_probs), lambda a, b: F.exp(a.cast("double") - b.cast("double")))


def ppo_tokens(log_probs, old_log_probs, advantages, eps_low: float = 0.2, eps_high: float = 0.2,
               dual_clip: float | None = None):
    """(loss, clipped) token arrays of the clipped surrogate (V16); with
    ``dual_clip`` = c, negative-advantage tokens take min(-adv*c, loss), as in
    the reference (V17)."""
    r = ratio_tokens(log_probs, old_log_probs)

    def loss(ratio, adv):
        s1 = ratio * adv
        s2 = F.least(F.greatest(ratio, F.lit(1 - eps_low)), F.lit(1 + eps_high)) * adv
        base = -F.least(s1, s2)
        if dual_clip is None:
            return base
        return F.when(adv < 0, F.least(-adv * F.lit(dual_clip), base)).otherwise(base)

    def clipped(ratio, adv):
        s1 = ratio * adv
        s2 = F.least(F.greatest(ratio, F.lit(1 - eps_low)), F.lit(1 + eps_high)) * adv
        return F.when(-s2 > -s1, 1.0).otherwise(0.0)

    adv = col(advantages)
    return (F.zip_with(r, adv, lambda x, a: loss(x, a.cast("double"))),
            F.zip_with(r, adv, lambda x, a: clipped(x, a.cast("double"))))


def tis_weights(old_log_probs, rollout_log_probs, cap: float) -> Column:
    """Truncated importance weight min(exp(old - rollout), cap) per token."""
    return F.zip_with(col(old_log_probs), col(rollout_log_probs),
                      lambda a, b: F.least(F.exp(a.cast("double") - b.cast("double")), F.lit(cap)))


def gspo_seq_ratio(log_probs, old_log_probs, mask) -> Column:
    """GSPO sequence ratio exp(min(masked mean of (lp - old), 10)) of a row.
    Put it in a column first: referenced inside a per-token lambda it would be
    recomputed for every token."""
    lr = tokens(lambda a, b: a - b, log_probs, old_log_probs)
    return F.exp(F.least(masked_mean(lr, mask), F.lit(10.0)))


def gspo_tokens(advantages, seq_ratio, eps_low=3e-4, eps_high=4e-4):
    """GSPO-token (V19): the row's sequence ratio (column ``seq_ratio``, see
    :func:`gspo_seq_ratio`) for every token in the clipped surrogate."""
    def sides(adv, ratio):
        return ratio * adv, ratio.greatest(1 - eps_low).least(1 + eps_high) * adv

    def loss(adv, ratio):
        s1, s2 = sides(adv, ratio)
        return -s1.least(s2)

    def clipped(adv, ratio):
        s1, s2 = sides(adv, ratio)
        return (-s2).where_above(-s1, 1.0, 0.0)

    return tokens(loss, advantages, of_row=seq_ratio), tokens(clipped, advantages, of_row=seq_ratio)


def sapo_tokens(log_probs, old_log_probs, advantages, tau_pos: float = 1.0, tau_neg: float = 1.05) -> Column:
    """SAPO (V20): -sigmoid(tau (ratio - 1)) * 4 / tau * adv; tau_pos when adv > 0,
    else tau_neg (so a zero advantage takes tau_neg)."""
    def f(lp, old, adv):
        tau = adv.where_above(0.0, tau_pos, tau_neg)
        return -(1.0 / (1.0 + (-tau * ((lp - old).exp() - 1)).exp()) * 4.0 / tau) * adv
    return tokens(f, log_probs, old_log_probs, advantages)


def _reduction(reduction: str, max_seq_len: int | None) -> Column:
    """Aggregate of one loss reduction over per-row ``_ls`` (masked loss sum)
    and ``_mc`` (mask count)."""
    if reduction == "token_mean":
        return F.sum("_ls") / F.greatest(F.sum("_mc"), F.lit(1.0))
    if reduction == "sequence_mean":
        return F.avg(F.col("_ls") / F.greatest(F.col("_mc"), F.lit(1.0)))
    if reduction == "seq_mean_token_sum_norm":
        if max_seq_len is None:
            raise ValueError("the reduction seq_mean_token_sum_norm divides by max_seq_len; give one")
        return F.avg(F.col("_ls") / F.lit(float(max_seq_len)))
    raise ValueError(f"no loss reduction is called {reduction!r}")


def reduce_tokens(df: DataFrame, loss: Column, mask, reduction: str, max_seq_len: int | None = None,
                  by=None) -> DataFrame:
    """Loss reductions (V22): token_mean = sum(l*m)/sum(m) over the batch;
    sequence_mean = mean over rows of the row's masked mean;
    seq_mean_token_sum_norm = mean over rows of sum(l*m)/max_seq_len."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    d = df.select(*keys, masked_sum(loss, mask).alias("_ls"), mask_count(mask).alias("_mc"))
    agg = _reduction(reduction, max_seq_len).alias("loss")
    return d.groupBy(*keys).agg(agg) if keys else d.agg(agg)


def reduce_tokens_many(df: DataFrame, loss: Column, mask, reductions, max_seq_len: int | None = None,
                       clip: Column | None = None) -> DataFrame:
    """Several reductions of one token loss (and the masked mean of ``clip``)
    in a single pass: one row per reduction (``reduction``, ``loss``,
    ``clip_ratio``)."""
    cols = [masked_sum(loss, mask).alias("_ls"), mask_count(mask).alias("_mc")]
    if clip is not None:
        cols.append(masked_sum(clip, mask).alias("_cs"))
    d = df.select(*cols)
    ratio = (F.sum("_cs") / F.greatest(F.sum("_mc"), F.lit(1.0))) if clip is not None else F.lit(None).cast("double")
    one = d.agg(*[_reduction(r, max_seq_len).alias(f"_r{i}") for i, r in enumerate(reductions)],
                ratio.alias("clip_ratio"))
    rows = F.array(*[F.struct(F.lit(r).alias("reduction"), F.col(f"_r{i}").alias("loss"))
                     for i, r in enumerate(reductions)])
    return one.select(F.explode(rows).alias("_x"), "clip_ratio").select("_x.reduction", "_x.loss", "clip_ratio")


def token_mean(df: DataFrame, x: Column, mask, alias: str) -> Column:
    return (F.sum(masked_sum(x, mask)) / F.greatest(F.sum(mask_count(mask)), F.lit(1.0))).alias(alias)


def value_loss_tokens(values, old_values, returns, value_clip: float | None):
    """Clipped value loss (V23): max((clip(v) - R)^2, (v - R)^2) and the clip flag."""
    if value_clip is None:
        lt = tokens(lambda v, o, r: (v - r) * (v - r), values, old_values, returns)
        return lt, F.transform(col(values), lambda v: F.lit(0.0))

    def squares(v, o, r):
        clipped = o + (v - o).greatest(-value_clip).least(value_clip)
        return (clipped - r) * (clipped - r), (v - r) * (v - r)

    def loss(v, o, r):
        s1, s2 = squares(v, o, r)
        return s1.greatest(s2)

    def flag(v, o, r):
        s1, s2 = squares(v, o, r)
        return s1.where_above(s2, 1.0, 0.0)

    return tokens(loss, values, old_values, returns), tokens(flag, values, old_values, returns)


# documented losses of the sampling service (V21); each is summed over tokens

def cross_entropy_tokens(target_logprobs, weights) -> Column:
    return tokens(lambda lp, w: -lp * w, target_logprobs, weights)


def importance_sampling_tokens(target_logprobs, sampling_logprobs, advantages) -> Column:
    return tokens(lambda t, s, a: -((t - s).exp() * a), target_logprobs, sampling_logprobs, advantages)


def cispo_tokens(target_logprobs, sampling_logprobs, advantages, clip_low: float, clip_high: float) -> Column:
    return tokens(lambda t, s, a: -((t - s).exp().greatest(clip_low).least(clip_high) * t * a),
                  target_logprobs, sampling_logprobs, advantages)


def dro_tokens(target_logprobs, sampling_logprobs, advantages, beta: float) -> Column:
    return tokens(lambda t, s, a: -(t * a - 0.5 * beta * (t - s) * (t - s)), target_logprobs, sampling_logprobs, advantages)


def reinforce_tokens(log_probs, advantages) -> Column:
    """REINFORCE loss per token: -lp * adv."""
    return tokens(lambda lp, a: -lp * a, log_probs, advantages)


# ----------------------------------------------------------------- reports

def kl_sample_train(df: DataFrame, sampling_logprobs, training_logprobs, mask) -> DataFrame:
    """v1 = mean(s - t), v2 = 0.5 mean((s - t)^2), entropy = -mean(s)
    over action tokens (mask > 0)."""
    cells = df.select(F.explode(F.arrays_zip(col(sampling_logprobs).alias("s"), col(training_logprobs).alias("t"),
                                             col(mask).alias("m"))).alias("c")).filter(F.col("c.m") > 0)
    dlt = F.col("c.s").cast("double") - F.col("c.t").cast("double")
    return cells.agg(F.avg(dlt).alias("kl_v1"), (F.lit(0.5) * F.avg(dlt * dlt)).alias("kl_v2"),
                     (-F.avg(F.col("c.s").cast("double"))).alias("entropy"),
                     F.count(F.lit(1)).alias("n_tokens"))


def teacher_kl(df: DataFrame, log_probs, teacher_log_probs, mask, by="data_source",
               overall_label: str = "overall") -> DataFrame:
    """Mask-weighted mean of (lp - teacher) per dataset and overall."""
    d = df.select(F.col(by).alias(by), masked_sum(F.zip_with(col(log_probs), col(teacher_log_probs),
                                                             lambda a, b: a - b), mask).alias("_s"),
                  mask_count(mask).alias("_m"))
    g = d.groupingSets([[by], []], by).agg(F.grouping(by).alias("_g"),
                                            (F.sum("_s") / F.sum("_m")).alias("teacher_kl"))
    return g.withColumn(by, F.when(F.col("_g") == 1, F.lit(overall_label)).otherwise(F.col(by))).drop("_g")


def prob_gap(df: DataFrame, rollout_logprobs, log_probs, mask, padded: bool = False) -> DataFrame:
    """Mean and sample std of |exp(rollout) - exp(train)|, over action tokens or, with ``padded``, over every cell
    of the batch padded to its longest row, as in the reference (padding has no gap). The tokens are read once, for
    one row of moments per row."""
    gap = F.zip_with(col(rollout_logprobs), col(log_probs), lambda r, t: F.abs(F.exp(r.cast("double")) - F.exp(t.cast("double"))))
    cells = F.transform(col(mask), lambda m: F.lit(1.0)) if padded else F.transform(col(mask), lambda m: F.when(m > 0, 1.0).otherwise(0.0))
    rows = write_once(df.select(masked_moments(gap, cells).alias("_mo"), F.size(col(mask)).alias("_len")), "prob_gap")
    st = merged_moments(rows, "_mo")
    if padded:
        st = with_scalars(st, rows.agg((F.count(F.lit(1)) * F.max("_len")).cast("double").alias("_cells")))
        st = st.withColumns({"m2": F.col("m2") + F.col("n") * F.col("mu") ** 2 * (F.lit(1.0) - F.col("n") / F.col("_cells")),
                             "mu": F.col("mu") * F.col("n") / F.col("_cells"), "n": F.col("_cells")})
    return st.select(F.col("mu").alias("prob_diff_mean"), F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1)).alias("prob_diff_std"))


def kl_reward_stats(df: DataFrame, kl, mask) -> DataFrame:
    """Mean over rows of the masked mean KL and of the row max |KL|."""
    return df.agg(F.avg(masked_mean(kl, mask)).alias("avg_kl"),
                  F.avg(F.array_max(F.transform(col(kl), lambda x: F.abs(x)))).alias("avg_kl_max"))


def advantage_stats(df: DataFrame, token_rewards, advantages, mask) -> DataFrame:
    """Mean of per-row reward sums; mean and mean |.| of masked advantages."""
    cells = F.filter(F.arrays_zip(col(advantages).alias("a"), col(mask).alias("m")), lambda c: c["m"] > 0)
    vals = F.transform(cells, lambda c: c["a"].cast("double"))
    d = df.select(dsum(token_rewards).alias("_r"), dsum(vals).alias("_a"),
                  dsum(F.transform(vals, lambda v: F.abs(v))).alias("_aa"), F.size(vals).alias("_n"))
    return d.agg(F.avg("_r").alias("avg_rewards"), (F.sum("_a") / F.sum("_n")).alias("avg_advantages"),
                 (F.sum("_aa") / F.sum("_n")).alias("avg_advantages_abs"))


def weighted_nll(df: DataFrame, logprobs, weights) -> DataFrame:
    """-sum(lp * w) / sum(w); NaN when the weights sum to 0 (as the reference)."""
    d = df.select(masked_sum(logprobs, weights).alias("_s"), mask_count(weights).alias("_w"))
    return d.agg(F.when(F.sum("_w") == 0, F.lit(float("nan"))).otherwise(-F.sum("_s") / F.sum("_w")).alias("nll"))

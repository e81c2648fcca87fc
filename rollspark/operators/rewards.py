"""Reward shaping as column expressions (V25-V27, F8 lives in select)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollspark.functions.cols import col


def soft_overlong(df: DataFrame, max_context_length: int, buffer_len: int, penalty_factor: float,
                  reward="reward", prompt_len="prompt_len", resp_len="resp_len", out=None) -> DataFrame:
    """DAPO soft overlong punishment (V25): inside the last ``buffer_len`` tokens
    before the context limit the reward drops linearly by up to
    ``penalty_factor``; beyond the limit the reward is 0."""
    out = out or reward
    p, r = col(prompt_len), col(resp_len)
    start = F.lit(max_context_length - buffer_len) - p
    limit = F.lit(max_context_length) - p
    pen = (r - start).cast("double") / F.lit(float(buffer_len)) * F.lit(float(penalty_factor))
    return df.withColumn(out, F.when((r > start) & (r <= limit), col(reward) - pen)
                         .when(r > limit, F.lit(0.0)).otherwise(col(reward).cast("double")))


def pgfc_reward(df: DataFrame, noise_rate: float, correct="is_correct", out="reward") -> DataFrame:
    """Noise-corrected reward (V26): correct -> rho, wrong -> rho - 1; with
    rho = 0 the plain 1 / 0 reward."""
    hit, miss = (noise_rate, noise_rate - 1.0) if noise_rate > 0 else (1.0, 0.0)
    return df.withColumn(out, F.when(col(correct), F.lit(hit)).otherwise(F.lit(miss)))


def problem_reward(df: DataFrame, format_coef: float, correct="is_correct", format_ok="format_ok",
                   out="reward") -> DataFrame:
    """coef * (format_ok - 1) + correct."""
    return df.withColumn(out, F.lit(format_coef) * (col(format_ok).cast("double") - 1.0)
                         + col(correct).cast("double"))

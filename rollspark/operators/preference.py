"""Preference data: best-vs-worst pairs, chunked tournaments, win-minus-loss
rewards, verdict parsing, comparison prompts, DPO reports (J6, J7, A10, A11,
A25, B9 in plans, C15-C18, F12, F13, P13, X4).

Tournaments never pair a whole group: players are numbered inside their group
(:func:`ordered_index`), cut into chunks of at most ``chunk_size`` and paired
only inside a chunk, so the pair count is linear in the number of players
however large one group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollspark.functions.cols import col, pystrip
from rollspark.plans.ordered import ordered_index

# Comparison separators and verdict labels.
SEP_A, SEP_B, SEP_PREF = "==== Completion A ====", "==== Completion B ====", "==== Preference ===="


def best_worst_pairs(df: DataFrame, prompt="prompt", response="response", score="helpfulness",
                     order="input_order") -> DataFrame:
    """Per prompt with at least two responses, the best (highest score,
    earliest in input order) against the worst (lowest score, latest in input
    order) when their scores differ; one aggregation, no self join."""
    key = F.struct(col(score).alias("s"), (-col(order)).alias("o"))
    g = df.groupBy(prompt).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(col(response), key).alias("chosen_response"),
        F.min_by(col(response), key).alias("rejected_response"),
        F.max(col(score)).alias("_mx"), F.min(col(score)).alias("_mn"))
    return g.filter((F.col("_n") >= 2) & (F.col("_mx") > F.col("_mn"))).select(
        prompt, "chosen_response", "rejected_response", (F.col("_mx") - F.col("_mn")).alias("helpfulness_diff"))


def tournament_pairs(df: DataFrame, group="group_id", order="player_order", chunk_size: int = 4,
                     both_ways: bool = False) -> DataFrame:
    """Matchups (i, j) inside chunks of ``chunk_size`` consecutive players
    of a group: i < j, or i != j with ``both_ways``. Returns group, chunk,
    i, j (player indices in the group)."""
    p = ordered_index(df, order, [group], name="player")
    p = p.withColumn("chunk", F.floor(F.col("player") / chunk_size).cast("bigint"))
    a = p.select(col(group).alias("_g"), F.col("chunk").alias("_c"), F.col("player").alias("i"))
    b = p.select(col(group).alias("_g2"), F.col("chunk").alias("_c2"), F.col("player").alias("j"))
    cond = (F.col("_g") == F.col("_g2")) & (F.col("_c") == F.col("_c2"))
    cond = cond & ((F.col("i") != F.col("j")) if both_ways else (F.col("i") < F.col("j")))
    return a.join(b, cond).select(F.col("_g").alias(group), F.col("_c").alias("chunk"), "i", "j")


def shorter_preference(len_a, len_b) -> Column:
    """C17: 1.0 when A is longer (B preferred), -1.0 when B is longer, else 0."""
    return F.signum(col(len_a).cast("double") - col(len_b).cast("double"))


def verdict_score(text) -> Column:
    """C18: 'A' -> -1, 'B' -> 1, 'Tie' or anything else -> 0 (after stripping)."""
    t = pystrip(col(text))
    return F.when(t == "A", -1.0).when(t == "B", 1.0).otherwise(0.0)


def win_minus_loss(matchups: DataFrame, group="group_id", reward="j_reward", valid: DataFrame | None = None,
                   format_coef: float = 1.0) -> DataFrame:
    """A10: each matchup adds its reward to j and subtracts it from i; a
    player's reward is the mean over its matchups plus coef * (valid - 1).
    A player with no matchup gets NULL (the reference divides by zero).
    ``valid(group, player, is_valid)`` lists every player."""
    side = matchups.select(col(group), F.explode(F.array(
        F.struct(F.col("i").alias("player"), (-col(reward)).alias("r")),
        F.struct(F.col("j").alias("player"), col(reward).alias("r")))).alias("x"))
    per = side.groupBy(group, F.col("x.player").alias("player")).agg(
        F.sum("x.r").alias("win_minus_loss_sum"), F.count(F.lit(1)).alias("matchup_count"))
    if valid is None:
        return per.withColumn("win_minus_loss", F.col("win_minus_loss_sum") / F.col("matchup_count"))
    j = valid.join(per, [group, "player"], "left")
    wml = F.try_divide(F.col("win_minus_loss_sum"), F.col("matchup_count"))
    return j.withColumn("win_minus_loss", wml).withColumn(
        "reward", wml + F.lit(format_coef) * (col("is_valid").cast("double") - 1.0))


def rubric_reward(df: DataFrame, grader_outputs="grader_outputs", regexes="extraction_regexes",
                  format_ok="format_ok", format_coef: float = 0.1) -> DataFrame:
    """Mean over rubric items of the score captured by each item's regex
    (an unparsable score counts 0) plus coef * (format - 1)."""
    scores = F.zip_with(col(grader_outputs), col(regexes),
                        lambda out, rx: F.coalesce(F.call_function("regexp_extract", out, rx, F.lit(1)).try_cast("double"), F.lit(0.0)))
    avg = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return df.withColumn("rubric_score", avg).withColumn(
        "reward", F.lit(format_coef) * (col(format_ok).cast("double") - 1.0) + F.col("rubric_score"))


def parse_transcript(text) -> Column:
    """C15: 'Human: ... Assistant: ...' text -> ARRAY<STRUCT<role, content>>."""
    parts = F.regexp_extract_all(col(text), F.lit(r"(?s)(Human:|Assistant:)(.*?)(?=Human:|Assistant:|$)"), 0)
    return F.transform(parts, lambda p: F.struct(
        F.when(p.startswith("Human:"), "user").otherwise("assistant").alias("role"),
        pystrip(F.regexp_replace(p, r"^(Human:|Assistant:)", "")).alias("content")))


def comparison_conversation(prompt_conv, completion_a, completion_b, label=None) -> Column:
    """Prompt + A separator + A + B separator + B + preference separator
    (+ the label as the last assistant message)."""
    def sysmsg(t):
        return F.array(F.struct(F.lit("system").alias("role"), F.lit(t).alias("content")))
    parts = [col(prompt_conv), sysmsg(SEP_A), col(completion_a), sysmsg(SEP_B), col(completion_b), sysmsg(SEP_PREF)]
    if label is not None:
        parts.append(F.array(F.struct(F.lit("assistant").alias("role"), col(label).alias("content"))))
    return F.concat(*parts)


def valid_pair(chosen, rejected) -> Column:
    """same length, identical up to the last turn, and a different last turn."""
    c, r = col(chosen), col(rejected)
    n = F.size(c)
    before = lambda x: F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return (n == F.size(r)) & (n >= 1) & (before(c) == before(r)) & ~F.try_element_at(c, F.lit(-1)).eqNullSafe(F.try_element_at(r, F.lit(-1)))


def usable_comparison(messages, winner) -> Column:
    """winner is A or B (no tie / invalid), the conversation has >= 2
    messages and ends with an assistant message."""
    m = col(messages)
    return col(winner).isin("A", "B") & (F.size(m) >= 2) & (F.try_element_at(m, F.lit(-1))["role"] == "assistant")


def dpo_report(df: DataFrame, chosen_lp="chosen_logprob", rejected_lp="rejected_logprob",
               chosen_ref="chosen_ref_logprob", rejected_ref="rejected_ref_logprob", beta: float = 0.1,
               n_tokens=None) -> DataFrame:
    """DPO loss (mean of -logsigmoid(beta * (c - r))), accuracy, margin,
    chosen / rejected rewards, pair (and token) counts."""
    c = col(chosen_lp) - col(chosen_ref)
    r = col(rejected_lp) - col(rejected_ref)
    z = F.lit(beta) * (c - r)
    # -logsigmoid(z) = log1p(exp(-|z|)) + max(-z, 0), stable for any z
    loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    aggs = [F.avg(loss).alias("dpo_loss"), F.avg(F.when(c > r, 1.0).otherwise(0.0)).alias("accuracy"),
            F.avg(F.lit(beta) * (c - r)).alias("margin"), F.avg(F.lit(beta) * c).alias("chosen_reward"),
            F.avg(F.lit(beta) * r).alias("rejected_reward"), F.count(F.lit(1)).alias("n_pairs")]
    if n_tokens is not None:
        aggs.append(F.sum(col(n_tokens)).alias("n_tokens"))
    return df.agg(*aggs)

"""Multi-turn trajectories to training sequences, truncation and padding
(W1-W7, A5, A9).

Turn order inside a trajectory comes from :func:`ordered_index` /
:func:`ordered_cumsum` (ranges, not a window over the whole trajectory); the
previous turn is found by an equi-join on (trajectory, position - 1) that
carries its length and two hashes of its tokens. Only a finished training
sequence is gathered into one row, and its size is bounded by the model context
it is built for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollspark.functions.cols import col
from rollspark.plans.groups import key_text
from rollspark.plans.ordered import ordered_cumsum, ordered_index


def merge_turns(df: DataFrame, traj="traj_id", step="step", ob="ob", ac="ac") -> DataFrame:
    """A turn extends the current sequence iff the previous turn's ob + ac
    is a prefix of its ob (after any turn the running sequence equals ob + ac);
    otherwise a new sequence starts. Adds ``seq_no`` (0-based per trajectory),
    ``delta_ob`` (the part of ob not already in the sequence) and ``is_new``."""

    def hashes(tokens):
        return F.struct(F.xxhash64(tokens).alias("a"), F.xxhash64(F.lit("again"), tokens).alias("b"))

    p = ordered_index(df, step, [traj], name="_pos")
    p = p.withColumn("_tk", key_text(p, [traj]))
    full = F.concat(col(ob), col(ac))
    prev = p.select("_tk", (F.col("_pos") + 1).alias("_pos"), F.size(full).alias("_n_prev"), hashes(full).alias("_prev"))
    j = p.join(prev, ["_tk", "_pos"], "left")
    n_prev = F.col("_n_prev")
    # two hashes of 64 bits and the length stand for the tokens
    is_prefix = (F.size(col(ob)) >= n_prev) & (hashes(F.slice(col(ob), 1, n_prev)) == F.col("_prev"))
    brk = n_prev.isNull() | ~is_prefix
    j = j.withColumn("is_new", brk).withColumn("_brk", brk.cast("long"))
    j = j.withColumn("delta_ob", F.when(brk, col(ob)).otherwise(
        F.slice(col(ob), n_prev + 1, F.greatest(F.size(col(ob)) - n_prev, F.lit(0)))))
    j = ordered_cumsum(j.drop("_n_prev", "_prev", "_tk", "_pos"), step, "_brk", [traj], name="_seq")
    return j.withColumn("seq_no", (F.col("_seq") - 1).cast("bigint")).drop("_brk", "_seq")


def training_sequences(merged: DataFrame, traj="traj_id", advantage="advantage", ac="ac",
                       ac_logprobs="ac_logprobs", step="step", max_length: int | None = None) -> DataFrame:
    """One datum per (trajectory, seq_no): tokens = concatenation of
    (delta_ob, ac) over its turns; observation tokens get logprob 0, advantage
    0, mask 0; action tokens their logprobs, the trajectory advantage and mask
    1. Inputs are tokens[:-1], targets tokens[1:], the other arrays drop their
    first element. ``max_length`` truncates before shifting (W4)."""
    chunk = F.struct(
        col(step).alias("s"),
        F.concat(F.col("delta_ob"), col(ac)).alias("tok"),
        F.concat(F.array_repeat(F.lit(0.0), F.size("delta_ob")),
                 F.transform(col(ac_logprobs), lambda x: x.cast("double"))).alias("lp"),
        F.concat(F.array_repeat(F.lit(0.0), F.size("delta_ob")),
                 F.array_repeat(col(advantage).cast("double"), F.size(col(ac)))).alias("adv"),
        F.concat(F.array_repeat(F.lit(0.0), F.size("delta_ob")),
                 F.array_repeat(F.lit(1.0), F.size(col(ac)))).alias("m"))
    g = merged.groupBy(traj, "seq_no").agg(F.array_sort(F.collect_list(chunk)).alias("_c"))
    flat = lambda f: F.flatten(F.transform("_c", lambda x: x[f]))
    s = g.select(traj, "seq_no", flat("tok").alias("_tok"), flat("lp").alias("_lp"),
                 flat("adv").alias("_adv"), flat("m").alias("_m"))
    if max_length is not None:
        s = s.select(traj, "seq_no", *[F.slice(c, 1, max_length).alias(c) for c in ("_tok", "_lp", "_adv", "_m")])
    n = F.size("_tok")
    return s.select(traj, "seq_no",
                    F.slice("_tok", 1, F.greatest(n - 1, F.lit(0))).alias("input_tokens"),
                    F.slice("_tok", 2, F.greatest(n - 1, F.lit(0))).alias("target_tokens"),
                    F.slice("_lp", 2, F.greatest(n - 1, F.lit(0))).alias("logprobs"),
                    F.slice("_adv", 2, F.greatest(n - 1, F.lit(0))).alias("advantages"),
                    F.slice("_m", 2, F.greatest(n - 1, F.lit(0))).alias("mask"))


def trajectory_totals(df: DataFrame, traj="traj_id", reward="reward", group="group_id",
                      group_reward=None) -> DataFrame:
    """Total reward per trajectory = sum of step rewards (+ a final group
    reward when given)."""
    keys = [group, traj] if group else [traj]
    t = df.groupBy(*keys).agg(F.sum(col(reward).cast("double")).alias("total_reward"),
                              F.count(F.lit(1)).alias("n_turns"))
    if group_reward is not None:
        t = t.join(group_reward, keys, "left").withColumn(
            "total_reward", F.col("total_reward") + F.coalesce(F.col("final_reward"), F.lit(0.0)))
    return t


def trajectory_metrics(df: DataFrame, traj="traj_id", step="step", ob="ob", ac="ac", reward="reward") -> DataFrame:
    """A5: action / observation tokens per turn, turns per episode, token
    totals, mean total reward, and correct = last transition's reward is 1."""
    t = df.groupBy(traj).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.size(col(ac))).alias("ac_tokens"),
        F.sum(F.size(col(ob))).alias("ob_tokens"), F.sum(col(reward)).alias("total_reward"),
        F.max_by(col(reward), col(step)).alias("last_reward"))
    return t.agg(
        (F.sum("ac_tokens") / F.sum("turns")).alias("ac_tokens_per_turn"),
        (F.sum("ob_tokens") / F.sum("turns")).alias("ob_tokens_per_turn"),
        F.avg("turns").alias("turns_per_episode"),
        F.sum("ac_tokens").alias("total_ac_tokens"), F.sum("ob_tokens").alias("total_ob_tokens"),
        F.avg("total_reward").alias("reward_total"),
        F.avg(F.when(F.col("last_reward") == 1, 1.0).otherwise(0.0)).alias("correct"))


def truncate_tokens(text, n: int):
    """First n whitespace tokens of a text (the cut is the feature)."""
    return F.slice(F.split(col(text), " "), 1, n)


def pad_batch(df: DataFrame, batch="batch_id", prompt="prompt_ids", response="response_ids",
              mask="loss_mask", pad_id: int = 0, within: str | None = None) -> DataFrame:
    """Left-pad prompts and right-pad responses / masks to the batch
    maxima (max lengths per batch come from an aggregate joined back), plus
    attention masks (1 on real tokens). ``within`` names a column that is the same for all rows of a batch;
    if ``df`` is partitioned by it, no row moves."""
    sizes = [F.max(F.size(col(prompt))), F.max(F.size(col(response)))]
    if within is None:
        d = df.join(df.groupBy(batch).agg(*[m.alias(n) for m, n in zip(sizes, ("_mp", "_mr"), strict=True)]), batch)
    else:
        w = Window.partitionBy(within, batch)
        d = df.filter(F.col(batch).isNotNull()).select("*", *[m.over(w).alias(n) for m, n in zip(sizes, ("_mp", "_mr"), strict=True)])
    lp = F.col("_mp") - F.size(col(prompt))
    rp = F.col("_mr") - F.size(col(response))
    return d.select(
        "*",
        F.concat(F.array_repeat(F.lit(pad_id).cast("bigint"), lp), col(prompt).cast("array<bigint>")).alias("prompt_padded"),
        F.concat(F.array_repeat(F.lit(0), lp), F.array_repeat(F.lit(1), F.size(col(prompt)))).alias("prompt_attention"),
        F.concat(col(response).cast("array<bigint>"), F.array_repeat(F.lit(pad_id).cast("bigint"), rp)).alias("response_padded"),
        F.concat(col(mask).cast("array<int>"), F.array_repeat(F.lit(0), rp)).alias("mask_padded"),
        F.concat(F.array_repeat(F.lit(1), F.size(col(response))), F.array_repeat(F.lit(0), rp)).alias("response_attention"),
    ).drop("_mp", "_mr")


def unpad(df: DataFrame, prompt_padded="prompt_padded", prompt_attention="prompt_attention",
          response_padded="response_padded", response_attention="response_attention") -> DataFrame:
    """Strip padding by the attention masks (the inverse of :func:`pad_batch`)."""
    first = F.array_position(col(prompt_attention), 1)
    return df.withColumn("prompt_unpadded", F.when(first > 0, F.slice(col(prompt_padded), first.cast("int"),
                                                                       F.size(col(prompt_padded)))).otherwise(F.array()
                                                                                                                .cast("array<bigint>"))) \
        .withColumn("response_unpadded", F.slice(col(response_padded), 1,
                                                 F.aggregate(col(response_attention), F.lit(0), lambda a, x: a + x)))

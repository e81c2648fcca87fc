"""Trajectory bookkeeping: filling empty trajectories from siblings or a
global complete set (J9), concatenating rollout batches with a consistency
check (U1), and group / trajectory indices for assembled groups (W3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollspark.functions.cols import col, seeded_hash
from rollspark.plans.index import hashed_index


def fill_empty_trajectories(df: DataFrame, instance: str, position: str, messages: str, payload: list[str],
                            order: str) -> DataFrame:
    """A trajectory with empty ``messages`` takes the ``payload`` columns
    of the first non-empty trajectory (by ``position``) of its instance; an
    instance with none takes, for position j, trajectory j mod n of the first
    (by ``order``) instance whose trajectories are all non-empty; without such
    an instance it stays empty. Adds ``fill`` (own / local / global / none).

    One shuffle by instance for the local fallback; the global set is one
    instance's trajectories, joined on position mod its size."""
    ne = F.coalesce(F.size(col(messages)), F.lit(0)) > 0
    d = df.withColumn("_ne", ne)
    pay = F.struct(*[col(c).alias(c) for c in payload])
    inst = d.groupBy(instance).agg(
        F.min_by(F.when(F.col("_ne"), pay), F.when(F.col("_ne"), col(position))).alias("_local"),
        F.min(F.col("_ne").cast("int")).alias("_all"), F.min(col(order)).alias("_first"))
    # first complete instance: a one-row aggregate, attached as a scalar
    first_complete = inst.filter(F.col("_all") == 1).agg(F.min_by(instance, "_first").alias("_g")).select("_g")
    g_id = first_complete.scalar()
    gset = d.filter(col(instance) == g_id)
    g = gset.select(col(position).alias("_gpos"), pay.alias("_global"),
                    F.count(F.lit(1)).over(Window.partitionBy(col(instance))).alias("_gn"))
    n_g = g.agg(F.max("_gn").alias("_gn")).select("_gn").scalar()
    j = d.join(inst.select(instance, "_local"), instance, "left") \
        .withColumn("_key", F.when(~F.col("_ne") & F.col("_local").isNull(), F.pmod(col(position), n_g)))
    j = j.join(g.select("_gpos", "_global"), F.col("_key") == F.col("_gpos"), "left")
    src = F.when(F.col("_ne"), pay).when(F.col("_local").isNotNull(), F.col("_local")) \
        .when(F.col("_global").isNotNull(), F.col("_global")).otherwise(pay)
    fill = F.when(F.col("_ne"), "own").when(F.col("_local").isNotNull(), "local") \
        .when(F.col("_global").isNotNull(), "global").otherwise("none")
    out = j.withColumn("_src", src).withColumn("fill", fill)
    return out.select(*[c for c in df.columns if c not in payload], *[F.col("_src")[c].alias(c) for c in payload],
                      "fill")


def concat_batches(batches: list[DataFrame], logprobs: str = "rollout_logprobs") -> DataFrame:
    """Concatenate rollout batches by column name; a mix of batches with
    and without log-probs is rejected (one job over the log-prob columns of all
    batches, one row per batch)."""
    if not batches:
        raise ValueError("there is no batch to concatenate")
    present = [b.agg(F.coalesce(F.max(col(logprobs).isNotNull()), F.lit(False)).alias("has")) for b in batches if logprobs in b.columns]
    has = [r["has"] for r in reduce(DataFrame.unionByName, present).collect()] if present else []
    if any(has) and not (all(has) and len(has) == len(batches)):
        raise ValueError(f"{sum(has)} of {len(batches)} batches have {logprobs}; either all or none must")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def assemble_groups(df: DataFrame, group: str, traj: str, seed: int = 0) -> DataFrame:
    """``group_idx`` (distributed dense index of the groups in seeded
    order) and ``traj_idx`` (rank of the trajectory inside its group)."""
    groups = df.select(group).distinct().withColumn("_h", seeded_hash(seed, group))
    gi = hashed_index(groups, "_h", tiebreak=[group], name="group_idx").drop("_h")
    trajs = df.select(group, traj).distinct().withColumn(
        "traj_idx", (F.row_number().over(Window.partitionBy(group).orderBy(traj)) - 1).cast("bigint"))
    return df.join(gi, group).join(trajs, [group, traj])

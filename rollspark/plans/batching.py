"""Batch planning: seeded order, splits, batch index, replication, epochs,
curriculum, stratified sampling, shards (O1, O2, O9, O10, B1-B9).

The seeded order is md5(seed|key): every row gets its position from
:func:`hashed_index` (bucket counts + offsets), never from a window over the
whole table. Limits appear only where the limit is the operator (a test split
of N rows, a capped dataset, the last ``limit`` items of a buffer).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollspark.functions.cols import col, seeded_hash, with_scalars
from rollspark.plans.index import hashed_index, whole_batches_index


def seeded_order(df: DataFrame, key, seed: int = 0, name: str = "idx", whole: int | None = None) -> DataFrame:
    """Add ``name``: 0-based position in the md5(seed|key) order (ties by key). With ``whole``, every ``whole`` rows that
    follow each other there from the start stand in one task and share the number ``part``, which is added too."""
    keys = [key] if isinstance(key, str) else list(key)
    if whole:
        return whole_batches_index(df, seeded_hash(seed, *keys), keys, whole, name)
    d = df.withColumn("_sh", seeded_hash(seed, *keys))
    return hashed_index(d, "_sh", tiebreak=keys, name=name).drop("_sh")


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_n"))


def batch_index(df: DataFrame, key, batch_size: int, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """Seeded batch assignment (B1): ``idx`` in seeded order, ``batch_id`` =
    idx div batch_size; with ``drop_last`` the incomplete tail batch is removed;
    ``n_batches`` is ceil (or floor with drop_last) of N / batch_size."""
    d = seeded_order(df, key, seed)
    n = count_rows(df)
    d = with_scalars(d, n)
    nb = F.floor(F.col("_n") / batch_size) if drop_last else F.ceil(F.col("_n") / batch_size)
    d = d.withColumn("batch_id", F.floor(F.col("idx") / batch_size).cast("bigint")) \
        .withColumn("n_batches", nb.cast("bigint"))
    if drop_last:
        d = d.filter(F.col("batch_id") < F.col("n_batches"))
    return d.drop("_n")


def train_test_split(df: DataFrame, key, n_test: int, seed: int = 0):
    """Seeded shuffle, first ``n_test`` rows are the test set, the rest train (O1)."""
    d = seeded_order(df, key, seed)
    return d.filter(F.col("idx") < n_test), d.filter(F.col("idx") >= n_test)


def cap_rows(df: DataFrame, key, n: int, seed: int = 0) -> DataFrame:
    """First ``n`` rows after the seeded shuffle."""
    return seeded_order(df, key, seed).filter(F.col("idx") < n)


def stratified_sample(df: DataFrame, stratum, key, k: int, seed: int = 0) -> DataFrame:
    """Up to ``k`` rows per stratum in seeded order (O2). The ``row_number <= k``
    filter is planned as a group limit, so each map task forwards at most k rows
    per stratum: a stratum holding a third of the data costs no more."""
    h = seeded_hash(seed, *([key] if isinstance(key, str) else key))
    w = Window.partitionBy(col(stratum)).orderBy(h, col(key) if isinstance(key, str) else col(key[0]))
    return df.withColumn("rank_in_stratum", F.row_number().over(w)).filter(F.col("rank_in_stratum") <= k)


def keep_last(df: DataFrame, seq, limit: int) -> DataFrame:
    """FIFO buffer: the ``limit`` newest items by ``seq`` (O9), a top-k."""
    return df.orderBy(col(seq).desc()).limit(limit)


def replicate(df: DataFrame, n: int, uid=None) -> DataFrame:
    """Each prompt n times under one uid (B2): adds ``sample_idx`` 0..n-1."""
    if n < 1:
        raise ValueError("n must be at least 1")
    d = df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if uid is not None:
        d = d.withColumn("uid", col(uid).cast("string"))
    return d


def near_equal_parts(df: DataFrame, idx, n_total, k: int) -> DataFrame:
    """Part number of each row when N rows in order are split into k parts with
    numpy linspace edges int(i * (N / k)) (B3): sizes differ by at most 1."""
    i = col(idx).cast("double")
    n = col(n_total).cast("double")
    step = n / F.lit(float(k))

    def edge(p):
        return F.when(p >= k, n).otherwise(F.floor(p.cast("double") * step))
    p0 = F.least(F.floor(i / step), F.lit(k - 1)).cast("int")
    p = p0 + F.when(i >= edge(p0 + 1), 1).otherwise(0) - F.when(i < edge(p0), 1).otherwise(0)
    return df.withColumn("part", p.cast("int"))


def chunk_ids(df: DataFrame, idx, chunk_size: int) -> DataFrame:
    """Fixed-size chunks in order (B3, chunk): chunk = idx div chunk_size."""
    return df.withColumn("chunk", F.floor(col(idx) / chunk_size).cast("bigint"))


def even_shards(df: DataFrame, idx, n_total, dp_size: int):
    """Even data-parallel shards (B4): with at least ``dp_size`` rows keep the
    first N - N % dp_size; with fewer, repeat the first dp_size - N rows.
    Returns (rows, n_added)."""
    n = col(n_total)
    keep = df.filter((n < dp_size) | (col(idx) < n - n % dp_size))
    extra = df.filter((n < dp_size) & (col(idx) < F.lit(dp_size) - n)).withColumn("repeated", F.lit(True))
    out = keep.withColumn("repeated", F.lit(False)).unionByName(extra)
    added = df.agg(F.max(F.when(n < dp_size, F.lit(dp_size) - n).otherwise(0)).alias("n_added"))
    return out, added


def repeat_epochs(df: DataFrame, n_epochs: int, split: str = "train", source="data_source") -> DataFrame:
    """Epoch repeat (B5): train rows n times; test rows n times with the source
    suffixed '_i' per epoch."""
    if n_epochs < 1:
        raise ValueError("n_epochs must be at least 1")
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_epochs - 1).cast("bigint"))))
    if split == "test":
        e = e.withColumn(source, F.concat(col(source), F.lit("_"), F.col("epoch").cast("string")))
    return e


# Curriculum stages (repeats, group size) in order.
CURRICULUM = ((2, 8), (10, 16), (12, 32), (14, 64))


def curriculum(stages, plan=CURRICULUM) -> DataFrame:
    """Four-stage curriculum (B6): stage s repeated ``plan[s][0]`` times with
    group size ``plan[s][1]``, stages in order (``stage``, ``repeat`` columns)."""
    parts = []
    for s, (df, (reps, gsize)) in enumerate(zip(stages, plan)):
        if reps < 1:
            raise ValueError("every curriculum stage needs at least one repeat")
        parts.append(df.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))))
                     .withColumn("stage", F.lit(s))
                     .withColumn("group_size", F.lit(gsize)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def fractional_repeats(df: DataFrame, key, num_repeats: float, seed: int = 0) -> DataFrame:
    """ceil(r) seeded passes over the data, cut to ceil(r * N) rows."""
    import math
    passes = int(math.ceil(num_repeats))
    if passes < 1:
        raise ValueError("num_repeats must be positive")
    d = df.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(passes - 1).cast("bigint"))))
    keys = [key] if isinstance(key, str) else list(key)
    d = d.withColumn("_sh", seeded_hash(seed, "pass", *keys))
    d = hashed_index(d, "_sh", partition_by=["pass"], tiebreak=keys, name="_in_pass")
    n = count_rows(df)
    d = with_scalars(d, n).withColumn("position", F.col("pass") * F.col("_n") + F.col("_in_pass"))
    return d.filter(F.col("position") < F.ceil(F.col("_n") * F.lit(num_repeats))).drop("_sh", "_in_pass", "_n")


def mixed_batches(datasets, groups_per_batch, key, seed: int = 0) -> DataFrame:
    """Batches mixing several datasets (B8): dataset i contributes
    ``groups_per_batch[i]`` rows to every batch; the number of batches is the
    shortest dataset's; rows keep ``dataset_index``."""
    parts, nbs = [], []
    for i, (df, g) in enumerate(zip(datasets, groups_per_batch)):
        d = seeded_order(df, key, seed).withColumn("dataset_index", F.lit(i)) \
            .withColumn("batch_id", F.floor(F.col("idx") / g).cast("bigint"))
        parts.append(d)
        nbs.append(df.agg(F.floor(F.count(F.lit(1)) / g).alias("nb")))
    nb = reduce(lambda a, b: a.unionByName(b), nbs).agg(F.min("nb").alias("_nb"))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return with_scalars(u, nb).filter(F.col("batch_id") < F.col("_nb")).drop("_nb")


def swap_augment(df: DataFrame, a="completion_A", b="completion_B", label="label", mode: str = "both",
                 key=None, seed: int = 0) -> DataFrame:
    """A/B swap augmentation (B9): 'both' emits each comparison in both orders
    (label A <-> B swapped, Tie kept); 'coin' swaps when a seeded hash bit is 1."""
    swapped_label = F.when(col(label) == "A", "B").when(col(label) == "B", "A").otherwise(col(label))
    if mode == "both":
        orig = df.withColumn("swapped", F.lit(False))
        sw = df.withColumn("_t", col(a)).withColumn(a, col(b)).withColumn(b, F.col("_t")).drop("_t") \
            .withColumn(label, swapped_label).withColumn("swapped", F.lit(True))
        return orig.unionByName(sw)
    flip = F.substring(seeded_hash(seed, key), 1, 1).isin(*"89abcdef")
    return df.select(*[c for c in df.columns if c not in (a, b, label)],
                     F.when(flip, col(b)).otherwise(col(a)).alias(a),
                     F.when(flip, col(a)).otherwise(col(b)).alias(b),
                     F.when(flip, swapped_label).otherwise(col(label)).alias(label),
                     flip.alias("swapped"))

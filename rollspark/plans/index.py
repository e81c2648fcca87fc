"""Distributed dense index over a seeded hash order (B1 building block).

``row_number()`` over a window without ``partitionBy`` moves every row into one
task, and over ``partitionBy(group)`` moves a hot group into one task. So groups
are counted first. Those of at most ``LARGE`` rows are numbered by that window,
which moves each row once; for the larger ones, or without groups, the order key,
an md5 hex string, splits each group by its first three hex digits
into 4096 order-preserving buckets: bucket sizes come from a partial
aggregation, running offsets are a window over the (small) bucket-count table,
and the final ``row_number`` runs per (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollspark.functions.arrays import narrowed, widened
from rollspark.plans.groups import key_text, split_large

BUCKET_HEX_DIGITS = 3  # 4096 buckets per group; a larger table takes more digits


def hashed_index(df: DataFrame, hash_col: str | Column, partition_by=(), tiebreak=(),
                 name: str = "idx", hex_digits: int = BUCKET_HEX_DIGITS) -> DataFrame:
    """Add ``name``: 0-based rank of each row inside ``partition_by`` ordered by
    (``hash_col``, ``tiebreak``...). Equal to
    ``row_number() over (partition by ... order by hash_col, tiebreak) - 1``;
    null groups are groups, null hashes come first. A hash given as an expression
    of ``df``'s columns is computed where the rows have been moved to; without
    larger groups the result is partitioned by ``partition_by``.
    """
    h = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    parts = list(partition_by)
    if not parts:
        return _in_buckets(df, h, parts, tiebreak, name, hex_digits)
    small, large = split_large(df, parts)
    w = Window.partitionBy(*parts).orderBy("_hh", *tiebreak)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = small.repartition(n, *parts).withColumn("_hh", h).withColumn(name, (F.row_number().over(w) - 1).cast("bigint")).select(*df.columns, name)
    return out if large is None else out.unionByName(_in_buckets(large, h, parts, tiebreak, name, hex_digits))


def whole_batches_index(df: DataFrame, h: Column, tiebreak, size: int, name: str = "idx", part: str = "part", hex_digits: int = 4) -> DataFrame:
    """:func:`hashed_index` without groups, delivered so that the rows of a batch of ``size`` consecutive places stand in
    one task: all of them have the same ``part``, which the result is partitioned by. Each row moves once, its arrays
    of numbers as narrow as they are.

    The rows are counted by hash-prefix bucket (a bounded table); a part is a stretch of buckets with about as many rows
    as the others. A part also gets the buckets that its last batch reaches into, and leaves the rows of the batch that
    began before it to the part before; so the rows of those few buckets move twice."""
    b = F.coalesce(F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("int"), F.lit(-1))
    counts = sorted((r["_hb"], r["_hn"]) for r in df.select(b.alias("_hb")).groupBy("_hb").agg(F.count(F.lit(1)).alias("_hn")).collect())
    total = sum(n for _, n in counts)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most, rows, offset, starts = max(size, -(-total // (4 * tasks))), [], 0, []
    for _, n in counts:  # the place where each part's first bucket begins
        if not starts or offset - starts[-1] >= most:
            starts.append(offset)
        offset += n
    up = lambda x: -(-x // size) * size
    ends, offset, first = [*starts[1:], total], 0, 0
    for bucket, n in counts:
        while up(ends[first]) <= offset:
            first += 1
        k = first  # parts that the bucket has rows of, or that count its rows
        while k < len(starts) and starts[k] < offset + n:
            rows.append((bucket, k))
            k += 1
        offset += n
    make = df.sparkSession.createDataFrame
    of = make(rows, f"_hb int, `{part}` int")
    about = make([(k, starts[k], up(starts[k]), up(ends[k])) for k in range(len(starts))], f"`{part}` int, _hoff long, _hlo long, _hhi long")
    # by where they were read, rows with equal keys have the same order in both parts that a bucket went to
    d = narrowed(df).withColumn("_tie", F.monotonically_increasing_id()).withColumn("_hb", b).join(F.broadcast(of), "_hb").drop("_hb").repartition(tasks, part)
    d = widened(d, df).withColumn("_hh", h).join(F.broadcast(about), part)
    w = Window.partitionBy(part).orderBy("_hh", *tiebreak, "_tie")
    d = d.withColumn(name, (F.col("_hoff") + F.row_number().over(w) - 1).cast("bigint"))
    return d.where((F.col(name) >= F.col("_hlo")) & (F.col(name) < F.col("_hhi"))).select(*df.columns, name, part)


def _in_buckets(df: DataFrame, h: Column, parts: list[str], tiebreak, name: str, hex_digits: int) -> DataFrame:
    b = F.coalesce(F.conv(F.substring(F.col("_hh"), 1, hex_digits), 16, 10).cast("int"), F.lit(-1))
    # the group as one text that is never null: the join and the window partition by the same plain columns
    d = df.withColumn("_hh", h).withColumn("_hp", key_text(df, parts) if parts else F.lit("")).withColumn("_hb", b)
    counts = d.groupBy("_hp", "_hb").agg(F.count(F.lit(1)).alias("_hn"))
    wcum = Window.partitionBy("_hp").orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_hp", "_hb", F.coalesce(F.sum("_hn").over(wcum), F.lit(0)).alias("_hoff"))
    if not parts and hex_digits <= 4:
        # at most 16**hex_digits rows: a proven bound, safe to broadcast
        offs = F.broadcast(offs)
    w = Window.partitionBy("_hp", "_hb").orderBy("_hh", *tiebreak)
    return d.join(offs, ["_hp", "_hb"]).select(*df.columns, (F.col("_hoff") + F.row_number().over(w) - 1).cast("bigint").alias(name))

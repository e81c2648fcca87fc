"""Dense positions, running sums and ranks by any order, without a window over
a whole group (a hot group would be sorted in one task).

The rows are dealt and sorted by ranges of (group, order) once and written as a
table: the ranges' bounds come from a sample of the values, so sparse or clumped
values make even ranges, and equal rows are told apart by where they were read,
so a range is never stuck on one value. A row's place in its range is where it
was written; what comes before the range is a running sum over one row per
(group, range), and a group has at most as many ranges as the session has
shuffle partitions. Cutting the lineage there also means that what is above is
computed once, however often the numbered rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollspark.plans.groups import key_text, split_large
from rollspark.session import materialize as write_once


def ranged(df: DataFrame, order, partition_by=(), ranges: int | None = None) -> DataFrame:
    """``df``, written once in (group, order) ranges, with ``_pk`` (the group's key as text), ``_range`` and ``_at``
    (ascending with the order inside a range). ``ranges`` is their number, by default that of shuffle partitions."""
    parts, order = list(partition_by), list(order)
    here = F.monotonically_increasing_id()
    by = ["_pk", *order, "_tie"]
    d = df.withColumn("_pk", key_text(df, parts) if parts else F.lit("")).withColumn("_tie", here)
    d = d.repartitionByRange(ranges, *by) if ranges else d.repartitionByRange(*by)
    d = write_once(d.sortWithinPartitions(*by).drop("_tie").withColumn("_at", here), "ranged")
    return d.withColumn("_range", F.shiftright("_at", 33))


def _starts(d: DataFrame, held: Column) -> DataFrame:
    """(_pk, _range): the group's first place in the range and the sum of ``held`` over the ranges before."""
    w = Window.partitionBy("_pk").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy("_pk", "_range").agg(held.alias("_range_held"), F.min("_at").alias("_range_first"))
    return per.select("_pk", "_range", "_range_first", F.coalesce(F.sum("_range_held").over(w), F.lit(0)).alias("_range_before"))


def _ranges_of(df: DataFrame, bucket_size: int | None) -> int | None:
    return max(1, -(-df.count() // bucket_size)) if bucket_size else None


def ordered_index(df: DataFrame, order_col: str, partition_by=(), bucket_size: int | None = None,
                  name: str = "pos") -> DataFrame:
    """0-based position of each row inside ``partition_by`` by ascending
    ``order_col`` (nulls first; ties in the order in which they were read).

    Groups of at most ``LARGE`` rows are numbered by a window, which moves each row
    once (not at all if ``df`` is partitioned by the groups); only the rows of
    larger ones are dealt in ranges. ``bucket_size`` asks for ranges of
    about that many rows, for all groups."""
    if partition_by and not bucket_size:
        small, large = split_large(df, list(partition_by))
        w = Window.partitionBy(*partition_by).orderBy(F.col(order_col), "_tie")
        out = small.withColumn("_tie", F.monotonically_increasing_id()).withColumn(name, (F.row_number().over(w) - 1).cast("bigint")).select(*df.columns, name)
        return out if large is None else out.unionByName(_in_ranges(large, order_col, partition_by, None, name))
    return _in_ranges(df, order_col, partition_by, bucket_size, name)


def _in_ranges(df: DataFrame, order_col: str, partition_by, bucket_size: int | None, name: str) -> DataFrame:
    d = ranged(df, [order_col], partition_by, _ranges_of(df, bucket_size))
    d = d.join(_starts(d, F.count(F.lit(1))), ["_pk", "_range"])
    return d.select(*df.columns, (F.col("_at") - F.col("_range_first") + F.col("_range_before")).cast("bigint").alias(name))


def ordered_cumsum(df: DataFrame, order_col: str, value_col: str, partition_by=(), bucket_size: int | None = None,
                   name: str = "cum") -> DataFrame:
    """Running sum of ``value_col`` (inclusive) inside ``partition_by`` by
    ascending ``order_col``, in the ranges of :func:`ordered_index`."""
    d = ranged(df, [order_col], partition_by, _ranges_of(df, bucket_size))
    w = Window.partitionBy("_pk", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(_starts(d, F.sum(value_col)), ["_pk", "_range"])
    return d.select(*df.columns, (F.col("_range_before") + F.sum(value_col).over(w)).alias(name))


def score_rank(df: DataFrame, score: str, tiebreak: str, buckets: int | None = None, name: str = "rank") -> DataFrame:
    """Exact 0-based rank of every row by (``score``, ``tiebreak``) over the
    whole frame. ``buckets`` is the number of ranges; a score that many rows
    share is split among ranges by its ties."""
    d = ranged(df, [F.col(score).cast("double"), F.col(tiebreak)], ranges=buckets)
    d = d.join(_starts(d, F.count(F.lit(1))), ["_pk", "_range"])
    return d.select(*df.columns, (F.col("_at") - F.col("_range_first") + F.col("_range_before")).cast("bigint").alias(name))

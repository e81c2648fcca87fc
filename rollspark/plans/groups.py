"""Statistics of a group on each of its rows, whatever the sizes of the groups.

The groups' aggregates are one pre-aggregated shuffle on the group key. The
rows meet them in one more shuffle, but the rows of the ``HEAVY`` largest groups
do not: their aggregates, a table of at most ``HEAVY`` rows, are attached where
the rows are, and those rows are spread over all tasks. Any group with more than
1/HEAVY of the rows is among them, so no task gets more than that of one group.

The key is turned into text that is never null, so a null key is a group like
any other and the join stays an equality of one column, which both shuffles
partition by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, MapType, StringType, StructType, VariantType

#: How many of the largest groups are attached without a shuffle; also the bound of what is broadcast.
HEAVY = 256


def keys_of(group) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def key_text(df: DataFrame, keys: list[str]) -> Column:
    """One text per combination of keys, nulls included; it starts with ``=``, ``{`` or is empty."""
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, (IntegralType, StringType)):
        return F.coalesce(F.concat(F.lit("="), F.col(keys[0]).cast("string")), F.lit(""))
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))


def _spread(df: DataFrame) -> Column:
    """A number from the row's plain columns: the same on every attempt of a task."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    return F.pmod(F.xxhash64(F.lit(0), *[F.col(c) for c in plain]), F.lit(1 << 20))


#: Rows of a group from which on its rows are dealt over tasks instead of being sorted in one.
LARGE = 500_000


def split_large(df: DataFrame, keys: list[str], large: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of ``keys`` with at most ``large`` rows, rows of the larger groups or None if there are none).

    Counts the groups, reading the key columns only; the keys of the larger ones, of which there are at most
    rows / ``large``, are collected."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gn")).filter(F.col("_gn") > (large or LARGE)).select(*keys)
    found = counts.collect()
    if not found:
        return df, None
    top = df.sparkSession.createDataFrame(found, counts.schema).toDF(*[f"_l{i}" for i in range(len(keys))])
    meets = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)])
    return df.join(F.broadcast(top), meets, "left_anti"), df.join(F.broadcast(top), meets, "left_semi")


def with_group(df: DataFrame, group, aggs: list[Column], heavy: int = HEAVY) -> DataFrame:
    """``df`` with the aggregates ``aggs`` (each with an alias) of the row's group."""
    keys = keys_of(group)
    d = df.withColumn("_gk", key_text(df, keys))
    stats = d.groupBy("_gk").agg(F.count(F.lit(1)).alias("_gn"), *aggs)
    names = stats.columns[1:]
    top = stats.orderBy(F.col("_gn").desc(), "_gk").limit(heavy) \
        .select(F.col("_gk").alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in names])
    d = d.join(F.broadcast(top), F.col("_gk") == F.col("_hk"), "left")
    apart = F.concat(F.lit("#"), _spread(df).cast("string"))
    d = d.withColumn("_rk", F.when(F.col("_hk").isNull(), F.col("_gk")).otherwise(apart))
    d = d.join(stats.withColumnsRenamed({"_gk": "_sk"} | {c: f"_s_{c}" for c in names}), F.col("_rk") == F.col("_sk"), "left")
    return d.select(*df.columns, *[F.coalesce(f"_h_{c}", f"_s_{c}").alias(c) for c in names if c != "_gn"])

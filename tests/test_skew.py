"""Skew-safe planning pieces on a hot key: one uid holds a third of the rows
(and one score value most of them); results must equal a plain window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspark.functions.cols import seeded_hash
from rollspark.plans.index import hashed_index
from rollspark.plans.ordered import ordered_index, score_rank


def _hot(spark, n=30000):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997).alias("uid"),
        F.when(F.col("id") % 5 < 4, F.lit(7.0)).otherwise((F.col("id") % 13).cast("double")).alias("score"))


def test_hashed_index_hot_group(spark):
    d = _hot(spark).withColumn("h", seeded_hash(0, "id"))
    got = hashed_index(d, "h", ["uid"], tiebreak=["id"], name="idx")
    want = d.withColumn("w", F.row_number().over(Window.partitionBy("uid").orderBy("h", "id")) - 1)
    bad = got.join(want, ["id"]).filter(F.col("idx") != F.col("w")).count()
    assert bad == 0


def test_ordered_index_hot_group(spark):
    d = _hot(spark)
    got = ordered_index(d, "id", ["uid"], bucket_size=512, name="pos")
    want = d.withColumn("w", F.row_number().over(Window.partitionBy("uid").orderBy("id")) - 1)
    assert got.join(want, ["id"]).filter(F.col("pos") != F.col("w")).count() == 0


def test_score_rank_heavy_ties(spark):
    d = _hot(spark).withColumn("tb", seeded_hash(0, "id"))
    got = score_rank(d, "score", "tb", buckets=8, name="rank")
    want = d.withColumn("w", F.row_number().over(Window.orderBy("score", "tb")) - 1)
    assert got.join(want, ["id"]).filter(F.col("rank") != F.col("w")).count() == 0
    assert got.agg(F.countDistinct("rank")).first()[0] == d.count()

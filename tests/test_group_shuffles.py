"""Estimators of the same rows move them to their groups once, whatever the groups' sizes and keys."""

import math
from collections import defaultdict
from functools import reduce

import pytest
from pyspark.sql import functions as F

from rollspark.operators import advantages as ADV
from rollspark.plans import groups


def rows(spark):
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i % 7 != 0, F.when(i % 3 == 0, F.lit(0).cast("long")).otherwise(i % 97)).alias("uid"), F.concat(F.lit("s"), i % 500).alias("sample_key"),
        F.when(i % 11 != 0, (i % 5).cast("double")).alias("reward"))


@pytest.mark.parametrize("large", [20, 500_000])
def test_statistics_of_small_large_and_null_groups(spark, monkeypatch, large):
    monkeypatch.setattr(groups, "LARGE", large)
    df = rows(spark)
    by = defaultdict(list)
    for r in df.collect():
        by[r["uid"]].append(r["reward"])
    got = ADV.with_group_stats(df).collect()
    assert len(got) == 3000 and {r["uid"] for r in got} == set(by)
    for r in got:
        x = [v for v in by[r["uid"]] if v is not None]
        mean = sum(x) / len(x)
        assert r["g_n"] == len(by[r["uid"]]) and r["g_min"] == min(x) and r["g_max"] == max(x) and math.isclose(r["g_sum"], sum(x))
        assert math.isclose(r["g_mean"], mean) and math.isclose(r["g_std_pop"], math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)), abs_tol=1e-12)


def test_estimators_share_one_shuffle_of_the_rows(spark, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    out = reduce(lambda a, b: a.unionByName(b), [ADV.get_estimator(n)(df).select("uid", "sample_key", "advantage") for n in ("grpo", "rloo", "group_centered")])
    assert len(out.collect()) == 9000
    moved = out._jdf.queryExecution().executedPlan().toString()
    moved = moved[:moved.index("== Initial Plan ==")] if "== Initial Plan ==" in moved else moved
    assert sum("Exchange hashpartitioning" in x and "Reused" not in x for x in moved.splitlines()) == 1

"""Token terms over flat buffers against the interpreted SQL forms, with nulls and odd lengths."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rollspark.functions.arrays import dsum, masked_sum, place_weighted_sum, tokens
from rollspark.operators import losses as L

NAN = float("nan")
ROWS = [(0, [0.5, -1.0, 2.0], [0.1, 0.2, 0.3], [1, 0, 1]), (1, [], [], []), (2, None, [1.0], [1]), (3, [1.0, None], [0.5, 0.5], [1, 1]),
        (4, [1.0, 2.0], [0.5], [1, 1]), (5, [NAN, 1.0], [0.5, NAN], [1, 0]), (6, [7.0], [None], [1]), (7, [3.0, 4.0, 5.0, 6.0], [1.0, 1.0, 1.0, 1.0], [1, 1, 0, None])]
SCHEMA = "id int, x array<double>, y array<double>, m array<int>"


def same(a, b):
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-12))


def test_flat_sums_and_terms_follow_sql(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    bound = lambda a, b: F.least(F.greatest(a - b, F.lit(-0.5)), F.lit(0.5))
    pairs = {
        "sum": (dsum("x"), fold(F.col("x"))), "ints": (dsum("m"), fold(F.col("m"))),
        "masked": (masked_sum("x", "m"), fold(F.zip_with("x", "m", lambda a, b: a * b.cast("double")))),
        "places": (place_weighted_sum("x"), fold(F.transform("x", lambda v, i: v * (i + 1)))),
        "terms": (tokens(lambda a, b: (a - b).greatest(-0.5).least(0.5), "x", "y"), F.zip_with("x", "y", bound)),
        "above": (tokens(lambda a, b: a.where_above(b, 1.0, 0.0), "x", "y"), F.zip_with("x", "y", lambda a, b: F.when(a > b, 1.0).otherwise(0.0))),
        "of_row": (tokens(lambda a, s: a * s, "x", of_row="id"), F.transform("x", lambda a: a * F.col("id"))),
    }
    got = df.select("id", *[c.alias(f"{n}_{i}") for n, two in pairs.items() for i, c in enumerate(two)]).collect()
    for r in got:
        for n in pairs:
            assert same(r[f"{n}_0"], r[f"{n}_1"]), (r["id"], n, r[f"{n}_0"], r[f"{n}_1"])


def test_losses_interpret_no_lambda_per_token(spark):
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    loss, clip = L.value_loss_tokens("x", "y", "y", 0.05)
    cols = [loss, clip, L.sapo_tokens("x", "y", "x"), *L.gspo_tokens("x", L.gspo_seq_ratio("x", "y", "m")), L.dro_tokens("x", "y", "x", 0.1)]
    plan = df.select(*[masked_sum(c, "m").alias(f"c{i}") for i, c in enumerate(cols)])._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(" not in plan and "aggregate(" not in plan

"""Rows with null keys are kept; SQL answer formats, stop tags and preference pairs by hand-made cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.operators import grade_sql as G
from rollspark.operators import preference as P
from rollspark.operators.advantages import grpo
from rollspark.plans.ordered import ordered_cumsum, ordered_index


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 3), (None, 3.0, 1), (7, 2.0, None), (7, 4.0, 5)], "uid long, reward double, step int")
    assert sorted((r["uid"] or 0, round(r["advantage"], 4)) for r in grpo(df).collect()) == [(0, -0.7071), (0, 0.7071), (7, -0.7071), (7, 0.7071)]
    assert sorted((r["uid"] or 0, r["step"] or 0, r["pos"]) for r in ordered_index(df, "step", ["uid"]).collect()) == [(0, 1, 0), (0, 3, 1), (7, 0, 0), (7, 5, 1)]
    assert ordered_cumsum(df, "step", "reward", ["uid"]).agg(F.max("cum")).first()[0] == 6.0


def verdicts(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in df.select("i", f("t").alias("v")).orderBy("i").collect()]


def test_strict_solution_format(spark):
    cases = {
        "<think>look</think><solution> SELECT 1 </solution>": "SELECT 1",
        "<think>look</think><solution>SELECT <sql>x</sql></solution>": None,
        "<solution>SELECT 1</solution>": None,
        "<think>a</think><observation>r</observation> <THINK>b</think><solution>S</solution>": "S",
        "<think>a</think><observation>r</observation>x<solution>S</solution>": None,
        "<think>a</think></solution><solution>S</solution> </observation>": "S",
        "<think>a</think><solution>S</solution><solution>T</solution>": None,
        "<think>a</think><solution>S</solution></solution>": None,
    }
    assert verdicts(spark, G.solution_format_strict, list(cases)) == list(cases.values())


def test_stop_tags(spark):
    cases = {"no tag": True, "a </sql>": True, "a </sql> ": False, "a </sql> b </sql>": False, "x</solution>": True, "x</solution>y": False, "": True}
    assert verdicts(spark, G.stops_at_tag, list(cases)) == list(cases.values())


def test_pairs_differ_in_the_last_turn_only(spark):
    rows = [(["a", "b"], ["a", "c"]), (["a", "b"], ["a", "b"]), (["a", "b"], ["x", "c"]), (["a"], ["b"]), (["a", "b"], ["a"]), ([], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c array<string>, r array<string>")
    assert [r["v"] for r in df.select("i", P.valid_pair("c", "r").alias("v")).orderBy("i").collect()] == [True, False, False, True, False, False]

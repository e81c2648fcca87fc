"""Result sets: their rows move once, whatever reads them, and large groups go by buckets and ranges with the same numbers."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspark.operators import grade_sql as G
from rollspark.plans import groups
from rollspark.plans.index import hashed_index
from rollspark.plans.ordered import ordered_index
from rollspark.sources.fixtures import sql_results


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_result_rows_move_once(spark, sf_dir):
    rows = sql_results(spark, sf_dir)
    for df in (rows, rows.groupBy("question_id", "side").count(), ordered_index(rows, "row_idx", ["question_id", "side"])):
        assert _plan(df).count("Exchange ") == 1, _plan(df)


def test_grading_writes_the_questions_only(spark, sf_dir, monkeypatch):
    written, once = [], G.write_once
    monkeypatch.setattr(G, "write_once", lambda df, name: written.append(name) or once(df, name))
    rows = sql_results(spark, sf_dir)
    asked = rows.select("question_id").distinct().withColumn("method", F.lit("list"))
    assert G.grade_results(rows, asked, "method").filter("is_correct").count() > 0
    assert written == ["sql_questions"]


@pytest.mark.parametrize("large", [50, 10**6])
def test_large_groups_are_numbered_alike(spark, monkeypatch, large):
    monkeypatch.setattr(groups, "LARGE", large)
    d = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 97).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    w = Window.partitionBy("g").orderBy
    want = d.withColumns({"a": F.row_number().over(w("h")) - 1, "b": F.row_number().over(w("id")) - 1})
    got = hashed_index(d, F.md5(F.col("id").cast("string")), ["g"], name="a").select("id", "a") \
        .join(ordered_index(d, "id", ["g"], name="b").select("id", "b"), "id")
    assert sorted(got.collect()) == sorted(want.select("id", "a", "b").collect())


@pytest.mark.parametrize("large", [3, 10**6])
def test_large_questions_are_graded_alike(spark, monkeypatch, large):
    monkeypatch.setattr(groups, "LARGE", large)
    rows = [(q, side, i, [str(i), "x"] if q < 3 or side == "gold" or i else ["7", "x"]) for q in range(1, 5) for side in ("gold", "pred") for i in range(6)]
    rows += [(4, "pred", None, ["9", None, "w"]), (5, "gold", 0, ["2"]), (5, "pred", 0, ["2.001"])]
    df = spark.createDataFrame(rows, "question_id long, side string, row_idx long, vals array<string>")
    for method, right in (("list", {1, 2, 5}), ("multiset", {1, 2, 5}), ("set", {1, 2, 5}), ("subset,>=,1", {1, 2, 5})):
        asked = spark.range(1, 7).select(F.col("id").alias("question_id"), F.lit(method).alias("method"))
        got = {r["question_id"] for r in G.grade_results(df, asked, "method").filter("is_correct").collect()}
        assert got == right | {6} - ({6} if "subset" in method else set()), method


def test_all_loss_modes_read_the_messages_once(spark, sf_dir):
    import __spark_entry__ as E
    plan = _plan(E.queries()["loss_flags_by_mode"](spark, sf_dir))
    assert plan.count("FileScan") == 1 and "Union" not in plan, plan

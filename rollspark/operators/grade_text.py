"""Table-level grading of free-text answers (C1-C11 composed with J5, V26).

``grade_math`` turns (response, ground truths) rows into graded rows in one
projection: answer extraction, normalisation and comparison against every gold
answer are array/column expressions, so grading is a map-only stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollspark.functions import text as T
from rollspark.functions.cols import col


def as_answer_list(c):
    """Ground truth as ARRAY<STRING>: arrays stay, scalars become one-element arrays."""
    return c if isinstance(c, F.Column) else col(c)


def grade_math(df: DataFrame, response="response", truths="ground_truths", noise_rate: float = 0.0,
               format_only: bool = False) -> DataFrame:
    """Math grading (C1-C5, J5, V26): answer = last \\boxed{} after the
    first '</think>'; truths holding a \\boxed{} are reduced to its content;
    correct when any truth matches; reward is the PGFC value (1/0 without
    noise). Adds ``model_answer``, ``is_correct``, ``reward``, ``reason``."""
    # staged projections: each step is computed once per row and read by
    # name (inside higher-order lambdas a repeated expression is re-evaluated)
    d = df.withColumn("_sol", T.after_think(response)).withColumn("model_answer", T.boxed_answer("_sol"))
    d = d.withColumn("_golds", F.filter(F.transform(col(truths), lambda g: F.when(g.contains("\\boxed"),
                                                                                  T.boxed_answer(g)).otherwise(g)),
                                        lambda g: g.isNotNull()))
    d = d.withColumn("_correct", T.answers_equal("model_answer", "_golds"))
    ans, correct = F.col("model_answer"), F.col("_correct")
    hit, miss = (noise_rate, noise_rate - 1.0) if noise_rate > 0 else (1.0, 0.0)
    empty = col(response).isNull() | (col(response) == "")
    reason = F.when(empty, "Empty or None response").when(ans.isNull(), "Fail to extract answers.") \
        .when(F.lit(format_only), "Formatted answer successfully") \
        .when(F.size("_golds") == 0, "Empty or None post-processed ground truth") \
        .when(correct, "Correct answer").otherwise("Incorrect answer")
    ok = F.when(empty | ans.isNull(), F.lit(False)).when(F.lit(format_only), F.lit(True)) \
        .when(F.size("_golds") == 0, F.lit(False)).otherwise(correct)
    return d.withColumn("is_correct", ok) \
        .withColumn("reward", F.when(ok, F.lit(hit)).otherwise(F.lit(miss))).withColumn("reason", reason) \
        .drop("_sol", "_golds", "_correct")


def undecided_share(df: DataFrame, answer="model_answer", truths="ground_truths") -> DataFrame:
    """One row: graded answers, those that equal a truth, and those that only a symbolic solver could decide."""
    d = df.select(T.answers_equal(answer, truths).alias("_eq"), T.answers_undecided(answer, truths).alias("_open"), col(answer).alias("_a"))
    return d.agg(F.count("_a").alias("n_answers"), F.count_if("_eq").alias("n_equal"), F.count_if("_open").alias("n_undecided")) \
        .withColumn("undecided_share", F.try_divide(F.col("n_undecided"), F.col("n_answers")))


def grade_gsm8k(df: DataFrame, response="response", truth="gold", method="strict",
                random_perturb: bool = False) -> DataFrame:
    """GSM8K scoring."""
    ans = T.gsm8k_strict(response) if method == "strict" else T.gsm8k_flexible(response)
    return df.withColumn("model_answer", ans).withColumn(
        "score", T.gsm8k_score(response, truth, method, random_perturb=random_perturb))


def grade_qa(df: DataFrame, response="response", golds="golden_answers") -> DataFrame:
    """Search-QA scoring (C10): last <answer> tag, exact and substring match
    after normalisation; no tag scores 0."""
    ans = T.last_answer_tag(response)
    return df.withColumn("model_answer", ans) \
        .withColumn("em", F.when(ans.isNull(), 0).otherwise(T.qa_exact_match(ans, golds))) \
        .withColumn("subem", F.when(ans.isNull(), 0).otherwise(T.qa_substring_match(ans, golds)))

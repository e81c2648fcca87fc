import pytest
from pyspark.sql import functions as F

from rollspark.functions import text as T

# the last 300 characters count, the last "Answer:" wins, comparison is of normalised text
CASES = [
    ("Working it out. Answer: 7", "7", 1.0),
    ("Answer: 7 zebras", "7", -1.0),
    ("Answer: 3\nAnswer: $1,250$", "1250", 1.0),
    ("Answer: \\frac12", "\\frac{1}{2}", 1.0),
    ("Answer: x = 9", "9", 1.0),
    ("the value is 7", "7", -1.0),
    ("Answer: 7" + " " * 300 + "end", "7", -1.0),
]


def test_minerva_closed_form(spark):
    df = spark.createDataFrame(CASES, "output string, gt string, expected double")
    score, _ = T.minerva_score("output", "gt")
    for r in df.select("output", "expected", score.alias("s")).collect():
        assert r.s == r.expected, r.output


@pytest.mark.parametrize("raw, want", [("\\text{12 cm}", "12"), ("1,234,567", "1234567"), ("7 3/4", "7+3/4"),
                                       ("{5}", "5"), ("3.0", "3"), ("10%", "10"), ("A or B", "a,b")])
def test_heavy_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string")
    assert T.heavy_normalize(df, "a").first().answer_norm == want


@pytest.mark.parametrize("raw, want", [
    ("1,000,000,000", "1,000,000,000"),  # middle commas keep six digits behind them
    ("1000000000000000000.0", "1000000000000000000"), ("36893488147419103232", "36893488147419103232"),
    ("-1e20", "-100000000000000000000"), ("5d", "5d"), ("inf", "inf"), ("2 million", "2*10^6"), ("", "")])
def test_heavy_normalize_numbers(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string")
    assert T.heavy_normalize(df, "a").first().answer_norm == want


GRADED = [  # given, truth, equal
    ("1,000", "1000", True), ("5 cm", "5", True), ("Yes", "yes", True), ("2 and 3", "2,3", True),
    ("(1, 2]", "(1,2]", True), ("(1,2)", "(1,2]", False), ("(1,0.5)", "(1,0.50)", True), ("(1,2)", "(1,2,3)", False),
    ("[1,234, 5]", "[1234,5]", True),
    ("2/4", "1/2", False), ("1/2", "0.5", True), ("5.0", "5", True), ("5.1", "5", False), ("7 3/4", "7.75", True),
    ("0.250", "1/4", True), ("3 million", "3*10^6", True), ("2^{10}", "1024", False), ("(abc,1)", "(abc,2)", False),
    ("\\frac{3}{4}", "0.75", True), ("0.75", "\\dfrac{3}{4}", True), ("(1,\\frac{1}{2})", "(1,0.5)", True), ("-\\frac34", "-0.75", True),
    ("\\frac{2}{4}", "\\frac{1}{2}", False), ("7\\tfrac{3}{4}", "7.75", True), ("\\frac{1.5}{2}", "0.75", True), ("\\frac{3}{4}", "0.74", False),
    ("\\frac{\\sqrt{2}}{2}", "\\frac{\\sqrt 2}2", True), ("[0, \\infty)", "[0,\\infty )", True), ("3 \\cdot 10^{4}", "3*10^4", True),
    ("\\left(1, 2\\right)", "(1,2)", True), ("\\frac{4}{2}", "2", False), ("2^{10}\\pi", "2^{10} \\pi", True),
    ("x", "", False), ("", "x", False), (None, "1", False), ("1", None, False),
]


def test_answers_equal(spark):
    df = spark.createDataFrame(GRADED, "given string, truth string, want boolean")
    got = df.withColumn("is", T.answers_equal("given", F.array("truth"))).collect()
    assert [(r.given, r.truth) for r in got if r["is"] != r.want] == []
    many = spark.createDataFrame([("4", ["5", "4 cm"])], "given string, truths array<string>")
    assert many.select(T.answers_equal("given", "truths")).first()[0]


def test_undecided_answers(spark):
    from rollspark.operators.grade_text import undecided_share
    cases = [("2(x+1)", "2x+2", True), ("3", "4", False), ("x", "x", False), ("(1,x+1)", "(1,1+x)", True), ("(1,x+1)", "(2,1+x)", False),
             ("a+b+c+d", "d+c+b+a", False), ("sqrt(4)", "2.5", True), (None, "x", False), ("1/2", "2/4", False), ("7", "x", False)]
    df = spark.createDataFrame([(g, [t], w) for g, t, w in cases], "model_answer string, ground_truths array<string>, want boolean")
    got = df.withColumn("is", T.answers_undecided("model_answer", "ground_truths")).collect()
    assert [(r["model_answer"], r["ground_truths"]) for r in got if r["is"] != r["want"]] == []
    assert tuple(undecided_share(df).first()) == (9, 1, 3, 3 / 9)

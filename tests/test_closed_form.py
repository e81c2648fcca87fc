"""Closed-form cases of the reference's own tests (FIXTURES.md), run through
the Spark operators. The oracles check our SQL twin; these check the values
the reference itself expects."""

import math

import pytest
from pyspark.sql import functions as F

from rollspark.functions import text as T
from rollspark.operators import advantages as A
from rollspark.operators import losses as L
from rollspark.operators import metrics as M
from rollspark.operators import select as S
from rollspark.plans import batching as B


def _close(a, b, tol=1e-4):
    assert len(a) == len(b) and all(abs(x - y) <= tol for x, y in zip(a, b)), (a, b)


def test_rloo(spark):
    df = spark.createDataFrame([(0, 0, 6.0), (1, 0, 3.0), (2, 1, 9.0), (3, 1, 12.0), (4, 2, 1.0)],
                               "i int, uid int, reward double")
    got = [r.advantage for r in A.rloo(df).orderBy("i").collect()]
    _close(got, [3.0, -3.0, -3.0, 3.0, 0.0])


def test_grpo_without_std(spark):
    df = spark.createDataFrame([(0, 0, 6.0), (1, 0, 3.0), (2, 1, 9.0), (3, 1, 12.0)], "i int, uid int, reward double")
    got = [r.advantage for r in A.grpo(df, norm_by_std=False).orderBy("i").collect()]
    _close(got, [1.5, -1.5, -1.5, 1.5])


@pytest.mark.parametrize("gamma, lam, want", [(1.0, 1.0, [6.0, 5.0, 3.0]), (0.5, 1.0, [2.75, 3.5, 3.0]),
                                              (1.0, 0.5, [3.625, 4.25, 3.0])])
def test_gae_returns(spark, gamma, lam, want):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 1.0, 1.5], [1.0, 1.0, 1.0])],
                               "r array<double>, v array<double>, m array<double>")
    _close(A.gae(df, "r", "v", "m", gamma=gamma, lam=lam).first().returns, want)


def test_gae_masked_advantages(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 1.0, 1.5], [1.0, 0.0, 1.0])],
                               "r array<double>, v array<double>, m array<double>")
    row = A.gae(df, "r", "v", "m", gamma=1.0, lam=1.0).first()
    _close(row.returns, [6.0, 5.0, 3.0])
    _close(row.advantage_tokens, [0.7071, 0.1768, -0.7071])


@pytest.mark.parametrize("gamma, mask, want", [(1.0, [1.0, 1.0, 0.0], [3.0, 2.0, 3.0]),
                                               (0.5, [1.0, 1.0, 1.0], [2.75, 3.5, 3.0])])
def test_reinforce_pp_returns(spark, gamma, mask, want):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], mask)], "r array<double>, m array<double>")
    _close(A.reinforce_pp(df, "r", "m", gamma=gamma).first().returns, want)


@pytest.mark.parametrize("reduction, want", [("token_mean", 2.5), ("sequence_mean", 3.0),
                                             ("seq_mean_token_sum_norm", 1.25)])
def test_loss_reductions(spark, reduction, want):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 1.0, 1.0]), ([4.0, 5.0, 6.0], [1.0, 0.0, 0.0])],
                               "l array<double>, m array<double>")
    assert abs(L.reduce_tokens(df, F.col("l"), "m", reduction, max_seq_len=4).first().loss - want) < 1e-9


def test_approx_kl_kinds(spark):
    df = spark.createDataFrame([([0.2, 0.3, 0.5], [0.1, 0.2, 0.4], [1.0, 1.0, 0.0])],
                               "lp array<double>, b array<double>, m array<double>")
    k3 = math.exp(-0.1) + 0.1 - 1
    want = {"k1": [0.1, 0.1, 0.0], "abs": [0.1, 0.1, 0.0], "k2": [0.005, 0.005, 0.0], "k3": [k3, k3, 0.0]}
    for kind, w in want.items():
        _close(df.select(L.approx_kl("lp", "b", "m", kind).alias("k")).first().k, w, 1e-6)


def test_pass_at_n_per_source(spark):
    df = spark.createDataFrame([(1, 0.5, "d1"), (2, 0.7, None), (3, 0.9, "d1"), (4, 0.4, None)],
                               "uid int, reward double, data_source string")
    got = {r.data_source: r for r in M.pass_at_n(df, source="data_source").collect()}
    assert abs(got["d1"].avg_score - 0.7) < 1e-9 and got["d1"].pass_at_n == 1.0
    assert abs(got["unknown"].avg_score - 0.55) < 1e-9 and got["unknown"].pass_at_n == 1.0


def test_dynamic_filter_keeps_varied_groups(spark):
    df = spark.createDataFrame([("uid1", 1.0), ("uid1", 2.0), ("uid2", 3.0), ("uid2", 3.0)], "uid string, reward double")
    assert {r.uid for r in S.dynamic_filter(df, n_samples_per_prompt=2).collect()} == {"uid1"}


@pytest.mark.parametrize("text, truth, want", [("#### 42", "42", 1.0), ("#### 42", "43", 0.0), ("42", "42", 0.0)])
def test_gsm8k_score(spark, text, truth, want):
    df = spark.createDataFrame([(text, truth)], "t string, g string")
    assert df.select(T.gsm8k_score("t", "g").alias("s")).first().s == want


@pytest.mark.parametrize("pred, golds, want", [
    ("Emmanuel Macron", ["Emmanuel Macron"], 1), ("emmanuel macron", ["Emmanuel Macron"], 1),
    ("The Emmanuel Macron", ["Emmanuel Macron"], 1), ("Emmanuel Macron!", ["Emmanuel Macron"], 1),
    ("Nicolas Sarkozy", ["Emmanuel Macron"], 0), ("Emmanuel Macron", ["Emmanuel Macron", "Macron"], 1),
    ("Sarkozy", ["Emmanuel Macron", "Macron"], 0)])
def test_qa_exact_match(spark, pred, golds, want):
    df = spark.createDataFrame([(pred, golds)], "p string, g array<string>")
    assert df.select(T.qa_exact_match("p", "g").alias("m")).first().m == want


@pytest.mark.parametrize("k, sizes", [(2, [2, 3]), (3, [1, 2, 2])])
def test_near_equal_parts(spark, k, sizes):
    df = spark.createDataFrame([(i, 5) for i in range(5)], "idx long, n long")
    parts = B.near_equal_parts(df, "idx", "n", k).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == sizes


def test_overlong_filter_zeroes_what_does_not_end_in_eos(spark):
    """A response keeps its mask only if its last token is EOS; EOS elsewhere does not count."""
    eos = 50
    cases = [
        ([17, 50], [0, 1], [0, 1]),
        ([50], [1], [1]),
        ([50, 17], [1, 1], [0, 0]),
        ([17, 50, 50, 18, 50], [1, 0, 1, 1, 1], [1, 0, 1, 1, 1]),
        ([17, 18, 51], [1, 0, 1], [0, 0, 0]),
        ([], [1, 1, 1], [0, 0, 0]),
        ([], [], []),
    ]
    df = spark.createDataFrame([(i, m, r) for i, (r, m, _) in enumerate(cases)], "i int, loss_mask array<int>, response_ids array<int>")
    got = [list(r.loss_mask) for r in S.overlong_filter(df, eos_token_id=eos).orderBy("i").collect()]
    assert got == [want for _, _, want in cases]


def test_replace_sampling(spark):
    rows = [("uid1", 0, 1.0), ("uid1", 1, 2.0), ("uid2", 0, 1.0), ("uid2", 1, 1.0), ("uid3", 0, 3.0), ("uid3", 1, 4.0)]
    df = spark.createDataFrame(rows, "uid string, sample_idx int, reward double")
    out, status = S.replace_bad_groups(df, 2, 0.3)
    got = out.collect()
    assert len(got) == 6 and all(r.uid != "uid2" for r in got)
    assert status.first().keep_sampling is False


def test_replace_sampling_too_few_good(spark):
    df = spark.createDataFrame([("uid1", 0, 1.0), ("uid1", 1, 1.0), ("uid2", 0, 2.0), ("uid2", 1, 2.0)],
                               "uid string, sample_idx int, reward double")
    out, status = S.replace_bad_groups(df, 2, 0.3)
    assert sorted((r.uid, r.reward) for r in out.collect()) == [("uid1", 1.0), ("uid1", 1.0), ("uid2", 2.0), ("uid2", 2.0)]
    assert status.first().keep_sampling is True


def test_merge_turns_two_sequences(spark):
    from rollspark.operators.sequences import merge_turns
    # (O1, A1), (O1 + A1 + O2, A2), (O3, A3): the second turn extends the first
    df = spark.createDataFrame([(1, 0, [1], [2]), (1, 1, [1, 2, 3], [4]), (1, 2, [5], [6])],
                               "traj_id int, step int, ob array<int>, ac array<int>")
    got = [r.seq_no for r in merge_turns(df).orderBy("step").collect()]
    assert got == [0, 0, 1]

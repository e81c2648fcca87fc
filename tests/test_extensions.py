import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from rollspark.operators import registry as X
from rollspark.operators import trajectories as TR
from rollspark.sources.fixtures import responses


def test_policy_loss_registry_errors():
    assert {"regular", "dual_clip", "sapo", "reinforce"} <= set(X.POLICY_LOSSES.names())
    with pytest.raises(ValueError):
        X.POLICY_LOSSES.register("regular", lambda *a, **k: None)
    with pytest.raises(ValueError):
        X.POLICY_LOSSES.get("nope")
    X.POLICY_LOSSES.register("tmp", lambda lp, old, adv, **k: adv)
    X.POLICY_LOSSES.unregister("tmp")
    assert "tmp" not in X.POLICY_LOSSES.names()


def test_grade_by_env_matches_each_grader(spark, sf_dir):
    got = {r.response_id: (r.env_class, r.score) for r in E.queries()["graders_by_env"](spark, sf_dir).collect()}
    r = responses(spark, sf_dir)
    for env in X.GRADERS.names():
        direct = {x.response_id: x.s for x in
                  r.select("response_id", X.GRADERS.get(env)(F.col("response"), F.col("gold")).cast("double").alias("s"))
                  .collect()}
        for rid, (e, s) in got.items():
            if e == env:
                assert s == direct[rid], (env, rid)
    assert all(s is None for e, s in got.values() if e == "unknown")


def test_concat_batches_rejects_mixed_logprobs(spark):
    a = spark.createDataFrame([(1, [0.1])], "uid int, rollout_logprobs array<double>")
    b = spark.createDataFrame([(2, None)], "uid int, rollout_logprobs array<double>")
    with pytest.raises(ValueError):
        TR.concat_batches([a, b])
    assert TR.concat_batches([a, a]).count() == 2


def test_policy_losses_one_pass_equals_each(spark, sf_dir):
    from rollspark.catalog.losses import _tok
    df = _tok(spark, sf_dir)
    both = {r.loss_name: r.loss for r in X.policy_losses(df, X.POLICY_LOSSES.names(), "log_probs",
                                                         "rollout_logprobs", "adv", "loss_mask").collect()}
    for n in X.POLICY_LOSSES.names():
        one = X.policy_loss(df, n, "log_probs", "rollout_logprobs", "adv", "loss_mask").first().loss
        assert abs(both[n] - one) < 1e-9, n

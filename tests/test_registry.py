import pytest

from rollspark.operators import advantages as A


def test_estimator_registry_roundtrip():
    assert {"grpo", "rloo", "gae"} <= set(A.list_estimators())
    assert A.get_estimator("grpo") is A.grpo
    A.register_estimator("tmp_est", A.grpo)
    with pytest.raises(ValueError):
        A.register_estimator("tmp_est", A.grpo)
    A.unregister_estimator("tmp_est")
    assert "tmp_est" not in A.list_estimators()
    with pytest.raises(ValueError):
        A.get_estimator("tmp_est")

"""Every registered query against its DuckDB oracle on the smallest tables:
same columns, same row count, same multiset of rows."""

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    r = compare(spark, duck, name, QUERIES[name], ORACLE.get(name), sf_dir)
    assert r.get("ok") is not False, r.get("why")


# checked against a brute-force Python model on small fixtures instead (tests/test_parts.py)
ROWS_ONLY = {"content_blocks", "code_tests_normalized", "policy_loss_registry", "graders_by_env"}


def test_every_query_has_oracle():
    """Of the library's own queries; those of the optional subpackage have their own tests."""
    from rollspark.catalog import load_all
    own, sql = load_all()
    assert set(own) - set(sql) == ROWS_ONLY


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns

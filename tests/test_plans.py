"""Plan shape: scans read only the columns a query needs, and no plan uses a
nested-loop (cross) join."""

import re

import __spark_entry__ as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_scan_prunes_columns(spark, sf_dir):
    p = _plan(E.queries()["pass_at_n_by_source"](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    li = [s for s in schemas if "l_orderkey" in s]
    assert li, p
    assert all("l_extendedprice" not in s and "l_shipdate" not in s for s in li), li


def test_no_nested_loop_joins(spark, sf_dir):
    qs = E.queries()
    for n in ["normalized_advantages", "batch_index", "replace_bad_groups", "mixed_batches", "fractional_repeats",
              "kl_base_advantages", "tag_metrics", "agent_run_summary"]:
        p = _plan(qs[n](spark, sf_dir))
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p, n


def test_indexes_keep_null_groups_and_null_hashes(spark):
    from rollspark.plans.index import hashed_index
    rows = [(None, "ab"), (None, "cd"), (1, "ab"), (1, None)]
    got = hashed_index(spark.createDataFrame(rows, "g long, h string"), "h", partition_by=["g"]).collect()
    assert sorted((r["g"] or 0, r["idx"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]

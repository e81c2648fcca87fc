"""Batches of rows that follow each other in the seeded order are padded where one shuffle has brought them together."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from rollspark.functions.arrays import narrowed, widened
from rollspark.operators import sequences as S
from rollspark.plans.batching import seeded_order


@pytest.mark.parametrize("n, copies, whole", [(0, 1, 64), (10, 1, 64), (3000, 1, 64), (700, 5, 7), (400, 30, 64)])
def test_whole_batches_stand_in_one_task(spark, n, copies, whole):
    """Also rows with equal keys and other contents, and keys that are null: each comes back once, at its place."""
    df = spark.range(n * copies).select(F.when(F.col("id") % 9 != 0, F.floor(F.col("id") / copies)).cast("long").alias("uid"), F.lit("k").alias("sample_key"),
                                        "id", F.array(F.col("id"), F.lit(2**40), F.lit(None).cast("long")).alias("ids"))
    got = seeded_order(df, ["uid", "sample_key"], whole=whole).withColumn("task", F.spark_partition_id()).collect()
    rows = df.collect()
    assert sorted(r["idx"] for r in got) == list(range(len(rows)))
    assert Counter((r["id"], tuple(r["ids"])) for r in got) == Counter((r["id"], tuple(r["ids"])) for r in rows)
    md5 = lambda r: hashlib.md5("|".join(str(x) for x in ("0", r["uid"], r["sample_key"]) if x is not None).encode()).hexdigest()
    assert [md5(r) for r in sorted(got, key=lambda r: r["idx"])] == sorted(map(md5, rows))
    tasks = defaultdict(set)
    for r in got:
        tasks[r["idx"] // whole].add((r["task"], r["part"]))
    assert all(len(x) == 1 for x in tasks.values())
    assert len(rows) < 3000 or len({r["task"] for r in got}) > 1


def test_padding_within_parts_equals_padding_by_a_join(spark):
    df = spark.range(500).select("id", (F.col("id") % 50).alias("batch_id"), (F.col("id") % 5).alias("part"), F.sequence(F.lit(0), F.col("id") % 7).cast("array<bigint>").alias("prompt_ids"),
                                 F.sequence(F.lit(0), F.col("id") % 11).cast("array<bigint>").alias("response_ids"), F.sequence(F.lit(0), F.col("id") % 11).alias("loss_mask"))
    rows = lambda d: sorted(map(str, (r.asDict() for r in d.select(*sorted(d.columns)).collect())))
    assert rows(S.pad_batch(df, within="part")) == rows(S.pad_batch(df))


def test_arrays_come_back_as_they_were(spark):
    values = [None, [], [None], [1, -2, None], [2**15 - 1, -2**15], [2**15], [-2**15 - 1, 0], [2**31 - 1], [2**31, None], [-2**63, 2**63 - 1]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, `a.b` array<bigint>")
    assert [r["a.b"] for r in widened(narrowed(df), df).orderBy("i").collect()] == values


def test_roundtrip_moves_the_arrays_once(spark, sf_dir):
    plan = E.queries()["pad_unpad_roundtrip"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "l_orderkey" not in x]
    assert len(moved) == 1 and "part" in moved[0] and "SortMergeJoin" not in plan
    assert "log_probs" not in plan  # arrays that are not padded stay where they are

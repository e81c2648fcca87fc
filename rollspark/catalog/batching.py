"""Batch planning queries (O1, O2, O9, O10, B1-B8) over orders, documents, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import query
from rollspark.plans import batching as B
from rollspark.functions.cols import with_scalars
from rollspark.sources.tables import table


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_id"),
                                            F.col("o_orderpriority").alias("data_source"),
                                            F.col("o_orderstatus").alias("status"))


_ORD = "row_number() OVER (ORDER BY md5('0|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1"


@query("batch_index", f"""
SELECT prompt_id, idx, batch_id FROM (
  SELECT o_orderkey AS prompt_id, {_ORD} AS idx, CAST(floor(({_ORD}) / 64) AS BIGINT) AS batch_id,
         CAST(floor(count(*) OVER () / 64) AS BIGINT) AS nb FROM orders) WHERE batch_id < nb""")
def q_batch_index(spark, d):
    return B.batch_index(_orders(spark, d), "prompt_id", 64, drop_last=True).select("prompt_id", "idx", "batch_id")


@query("train_test_split", f"""
SELECT o_orderkey AS prompt_id, CASE WHEN {_ORD} < 500 THEN 'test' ELSE 'train' END AS split FROM orders""")
def q_split(spark, d):
    test, train = B.train_test_split(_orders(spark, d), "prompt_id", 500)
    return test.select("prompt_id", F.lit("test").alias("split")).unionByName(
        train.select("prompt_id", F.lit("train").alias("split")))


@query("cap_dataset", f"""
SELECT prompt_id FROM (SELECT o_orderkey AS prompt_id, {_ORD} AS idx FROM orders) WHERE idx < 1000""")
def q_cap(spark, d):
    return B.cap_rows(_orders(spark, d), "prompt_id", 1000).select("prompt_id")


@query("stratified_sample", """
SELECT doc_id, source, rank_in_stratum FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || CAST(doc_id AS VARCHAR)), doc_id)
         AS rank_in_stratum FROM documents) WHERE rank_in_stratum <= 5""")
def q_stratified(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return B.stratified_sample(docs, "source", "doc_id", 5).select("doc_id", "source", "rank_in_stratum")


@query("fifo_keep_last", """
SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100""")
def q_fifo(spark, d):
    return B.keep_last(table(spark, d, "events").select("event_id"), "event_id", 100)


@query("replicate_prompts", """
SELECT o_orderkey AS prompt_id, CAST(o_orderkey AS VARCHAR) AS uid, CAST(s AS INTEGER) AS sample_idx
FROM orders, range(4) t(s)""")
def q_replicate(spark, d):
    return B.replicate(_orders(spark, d), 4, uid="prompt_id").select("prompt_id", "uid", "sample_idx")


@query("near_equal_parts", f"""
WITH o AS (SELECT o_orderkey AS prompt_id, {_ORD} AS idx, count(*) OVER () AS n FROM orders),
p AS (SELECT prompt_id, idx, n, CAST(n AS DOUBLE) / 7 AS step,
             CAST(least(floor(idx / (CAST(n AS DOUBLE) / 7)), 6) AS INTEGER) AS p0 FROM o)
SELECT prompt_id, CAST(p0
     + CASE WHEN idx >= (CASE WHEN p0 + 1 >= 7 THEN n ELSE floor((p0 + 1) * step) END) THEN 1 ELSE 0 END
     - CASE WHEN idx < (CASE WHEN p0 >= 7 THEN n ELSE floor(p0 * step) END) THEN 1 ELSE 0 END AS INTEGER) AS part
FROM p""")
def q_parts(spark, d):
    o = B.seeded_order(_orders(spark, d), "prompt_id")
    o = with_scalars(o, B.count_rows(o))
    return B.near_equal_parts(o, "idx", "_n", 7).select("prompt_id", "part")


@query("chunk_ids", f"""
SELECT o_orderkey AS prompt_id, CAST(floor(({_ORD}) / 1000) AS BIGINT) AS chunk FROM orders""")
def q_chunks(spark, d):
    return B.chunk_ids(B.seeded_order(_orders(spark, d), "prompt_id"), "idx", 1000).select("prompt_id", "chunk")


@query("even_shards", f"""
WITH o AS (SELECT o_orderkey AS prompt_id, {_ORD} AS idx, count(*) OVER () AS n FROM orders)
SELECT prompt_id, false AS repeated FROM o WHERE n < 7 OR idx < n - n % 7
UNION ALL SELECT prompt_id, true FROM o WHERE n < 7 AND idx < 7 - n""")
def q_shards(spark, d):
    o = B.seeded_order(_orders(spark, d), "prompt_id")
    o = with_scalars(o, B.count_rows(o))
    rows, _ = B.even_shards(o, "idx", "_n", 7)
    return rows.select("prompt_id", "repeated")


@query("repeat_epochs_test", """
SELECT o_orderkey AS prompt_id, CAST(e AS BIGINT) AS epoch, o_orderpriority || '_' || CAST(e AS VARCHAR) AS data_source
FROM orders, range(3) t(e)""")
def q_epochs(spark, d):
    return B.repeat_epochs(_orders(spark, d), 3, split="test").select("prompt_id", "epoch", "data_source")


@query("curriculum_plan", """
WITH s AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
                                       ELSE 3 END AS stage FROM orders),
     plan AS (SELECT * FROM (VALUES (0, 2, 8), (1, 10, 16), (2, 12, 32), (3, 14, 64)) p(stage, reps, group_size))
SELECT CAST(stage AS INTEGER) AS stage, CAST(group_size AS INTEGER) AS group_size, CAST(count(*) * any_value(reps) AS BIGINT) AS n_rows
FROM s JOIN plan USING (stage) GROUP BY stage, group_size""")
def q_curriculum(spark, d):
    o = _orders(spark, d)
    first = ("1-URGENT", "2-HIGH", "3-MEDIUM")  # every other priority is in the last stage
    stages = [o.filter(F.col("data_source") == p) for p in first]
    stages.append(o.filter(F.col("data_source").isNull() | ~F.col("data_source").isin(*first)))
    c = B.curriculum(stages)
    return c.groupBy("stage", "group_size").agg(F.count(F.lit(1)).alias("n_rows"))


@query("fractional_repeats", """
WITH p AS (SELECT o_orderkey AS prompt_id, CAST(pass AS BIGINT) AS pass,
                  row_number() OVER (PARTITION BY pass ORDER BY md5('0|' || CAST(pass AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS ip,
                  count(*) OVER (PARTITION BY pass) AS n
           FROM orders, range(2) t(pass))
SELECT prompt_id, pass, pass * n + ip AS position FROM p WHERE pass * n + ip < ceil(n * 1.5)""")
def q_fractional(spark, d):
    return B.fractional_repeats(_orders(spark, d), "prompt_id", 1.5).select("prompt_id", "pass", "position")


@query("mixed_batches", """
WITH o AS (SELECT o_orderkey AS prompt_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS di FROM orders),
     r AS (SELECT prompt_id, di, row_number() OVER (PARTITION BY di ORDER BY md5('0|' || CAST(prompt_id AS VARCHAR)), prompt_id) - 1 AS idx
           FROM o),
     b AS (SELECT prompt_id, di, CAST(floor(idx / (CASE di WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END)) AS BIGINT) AS batch_id FROM r),
     nb AS (SELECT min(floor(c / (CASE di WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END))) AS m FROM (SELECT di, count(*) AS c FROM o GROUP BY di))
SELECT prompt_id, di AS dataset_index, batch_id FROM b, nb WHERE batch_id < m""")
def q_mixed(spark, d):
    o = _orders(spark, d)
    ds = [o.filter(F.col("status") == s) for s in ("F", "O", "P")]
    out = B.mixed_batches(ds, [3, 2, 1], "prompt_id")
    return out.select("prompt_id", "dataset_index", "batch_id")

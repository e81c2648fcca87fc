import pytest

import __spark_entry__ as E
from rollspark.operators.retrieve import dense_topk
from rollspark.sources.tables import table
from tests.oracle_harness import compare


def test_dense_topk_across_many_arrow_batches(spark, duck, sf_dir):
    """Small Arrow batches must not split a block."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = compare(spark, duck, "dense_topk", E.queries()["dense_topk"], E.oracle_sql()["dense_topk"], sf_dir)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert r["ok"], r.get("why")


@pytest.mark.parametrize("query_block, doc_block", [(7, 11), (1000, 3)])
def test_dense_topk_over_many_blocks(spark, sf_dir, query_block, doc_block):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").limit(40)
    e = spark.createDataFrame(e.collect(), e.schema)
    q, c = e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "doc_id")
    want = {(r.query_id, r["rank"], r.doc_id) for r in dense_topk(c, q, 4).collect()}
    got = {(r.query_id, r["rank"], r.doc_id)
           for r in dense_topk(c, q, 4, query_block=query_block, doc_block=doc_block).collect()}
    assert len(want) == 160 and got == want


def test_dense_topk_without_queries_or_documents(spark):
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "doc_id long, embedding array<double>")
    assert dense_topk(some, none, 3).count() == 0
    assert dense_topk(some.limit(0), some.withColumnRenamed("doc_id", "query_id"), 3).count() == 0
    hits = dense_topk(some, some.withColumnRenamed("doc_id", "query_id"), 3).select("query_id", "doc_id", "score").collect()
    assert [tuple(h) for h in hits] == [(1, 1, 1.0)]

"""Retrieval queries (O7, O8, P17, C19, C20) over embeddings, documents and
benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.cols import rnd
from rollspark.operators import retrieve as RT
from rollspark.sources.fixtures import dealt
from rollspark.sources.tables import table


@query("dense_topk", f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id,
                  list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
           FROM embeddings q, embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {R("score")} DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, {R("score")} AS score FROM r WHERE rank <= 5""")
def q_dense(spark, d):
    e = table(spark, d, "embeddings")
    hits = RT.dense_topk(e.select(F.col("vec_id").alias("doc_id"), "embedding"),
                         e.select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return hits.select("query_id", "doc_id", "rank", rnd("score").alias("score"))


_TOK = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
_BM25 = f"""
WITH dt AS (SELECT doc_id, {_TOK.format(x="text")} AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idx AS (SELECT tf.term, tf.doc_id,
               ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * (0.9 + 1) / (tf + 0.9 * (1 - 0.4 + 0.4 * len(toks) / avgdl)) AS w
        FROM tf JOIN df USING (term) JOIN dt USING (doc_id), st),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (
         SELECT item_id AS query_id, unnest({_TOK.format(x="text")}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, sum(w * qtf) AS score FROM qt JOIN idx USING (term) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {R("score")} DESC, doc_id) AS rank FROM sc)"""


def _bm25_hits(spark, d, k=10):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    idx = RT.bm25_index(dealt(table(spark, d, "documents"), "doc_id"), terms=RT.query_terms(q))
    return RT.bm25_topk(idx, q, k)


@query("bm25_topk", _BM25 + f"""
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, {R("score", 4)} AS score FROM rk WHERE rank <= 10""")
def q_bm25(spark, d):
    return _bm25_hits(spark, d).select("query_id", "doc_id", "rank", rnd("score", 4).alias("score"))


@query("retrieval_results_text", _BM25 + """
, h AS (SELECT rk.query_id, rk.rank, d.text FROM rk JOIN documents d USING (doc_id) WHERE rank <= 3)
SELECT query_id, md5(string_agg('Doc ' || CAST(rank AS VARCHAR) || ': ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g')
                                || chr(10), '' ORDER BY rank)) AS text_md5
FROM h GROUP BY query_id""")
def q_results_text(spark, d):
    hits = _bm25_hits(spark, d, 3).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("contents")),
                                        "doc_id")
    t = RT.results_text(hits)
    return t.select("query_id", F.md5("text").alias("text_md5"))


@query("retrieval_results_by_query", _BM25 + """
, h AS (SELECT rk.query_id, rk.rank, d.text, b.text AS query FROM rk JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = rk.query_id WHERE rank <= 3)
SELECT query_id, md5('Query: ' || query || chr(10) || string_agg('Document ' || CAST(rank AS VARCHAR) || ':' || chr(10) || text || chr(10), '' ORDER BY rank)) AS text_md5
FROM h GROUP BY query_id, query""")
def q_results_by_query(spark, d):
    hits = _bm25_hits(spark, d, 3).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("contents")), "doc_id") \
        .join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return RT.results_text(hits, style="query").select("query_id", F.md5("text").alias("text_md5"))


@query("encoder_prefixes", """
SELECT doc_id, md5('passage: ' || text) AS e5_passage_md5, md5(text) AS bge_passage_md5 FROM documents""")
def q_prefix(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(RT.encoder_prefix("text", "e5-base-v2", False)).alias("e5_passage_md5"),
                       F.md5(RT.encoder_prefix("text", "bge-large-en", False)).alias("bge_passage_md5"))


@query("encoder_query_prefixes", f"""
SELECT item_id, md5('query: ' || text) AS e5_query_md5,
       md5('{RT.BGE_QUERY}' || text) AS bge_query_md5 FROM benchmark""")
def q_query_prefix(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.md5(RT.encoder_prefix("text", "intfloat/e5-base", True)).alias("e5_query_md5"),
                    F.md5(RT.encoder_prefix("text", "BAAI/bge-base", True)).alias("bge_query_md5"))


@query("mean_pool_vectors", f"""
WITH c AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS v FROM embeddings),
m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS mv FROM c GROUP BY 1, 2),
nrm AS (SELECT label, sqrt(sum(mv * mv)) AS nv FROM m GROUP BY 1)
SELECT label, {R("sum(mv / greatest(nv, 1e-12))")} AS pooled_sum, {R("max(CASE WHEN i = 1 THEN mv / greatest(nv, 1e-12) END)")} AS pooled_first,
       CAST(count(*) AS BIGINT) AS dims
FROM m JOIN nrm USING (label) GROUP BY label""")
def q_pool(spark, d):
    p = RT.mean_pool(table(spark, d, "embeddings"), "label")
    return p.select("label", rnd(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x)).alias("pooled_sum"),
                    rnd(F.col("pooled")[0]).alias("pooled_first"), F.size("pooled").cast("bigint").alias("dims"))

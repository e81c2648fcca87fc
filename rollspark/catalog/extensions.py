"""Trajectory fill, batch concatenation, group assembly and the extension
registries (J9, U1, W3, X2-X5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import query
from rollspark.catalog.grade_sql import _FMT, _GRADE_CTES
from rollspark.catalog.losses import _tok
from rollspark.functions.cols import rnd
from rollspark.operators import registry as X
from rollspark.operators import trajectories as TR
from rollspark.sources.fixtures import messages, responses, rollouts, sql_questions, sql_results, transitions, with_views
from rollspark.sources.tables import table

_EMPTY = ("substr(md5(CAST(conv_id AS STRING)), 1, 1) < '5' "
          "OR substr(md5('i|' || CAST(conv_id DIV 4 AS STRING)), 1, 1) < '3'")


@query("fill_empty_trajectories", with_views(f"""
, m AS (SELECT conv_id, conv_id // 4 AS instance_id,
               CASE WHEN {_EMPTY.replace("DIV", "//")} THEN 0 ELSE len(messages) END AS n_msgs FROM messages),
p AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY conv_id) - 1 AS pos, n_msgs > 0 AS ne FROM m),
inst AS (SELECT instance_id, bool_and(ne) AS all_ne, min(conv_id) AS first_seen,
                min(CASE WHEN ne THEN pos END) AS local_pos FROM p GROUP BY 1),
g AS (SELECT instance_id FROM inst WHERE all_ne ORDER BY first_seen LIMIT 1),
gs AS (SELECT p.conv_id AS g_conv, p.n_msgs AS g_n, p.pos AS g_pos, count(*) OVER () AS n_g FROM p JOIN g USING (instance_id)),
lf AS (SELECT p.instance_id, p.conv_id AS l_conv, p.n_msgs AS l_n FROM p JOIN inst USING (instance_id) WHERE p.pos = inst.local_pos)
SELECT p.conv_id, p.instance_id,
       CASE WHEN p.ne THEN p.conv_id WHEN lf.l_conv IS NOT NULL THEN lf.l_conv WHEN gs.g_conv IS NOT NULL THEN gs.g_conv ELSE p.conv_id END AS source_conv,
       CASE WHEN p.ne THEN p.n_msgs WHEN lf.l_conv IS NOT NULL THEN lf.l_n WHEN gs.g_conv IS NOT NULL THEN gs.g_n ELSE p.n_msgs END AS n_msgs,
       CASE WHEN p.ne THEN 'own' WHEN lf.l_conv IS NOT NULL THEN 'local' WHEN gs.g_conv IS NOT NULL THEN 'global' ELSE 'none' END AS fill
FROM p LEFT JOIN lf USING (instance_id) LEFT JOIN gs ON NOT p.ne AND lf.l_conv IS NULL AND gs.g_pos = p.pos % gs.n_g""",
                                                  "messages"))
def q_fill(spark, d):
    m = messages(spark, d).withColumn("instance_id", F.expr("conv_id DIV 4"))
    m = m.withColumn("messages", F.when(F.expr(_EMPTY), F.array().cast(m.schema["messages"].dataType))
                     .otherwise(F.col("messages")))
    m = m.withColumn("pos", F.row_number().over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("instance_id").orderBy("conv_id")) - 1)
    m = m.withColumn("source_conv", F.col("conv_id"))
    out = TR.fill_empty_trajectories(m, "instance_id", "pos", "messages", ["messages", "source_conv"], "conv_id")
    return out.select("conv_id", "instance_id", "source_conv", F.size("messages").cast("bigint").alias("n_msgs"), "fill")


@query("union_rollout_batches", with_views("""
SELECT uid, sample_key, CASE WHEN stop_reason = 'stop' THEN 0 ELSE 1 END AS batch FROM rollouts""", "rollouts"))
def q_union(spark, d):
    r = rollouts(spark, d, with_tokens=True)
    b0 = r.filter(F.col("stop_reason") == "stop").withColumn("batch", F.lit(0))
    b1 = r.filter(F.col("stop_reason") != "stop").withColumn("batch", F.lit(1))
    return TR.concat_batches([b0, b1]).select("uid", "sample_key", "batch")


@query("group_assembly", with_views("""
, t AS (SELECT DISTINCT group_id, traj_id FROM transitions),
g AS (SELECT group_id, row_number() OVER (ORDER BY md5('0|' || group_id), group_id) - 1 AS group_idx
      FROM (SELECT DISTINCT group_id FROM t))
SELECT t.group_id, t.traj_id, g.group_idx,
       row_number() OVER (PARTITION BY t.group_id ORDER BY t.traj_id) - 1 AS traj_idx
FROM t JOIN g USING (group_id)""", "transitions"))
def q_groups(spark, d):
    t = transitions(spark, d).select("group_id", "traj_id").distinct()
    return TR.assemble_groups(t, "group_id", "traj_id").select("group_id", "traj_id", "group_idx", "traj_idx")


def q_loss_registry(spark, d):
    df = _tok(spark, d)
    out = X.policy_losses(df, X.POLICY_LOSSES.names(), "log_probs", "rollout_logprobs", "adv", "loss_mask")
    return out.select("loss_name", rnd("loss").alias("loss"))


query("policy_loss_registry")(q_loss_registry)  # rows-only: each loss has its own oracle query

_ENV = ("CASE substr(md5('env|' || CAST(response_id AS STRING)), 1, 1) WHEN '0' THEN 'gsm8k' WHEN '1' THEN 'aime' "
        "WHEN '2' THEN 'search' WHEN '3' THEN 'unknown' ELSE 'math' END")


def q_graders(spark, d):
    r = responses(spark, d).withColumn("env_class", F.expr(_ENV))
    return X.grade_by_env(r).select("response_id", "env_class", "score")


query("graders_by_env")(q_graders)  # rows-only: each grader has its own oracle query

# a document's tests are its sentences; one passes unless it speaks of an odd number of commas
_CODE = """CASE WHEN n_chars % 3 = 0 THEN concat('```python', chr(10), 'pass', chr(10), '```') ELSE 'no code' END"""


@query("graders_over_tables", with_views(_GRADE_CTES.replace("{method}", "grading_method") + f"""
, code AS (SELECT doc_id, n_chars % 3 = 0 AS wrote, bool_and(passed) AS ok FROM (
    SELECT doc_id, n_chars, (length(s) - length(replace(s, ',', ''))) % 2 = 0 AS passed
    FROM (SELECT doc_id, n_chars, unnest(string_split(text, '. ')) AS s FROM documents)) GROUP BY 1, 2)
SELECT 'text2sql' AS env_class, q.question_id AS row_id,
       CAST(CASE WHEN {_FMT.replace("completion", "q.completion")} IS NULL THEN -1.0 WHEN NOT q.pred_ok THEN 0.0
                 WHEN coalesce(v.is_correct, false) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM sql_questions q LEFT JOIN v USING (question_id)
UNION ALL SELECT 'code', doc_id + 1000000000000, CASE WHEN wrote AND ok THEN 1.0 ELSE 0.0 END FROM code
UNION ALL SELECT 'other', doc_id + 2000000000000, NULL FROM documents""", "sql_results", "sql_questions"))
def q_table_graders(spark, d):
    """SQL questions, code answers and rows of an unknown class in one table, graded over result tables."""
    q, docs = sql_questions(spark, d), table(spark, d, "documents").select("doc_id", "text", "n_chars")
    rows = q.select(F.lit("text2sql").alias("env_class"), F.col("question_id").alias("row_id"), F.col("completion").alias("response"), F.col("grading_method").alias("gold")) \
        .unionByName(docs.select(F.lit("code").alias("env_class"), (F.col("doc_id") + 1000000000000).alias("row_id"), F.expr(_CODE).alias("response"), F.lit(None).cast("string").alias("gold"))) \
        .unionByName(docs.select(F.lit("other").alias("env_class"), (F.col("doc_id") + 2000000000000).alias("row_id"), F.lit("").alias("response"), F.lit(None).cast("string").alias("gold")))
    status = q.select("question_id", F.lit("pred").alias("side"), F.col("pred_ok").alias("ok"))
    tests = docs.select((F.col("doc_id") + 1000000000000).alias("question_id"), F.explode(F.split("text", r"\. ")).alias("s")) \
        .select("question_id", ((F.length("s") - F.length(F.replace("s", F.lit(","), F.lit("")))) % 2 == 0).alias("passed"))
    out = X.grade_by_env(rows, key="row_id", sql_results=sql_results(spark, d), sql_status=status, code_results=tests)
    return out.select("env_class", "row_id", "score")


@query("preference_by_model", """
SELECT p_partkey, CAST(sign(p_size - length(p_name)) AS DOUBLE) AS by_score,
       CAST(CASE WHEN substr(p_brand, 7, 1) IN ('1', '2') THEN 1 WHEN substr(p_brand, 7, 1) = '3' THEN -1 END AS DOUBLE) AS by_table
FROM part""")
def q_preference(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.length("p_name").alias("a"), F.col("p_size").alias("b"))
    digit = F.substring("p_brand", 7, 1)
    verdicts = p.where(digit.isin("1", "2", "3")).select("p_partkey", F.when(digit == "3", -1).otherwise(1).alias("verdict"))
    out = X.prefer(p, "score", a="a", b="b", score=lambda c: c).withColumnRenamed("preference", "by_score")
    out = X.prefer(out, "table", keys="p_partkey", verdicts=verdicts, verdict="verdict")
    return out.select("p_partkey", "by_score", F.col("preference").alias("by_table"))


@query("flat_map_lines", """
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents)""")
def q_flat_map(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")) \
        .select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")

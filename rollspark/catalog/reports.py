"""Remaining reports (A6-A8, A19-A22, P15) over transitions, events, documents,
labels and rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.cols import rnd
from rollspark.operators import metrics as M
from rollspark.sources.fixtures import rollouts, transitions, with_views
from rollspark.sources.tables import table


@query("tag_metrics", with_views(f"""
, tr AS (SELECT group_id, traj_id, sum(reward) AS total_reward, arg_max(reward, step) AS last_reward,
               count(*) AS turns FROM transitions GROUP BY 1, 2),
g AS (SELECT DISTINCT group_id FROM transitions),
tg AS (SELECT group_id, unnest([CASE WHEN group_id < '8' THEN 'first_half' ELSE 'second_half' END, 'any']) AS tag FROM g),
cov AS (SELECT tag, count(DISTINCT group_id) AS tgc FROM tg GROUP BY tag),
nt AS (SELECT max(CASE WHEN tgc < (SELECT count(*) FROM g) THEN 1 ELSE 0 END) AS nt FROM cov),
u AS (SELECT tg.tag, tr.turns, tr.total_reward, tr.last_reward FROM tr JOIN tg USING (group_id), nt WHERE nt = 1
      UNION ALL SELECT 'all', turns, total_reward, last_reward FROM tr)
SELECT tag, CAST(count(*) AS BIGINT) AS total_episodes, CAST(sum(turns) AS BIGINT) AS total_turns,
       {R("avg(total_reward)")} AS reward_total, {R("avg(CASE WHEN last_reward = 1 THEN 1.0 ELSE 0.0 END)")} AS correct
FROM u GROUP BY tag""", "transitions"))
def q_tag_metrics(spark, d):
    t = transitions(spark, d)
    by_traj = t.groupBy("group_id", "traj_id").agg(F.sum("reward").alias("total_reward"),
                                                    F.max_by("reward", "step").alias("last_reward"),
                                                    F.count(F.lit(1)).alias("turns"))
    groups = t.select("group_id").distinct().withColumn(
        "tags", F.array(F.when(F.col("group_id") < "8", "first_half").otherwise("second_half"), F.lit("any")))
    out = M.per_tag_metrics(groups, by_traj=by_traj)
    return out.select("tag", F.col("total_episodes").cast("bigint").alias("total_episodes"),
                      F.col("total_turns").cast("bigint").alias("total_turns"),
                      rnd("reward_total").alias("reward_total"), rnd("correct").alias("correct"))


@query("sparse_metric_means", with_views(f"""
, e AS (SELECT 'ac_tokens' AS key, CAST(len(ac) AS DOUBLE) AS value FROM transitions
        UNION ALL SELECT 'long_turn', 1.0 FROM transitions WHERE len(ac) > 100)
SELECT key, {R("avg(value)")} AS mean, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY key""", "transitions"))
def q_dict_mean(spark, d):
    t = transitions(spark, d).withColumn("metrics", F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("ac_tokens").alias("k"), F.size("ac").cast("double").alias("v")),
        F.struct(F.lit("long_turn").alias("k"), F.when(F.size("ac") > 100, F.lit(1.0)).alias("v"))),
        lambda e: e["v"].isNotNull())))
    out = M.dict_mean(t)
    return out.select("key", rnd("mean").alias("mean"), F.col("n").cast("bigint").alias("n"))


@query("metric_list_means", f"""
SELECT event_type AS name, {R("avg(value)")} AS mean FROM events GROUP BY event_type""")
def q_list_mean(spark, d):
    out = M.metric_list_mean(table(spark, d, "events"), "event_type", "value")
    return out.select("name", rnd("mean").alias("mean"))


@query("accuracy_by_source", f"""
SELECT CASE WHEN grouping(source) = 1 THEN 'overall' ELSE source END AS data_source,
       CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       {R("sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*)")} AS accuracy
FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)""")
def q_accuracy(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    out = M.accuracy_by_source(j.select(F.col("source").alias("data_source"),
                                        (F.col("quality") == 1).alias("is_correct")))
    return out.select("data_source", F.col("total").cast("bigint").alias("total"),
                      F.col("correct").cast("bigint").alias("correct"), rnd("accuracy").alias("accuracy"))


_PRED = """CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '4' THEN upper(lang) || '_'
                WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '6' THEN 'de' ELSE '-' || lang || '.' END"""


@query("classifier_accuracy", f"""
SELECT {R(f"avg(CASE WHEN trim(lower(translate({_PRED}, '_.-', '   '))) = trim(lower(translate(lang, '_.-', '   '))) THEN 1.0 ELSE 0.0 END)")} AS accuracy,
       CAST(count(*) AS BIGINT) AS n FROM documents""")
def q_classifier(spark, d):
    docs = table(spark, d, "documents")
    code = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    pred = F.when(code < "4", F.concat(F.upper("lang"), F.lit("_"))).when(code < "6", F.lit("de")) \
        .otherwise(F.concat(F.lit("-"), F.col("lang"), F.lit(".")))
    out = M.classifier_accuracy(docs.select(pred.alias("pred"), F.col("lang").alias("label")))
    return out.select(rnd("accuracy").alias("accuracy"), F.col("n").cast("bigint").alias("n"))


def _agent_runs(spark, d):
    r = rollouts(spark, d)
    reason = F.when(F.col("stop_reason") == "length", "MAX_ITERATIONS_REACHED") \
        .when(F.col("is_correct"), "FINISH").otherwise("AGENT_STOP")
    return r.select(F.col("uid").alias("instance_id"), F.col("resp_len").alias("turns"),
                    (F.col("reward") > 0).alias("resolved"), reason.alias("finish_reason"))


_RUNS = """
, a AS (SELECT uid AS instance_id, resp_len AS turns, reward > 0 AS resolved,
              CASE WHEN stop_reason = 'length' THEN 'MAX_ITERATIONS_REACHED' WHEN is_correct THEN 'FINISH'
                   ELSE 'AGENT_STOP' END AS finish_reason FROM rollouts)"""


@query("agent_run_summary", with_views(_RUNS + f"""
, inst AS (SELECT instance_id, min(CASE WHEN resolved THEN 1 ELSE 0 END) AS al,
                 max(CASE WHEN resolved THEN 1 ELSE 0 END) AS an FROM a GROUP BY 1)
SELECT {R("avg(turns)")} AS avg_turns, CAST(count(*) AS BIGINT) AS n_trajectories,
       CAST(sum(CASE WHEN finish_reason IN ('CONTEXT_WINDOW_EXCEEDED', 'RUNTIME_ERROR', 'EVALUATION_ERROR',
                                           'MAX_ITERATIONS_REACHED') THEN 1 ELSE 0 END) AS BIGINT) AS n_masked,
       (SELECT CAST(sum(al) AS BIGINT) FROM inst) AS all_resolved,
       (SELECT CAST(sum(CASE WHEN an = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM inst) AS none_resolved
FROM a""", "rollouts"))
def q_agent_summary(spark, d):
    s, _ = M.agent_run_report(_agent_runs(spark, d))
    return s.select(rnd("avg_turns").alias("avg_turns"),
                    *[F.col(c).cast("bigint").alias(c) for c in ("n_trajectories", "n_masked", "all_resolved",
                                                                  "none_resolved")])


@query("agent_finish_reasons", with_views(_RUNS + f"""
SELECT finish_reason, {R("count(*) / (SELECT count(*) FROM a)")} AS ratio FROM a GROUP BY finish_reason""", "rollouts"))
def q_agent_reasons(spark, d):
    _, per = M.agent_run_report(_agent_runs(spark, d))
    return per.select("finish_reason", rnd("ratio").alias("ratio"))


@query("sampler_stats", f"""
SELECT CAST(max(day(ts)) AS INTEGER) AS step_max, CAST(min(day(ts)) AS INTEGER) AS step_min,
       {R("avg(day(ts))")} AS step_mean, {R("max(value)")} AS time_max, {R("min(value)")} AS time_min,
       {R("avg(value)")} AS time_mean FROM events""")
def q_sampler(spark, d):
    e = table(spark, d, "events").select(F.dayofmonth("ts").alias("sampler_step"), F.col("value").alias("sample_seconds"))
    out = M.sampler_stats(e)
    return out.select(F.col("step_max").cast("int").alias("step_max"), F.col("step_min").cast("int").alias("step_min"),
                      rnd("step_mean").alias("step_mean"), rnd("time_max").alias("time_max"),
                      rnd("time_min").alias("time_min"), rnd("time_mean").alias("time_mean"))

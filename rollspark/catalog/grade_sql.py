"""SQL result grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import query
from rollspark.operators import curate as C
from rollspark.operators import grade_sql as G
from rollspark.sources.fixtures import db_schemas, sql_annotations, sql_questions, sql_results, with_views

# ---- DuckDB twin of grade_results -------------------------------------------------

_GRADE_CTES = """
, r AS (SELECT * FROM sql_results
        WHERE len(list_filter(vals, lambda v: v IS NOT NULL AND regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '')) > 0),
k AS (SELECT question_id, list_sort(list_transform(vals, lambda v: coalesce(v, 'None'))) AS key,
             sum(CASE WHEN side = 'gold' THEN 1 ELSE 0 END) AS cg,
             sum(CASE WHEN side = 'pred' THEN 1 ELSE 0 END) AS cp
      FROM r GROUP BY 1, 2),
kv AS (SELECT question_id, bool_and(cg = cp) AS multiset_eq, bool_and((cg > 0) = (cp > 0)) AS set_eq,
              bool_and(cp = 0 OR cg > 0) AS pred_in_gold FROM k GROUP BY 1),
shape AS (SELECT question_id,
                 sum(CASE WHEN side = 'gold' THEN 1 ELSE 0 END) AS n_gold,
                 sum(CASE WHEN side = 'pred' THEN 1 ELSE 0 END) AS n_pred,
                 arg_min(CASE WHEN side = 'gold' THEN len(vals) END, CASE WHEN side = 'gold' THEN row_idx END) AS wg,
                 arg_min(CASE WHEN side = 'pred' THEN len(vals) END, CASE WHEN side = 'pred' THEN row_idx END) AS wp,
                 arg_min(CASE WHEN side = 'gold' THEN vals[1] END, CASE WHEN side = 'gold' THEN row_idx END) AS vg,
                 arg_min(CASE WHEN side = 'pred' THEN vals[1] END, CASE WHEN side = 'pred' THEN row_idx END) AS vp
          FROM r GROUP BY 1),
dist AS (SELECT question_id, count(*) AS nd FROM (SELECT DISTINCT question_id, vals FROM r WHERE side = 'pred') GROUP BY 1),
pos AS (SELECT question_id, side, list_sort(list_transform(vals, lambda v: coalesce(v, 'None'))) AS key,
               row_number() OVER (PARTITION BY question_id, side ORDER BY row_idx) AS p FROM r),
lst AS (SELECT question_id, bool_and(coalesce(kg = kp, false)) AS list_eq FROM (
          SELECT question_id, p, min(CASE WHEN side = 'gold' THEN key END) AS kg,
                 min(CASE WHEN side = 'pred' THEN key END) AS kp FROM pos GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT q.question_id, {method} AS method, coalesce(n_gold, 0) AS ng, coalesce(n_pred, 0) AS np,
             wg, wp, vg, vp, multiset_eq, set_eq, pred_in_gold, coalesce(nd, 0) AS nd, list_eq
      FROM sql_questions q LEFT JOIN shape USING (question_id) LEFT JOIN kv USING (question_id)
      LEFT JOIN dist USING (question_id) LEFT JOIN lst USING (question_id)),
v AS (SELECT question_id, method, ng, np,
             CASE WHEN NOT (CASE WHEN ng = 0 THEN np = 0 WHEN np = 0 THEN false ELSE wg = wp END) THEN false
                  WHEN ng = 1 AND np = 1 AND wg = 1 AND wp = 1
                       AND coalesce(abs(try_cast(vg AS DOUBLE) - try_cast(vp AS DOUBLE))
                                    / nullif(abs(try_cast(vg AS DOUBLE)), 0) < 0.01, false) THEN true
                  WHEN method LIKE '%multiset%' THEN (ng = 0 AND np = 0) OR (ng = np AND coalesce(multiset_eq, true))
                  WHEN method LIKE '%subset%' THEN
                       (CASE WHEN split_part(method, ',', 2) = '=' THEN nd = try_cast(split_part(method, ',', 3) AS INTEGER)
                             WHEN split_part(method, ',', 2) = '>=' THEN nd >= try_cast(split_part(method, ',', 3) AS INTEGER)
                             ELSE false END) AND coalesce(pred_in_gold, true)
                  WHEN method LIKE '%list%' THEN (ng = 0 AND np = 0) OR (ng = np AND coalesce(list_eq, true))
                  WHEN method LIKE '%set%' THEN (ng = 0 AND np = 0) OR coalesce(set_eq, true)
                  ELSE false END AS is_correct
      FROM j)"""


def _grade_sql(method_expr: str) -> str:
    body = _GRADE_CTES.replace("{method}", method_expr) + """
SELECT question_id, method, CAST(ng AS BIGINT) AS n_gold, CAST(np AS BIGINT) AS n_pred,
       coalesce(is_correct, false) AS is_correct FROM v"""
    return with_views(body, "sql_results", "sql_questions")


def _graded(spark, d, force=None):
    return G.grade_results(sql_results(spark, d), sql_questions(spark, d), force_method=force)


query("sql_grade_by_method", _grade_sql("grading_method"))(lambda spark, d: _graded(spark, d))
query("sql_grade_multiset", _grade_sql("'multiset'"))(lambda spark, d: _graded(spark, d, "multiset"))
query("sql_grade_set", _grade_sql("'set'"))(lambda spark, d: _graded(spark, d, "set"))
query("sql_grade_subset", _grade_sql("'subset,>=,1'"))(lambda spark, d: _graded(spark, d, "subset,>=,1"))
query("sql_grade_list", _grade_sql("'list'"))(lambda spark, d: _graded(spark, d, "list"))


_FMT = """CASE WHEN len(string_split(string_split(completion, '<solution>')[-1], '</solution>')) = 2
            AND NOT regexp_matches(string_split(string_split(completion, '<solution>')[-1], '</solution>')[1],
                                   '(?i)</?(think|sql|observation)\\b')
          THEN regexp_replace(string_split(string_split(completion, '<solution>')[-1], '</solution>')[1], '^\\s+|\\s+$', '', 'g') END"""


@query("sql_format_lenient", with_views(f"""
SELECT question_id, {_FMT} AS pred_sql FROM sql_questions""", "sql_questions"))
def q_fmt(spark, d):
    return sql_questions(spark, d).select("question_id", G.solution_format("completion").alias("pred_sql"))


@query("sql_format_strict", with_views("""
SELECT question_id,
       CASE WHEN len(string_split(completion, '<solution>')) = 2
             AND len(string_split(string_split(completion, '<solution>')[2], '</solution>')) = 2
             AND NOT regexp_matches(string_split(string_split(completion, '<solution>')[2], '</solution>')[1], '(?i)</?(think|sql|observation)\\b')
             AND regexp_matches(completion, '(?s)<think>.*?</think>')
             AND NOT regexp_matches(regexp_replace(string_split(completion, '<solution>')[1], '(?i)</observation>\\s*<think>', '', 'g'), '(?i)</observation>')
            THEN regexp_replace(string_split(string_split(completion, '<solution>')[2], '</solution>')[1], '^\\s+|\\s+$', '', 'g') END AS pred_sql
FROM sql_questions""", "sql_questions"))
def q_fmt_strict(spark, d):
    return sql_questions(spark, d).select("question_id", G.solution_format_strict("completion").alias("pred_sql"))


@query("sql_reward", with_views(_GRADE_CTES.replace("{method}", "'multiset'") + f"""
SELECT q.question_id,
       CAST(CASE WHEN {_FMT.replace("completion", "q.completion")} IS NULL THEN -1.0
            WHEN NOT q.pred_ok THEN 0.0
            WHEN coalesce(v.is_correct, false) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS reward
FROM sql_questions q LEFT JOIN v USING (question_id)""", "sql_results", "sql_questions"))
def q_sql_reward(spark, d):
    qs = sql_questions(spark, d)
    graded = G.grade_results(sql_results(spark, d), qs, force_method="multiset")
    status = qs.select("question_id", F.lit("pred").alias("side"), F.col("pred_ok").alias("ok")).unionByName(
        qs.select("question_id", F.lit("gold").alias("side"), F.lit(True).alias("ok")))
    return G.sql_reward(graded, qs, status)


@query("sql_non_empty_rows", with_views("""
SELECT question_id, side, CAST(count(*) AS BIGINT) AS n_rows FROM sql_results
WHERE len(list_filter(vals, lambda v: v IS NOT NULL AND regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '')) > 0 GROUP BY 1, 2""", "sql_results"))
def q_non_empty(spark, d):
    return G.non_empty_rows(sql_results(spark, d)).groupBy("question_id", "side").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("stop_tag_check", with_views("""
SELECT question_id, (NOT contains(completion, '</sql>') OR strpos(completion, '</sql>') + 5 = length(completion))
       AND (NOT contains(completion, '</solution>') OR strpos(completion, '</solution>') + 10 = length(completion)) AS valid_action
FROM sql_questions""", "sql_questions"))
def q_stop_tag(spark, d):
    return sql_questions(spark, d).select("question_id", G.stops_at_tag("completion").alias("valid_action"))


@query("sql_result_preview", with_views(f"""
, p AS (SELECT question_id, side, vals, row_number() OVER (PARTITION BY question_id, side ORDER BY row_idx) AS rn,
              count(*) OVER (PARTITION BY question_id, side) AS n_rows FROM sql_results)
SELECT question_id, side, CAST(max(n_rows) AS BIGINT) AS n_rows,
       CASE WHEN max(n_rows) > 50 THEN '{G.PREVIEW_TRUNCATED}' ELSE '{G.PREVIEW_FULL}' END
       || string_agg(array_to_string(list_transform(vals, lambda v: coalesce(v, 'None')), ' '), chr(10) ORDER BY rn) AS preview
FROM p WHERE rn <= 50 GROUP BY 1, 2""", "sql_results"))
def q_preview(spark, d):
    return G.result_preview(sql_results(spark, d))


@query("sql_prompt_rows", with_views(f"""
, a AS (SELECT * FROM sql_annotations WHERE trim(coalesce("SQL", '')) <> '')
SELECT 'clean_train' AS data_source, md5(?) AS system_md5,
       '{{db_details}}: ' || coalesce(s.schema_text, '[Database schema for ' || a.db_id || ' not available]')
         || chr(10) || ' {{external_knowledge}}: ' || coalesce(evidence, '') || ';' || chr(10) || ' {{question}}: ' || question
         AS user_content,
       'text2sql' AS env_class, a.db_id, 'bird-platinum' AS data, "SQL" AS ground_truth,
       coalesce(grading_method, 'multiset') AS method,
       CAST(row_number() OVER (ORDER BY question_id) - 1 AS BIGINT) AS idx, question_id
FROM a LEFT JOIN db_schemas s USING (db_id)""".replace("md5(?)", "'" + __import__("hashlib").md5(
    C.SQL_SYSTEM_PROMPT.encode()).hexdigest() + "'"), "sql_annotations", "db_schemas"))
def q_sql_prompts(spark, d):
    rows = C.sql_prompt_rows(sql_annotations(spark, d), db_schemas(spark, d), "clean_train")
    return rows.select("data_source", F.md5(F.col("prompt")[0]["content"]).alias("system_md5"),
                       F.col("prompt")[1]["content"].alias("user_content"), "env_class", "db_id", "data",
                       F.col("reward_spec.ground_truth").alias("ground_truth"),
                       F.col("reward_spec.method").alias("method"),
                       F.col("extra_info.index").alias("idx"), "question_id")


def _result_text_sql(text: str) -> str:
    return with_views(f"""
, p AS (SELECT question_id, side, vals, row_number() OVER (PARTITION BY question_id, side ORDER BY row_idx) AS rn,
              count(*) OVER (PARTITION BY question_id, side) AS n_rows FROM sql_results)
, c AS (SELECT question_id, side, rn, n_rows, unnest(list_transform(vals, lambda v: coalesce(v, 'None'))) AS v, unnest(range(len(vals))) AS i FROM p)
, h AS (SELECT * FROM c UNION ALL SELECT DISTINCT question_id, side, 0, n_rows, CAST(i AS VARCHAR), i FROM c)
, w AS (SELECT *, max(length(v)) OVER (PARTITION BY question_id, side, i) AS wide,
               max(CASE WHEN rn <= 3 THEN length(v) END) OVER (PARTITION BY question_id, side, i) AS wide3 FROM h)
, l AS (SELECT question_id, side, rn, n_rows, string_agg(lpad(v, CAST(wide AS INTEGER), ' '), ' ' ORDER BY i) AS line,
               string_agg(CASE WHEN rn <= 3 THEN lpad(v, CAST(wide3 AS INTEGER), ' ') END, ' ' ORDER BY i) AS line3 FROM w GROUP BY question_id, side, rn, n_rows)
, t AS (SELECT question_id, side, n_rows, string_agg(line, chr(10) ORDER BY rn) AS whole, string_agg(line3, chr(10) ORDER BY rn) AS head FROM l GROUP BY question_id, side, n_rows)
SELECT question_id, side, CAST(n_rows AS BIGINT) AS n_rows, {text} AS text FROM t""", "sql_results")


@query("sql_result_text", _result_text_sql(f"CASE WHEN n_rows > 3 THEN '{G.PREVIEW_TRUNCATED}' || head ELSE '{G.PREVIEW_FULL}' || whole END"))
def q_result_text(spark, d):
    return G.result_text(sql_results(spark, d), max_rows=3)


@query("sql_result_text_by_length", _result_text_sql(f"CASE WHEN length(whole) > 60 THEN '{G.PREVIEW_TRUNCATED}' || head ELSE whole END"))
def q_result_text_chars(spark, d):
    return G.result_text(sql_results(spark, d), "chars", max_rows=3, max_chars=60)

"""Text grading queries (C1-C3, C5, C7-C11) over responses, documents,
conversations and GSM8K-style solutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import query
from rollspark.functions import text as T
from rollspark.operators import grade_text as GT
from rollspark.sources.fixtures import dealt, math_labels, responses, with_views
from rollspark.sources.tables import table

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x):
    return STRIP.format(x=x)


def mathd_sql(x: str, p: str) -> str:
    """DuckDB select-list (lateral aliases ``{p}_...``) computing C3 of ``x``;
    the result is ``{p}_norm``."""
    steps = [
        (f"{p}_a0", _strip(x)),
        (f"{p}_in", f"regexp_extract({p}_a0, '^\\\\text\\{{(.+?)\\}}', 1)"),
        (f"{p}_a", f"CASE WHEN {p}_in <> '' THEN {_strip(p + '_in')} ELSE {p}_a0 END"),
        (f"{p}_s1", f"replace(replace(replace(replace(replace({p}_a, chr(10), ''), '\\!', ''), '\\\\', '\\'), "
                    f"'tfrac', 'frac'), 'dfrac', 'frac')"),
        (f"{p}_s2", f"replace(replace(replace(replace(replace({p}_s1, '\\left', ''), '\\right', ''), "
                    f"'^{{\\circ}}', ''), '^\\circ', ''), '\\$', '')"),
        (f"{p}_nu", f"len(string_split({p}_s2, '\\text{{ ')) - 1"),
        (f"{p}_s3", f"CASE WHEN {p}_nu = 1 THEN string_split({p}_s2, '\\text{{ ')[1] ELSE {p}_s2 END"),
        (f"{p}_s4", f"replace(replace(replace({p}_s3, '\\%', ''), ' .', ' 0.'), '{{.', '{{0.')"),
        (f"{p}_s5", f"CASE WHEN starts_with({p}_s4, '.') THEN '0' || {p}_s4 ELSE {p}_s4 END"),
        (f"{p}_eq", f"string_split({p}_s5, '=')"),
        (f"{p}_s6", f"CASE WHEN len({p}_eq) = 2 AND length({p}_eq[1]) <= 2 THEN {p}_eq[2] ELSE {p}_s5 END"),
        (f"{p}_se", f"suffix({p}_s6, '\\sqrt')"),
        (f"{p}_s7", f"replace(regexp_replace({p}_s6, '\\\\sqrt([^{{])', '\\\\sqrt{{\\1}}', 'g'), ' ', '')"),
        (f"{p}_s8", f"regexp_replace(regexp_replace({p}_s7, '\\\\frac([^{{])([^{{])', '\\\\frac{{\\1}}{{\\2}}', 'g'), "
                    f"'\\\\frac([^{{])\\{{', '\\\\frac{{\\1}}{{', 'g')"),
        (f"{p}_s9", f"CASE WHEN {p}_s8 = '0.5' THEN '\\frac{{1}}{{2}}' ELSE {p}_s8 END"),
        (f"{p}_s10", f"CASE WHEN regexp_matches({p}_s9, '^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$') "
                     f"THEN '\\frac{{' || split_part({p}_s9, '/', 1) || '}}{{' || split_part({p}_s9, '/', 2) || '}}' "
                     f"ELSE {p}_s9 END"),
        (f"{p}_norm", f"CASE WHEN {x} IS NULL THEN NULL WHEN {p}_nu > 1 OR {p}_se THEN {p}_a ELSE {p}_s10 END"),
    ]
    return ",\n       ".join(f"{e} AS {n}" for n, e in steps)


_BOXED_CTES = """
, t0 AS (SELECT response_id, gold, response,
               CASE WHEN contains(response, '</think>') THEN split_part(response, '</think>', 2) ELSE response END AS sol
        FROM responses),
t AS (SELECT *, CASE WHEN contains(sol, '\\boxed') THEN '\\boxed' WHEN contains(sol, '\\fbox') THEN '\\fbox' END AS mk
      FROM t0),
tl AS (SELECT response_id, mk || string_split(sol, mk)[-1] AS tail FROM t WHERE mk IS NOT NULL),
ch AS (SELECT response_id, tail, unnest(generate_series(1, length(tail))) AS k FROM tl),
dep AS (SELECT response_id, tail, k, substr(tail, k, 1) AS c,
               sum(CASE WHEN substr(tail, k, 1) = '{' THEN 1 WHEN substr(tail, k, 1) = '}' THEN -1 ELSE 0 END)
                 OVER (PARTITION BY response_id ORDER BY k) AS d FROM ch),
en AS (SELECT response_id, any_value(tail) AS tail, min(k) AS e FROM dep WHERE c = '}' AND d = 0 GROUP BY 1),
lb AS (SELECT t.response_id, t.gold, t.sol, substr(en.tail, 1, en.e) AS last_boxed
       FROM t LEFT JOIN en USING (response_id)),
bx AS (SELECT response_id, gold, sol, last_boxed,
              CASE WHEN contains(sol, '\\boxed') AND starts_with(last_boxed, '\\boxed{') AND suffix(last_boxed, '}')
                   THEN substr(last_boxed, 8, length(last_boxed) - 8) END AS answer FROM lb)"""


@query("after_think", with_views("""
SELECT response_id, CASE WHEN contains(response, '</think>') THEN split_part(response, '</think>', 2)
                         ELSE response END AS solution FROM responses""", "responses"))
def q_after_think(spark, d):
    return responses(spark, d).select("response_id", T.after_think("response").alias("solution"))


@query("boxed_answer", with_views(_BOXED_CTES + """
SELECT response_id, last_boxed, answer FROM bx""", "responses"))
def q_boxed(spark, d):
    sol = T.after_think("response")
    return responses(spark, d).select("response_id", T.last_boxed(sol).alias("last_boxed"),
                                      T.boxed_answer(sol).alias("answer"))


def _mathd_oracle() -> str:
    return with_views(_BOXED_CTES + f"""
, nn AS (SELECT response_id, {mathd_sql("answer", "n")} FROM bx)
SELECT response_id, n_norm AS normalized FROM nn""", "responses")


@query("mathd_normalize", _mathd_oracle())
def q_mathd(spark, d):
    ans = T.boxed_answer(T.after_think("response"))
    return responses(spark, d).select("response_id", T.mathd_normalize(ans).alias("normalized"))


@query("gsm8k_strict_score", with_views("""
, a AS (SELECT response_id, gold,
              CASE WHEN regexp_matches(response, '#### (-?[0-9.,]+)')
                   THEN replace(replace(regexp_extract(response, '#### (-?[0-9.,]+)', 1), ',', ''), '$', '') END AS ans
        FROM responses)
SELECT response_id, ans AS model_answer,
       CAST(CASE WHEN ans IS NULL THEN 0.0 WHEN ans = gold THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM a""",
                                        "responses"))
def q_gsm8k_strict(spark, d):
    return GT.grade_gsm8k(responses(spark, d)).select("response_id", "model_answer", "score")


_MD5MOD = ("list_reduce(list_transform(string_split(md5({x}), ''), "
           "lambda h: CAST(('0x' || h) AS BIGINT)), lambda acc, h: (acc * 16 + h) % 100, 0)")


@query("gsm8k_flip_score", with_views(f"""
, a AS (SELECT response_id, gold,
              CASE WHEN regexp_matches(response, '#### (-?[0-9.,]+)')
                   THEN replace(replace(regexp_extract(response, '#### (-?[0-9.,]+)', 1), ',', ''), '$', '') END AS ans,
              {_MD5MOD.format(x="gold")} < 50 AS flip
        FROM responses)
SELECT response_id, flip,
       CAST(CASE WHEN ans IS NULL THEN 0.0 WHEN ans = gold THEN (CASE WHEN flip THEN 0.0 ELSE 1.0 END)
                 ELSE (CASE WHEN flip THEN 1.0 ELSE 0.0 END) END AS DOUBLE) AS score FROM a""", "responses"))
def q_gsm8k_flip(spark, d):
    df = GT.grade_gsm8k(responses(spark, d), random_perturb=True)
    return df.select("response_id", (T.md5_mod("gold", 100) < 50).alias("flip"), "score")


@query("gsm8k_flexible_documents", """
SELECT doc_id,
       CASE WHEN len(regexp_extract_all(text, '(-?[0-9.,]+)', 1)) = 0 THEN NULL
            WHEN len(list_filter(regexp_extract_all(text, '(-?[0-9.,]+)', 1), lambda x: x <> '' AND x <> '.')) > 0
            THEN list_filter(regexp_extract_all(text, '(-?[0-9.,]+)', 1), lambda x: x <> '' AND x <> '.')[-1]
            ELSE regexp_extract_all(text, '(-?[0-9.,]+)', 1)[1] END AS model_answer
FROM documents""")
def q_gsm8k_flexible(spark, d):
    docs = dealt(table(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", T.gsm8k_flexible("text").alias("model_answer"))


@query("gsm8k_final_line", with_views("""
, l AS (SELECT id, solution, list_filter(string_split_regex(solution, '\\r\\n|\\n|\\r'),
                                          lambda x: starts_with(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '####')) AS hits
        FROM math_labels),
c AS (SELECT id, solution, hits,
             regexp_replace(substr(regexp_replace(hits[-1], '^\\s+|\\s+$', '', 'g'), 5), '^\\s+|\\s+$', '', 'g') AS c0 FROM l)
SELECT id, CASE WHEN len(hits) > 0 THEN regexp_replace(replace(
                  CASE WHEN starts_with(c0, ':') THEN regexp_replace(substr(c0, 2), '^\\s+|\\s+$', '', 'g') ELSE c0 END,
                  ',', ''), '^\\s+|\\s+$', '', 'g') END AS answer
FROM c""", "math_labels"))
def q_final_line(spark, d):
    return math_labels(spark, d).select("id", T.final_line_answer("solution").alias("answer"))


_QA_NORM = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), "
            "'[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g'), "
            "'(^|[^\\pL\\pN_])(a|an|the)([^\\pL\\pN_]|$)', '\\1 \\3', 'g'), "
            "'(^|[^\\pL\\pN_])(a|an|the)([^\\pL\\pN_]|$)', '\\1 \\3', 'g'), '\\s+', ' ', 'g')")


def qa_norm_sql(x: str) -> str:
    return f"regexp_replace({_QA_NORM.format(x=x)}, '^ | $', '', 'g')"


@query("qa_answer_match", with_views(f"""
, a AS (SELECT response_id, gold, ['The ' || gold || '.', gold || ' dollars'] AS golds,
              CASE WHEN len(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1)) > 0
                   THEN regexp_replace(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1)[-1],
                                       '^\\s+|\\s+$', '', 'g') END AS ans
        FROM responses)
SELECT response_id, ans AS model_answer,
       CASE WHEN ans IS NULL THEN 0 WHEN len(list_filter(golds, lambda g: {qa_norm_sql('g')} = {qa_norm_sql('ans')})) > 0
            THEN 1 ELSE 0 END AS em,
       CASE WHEN ans IS NULL THEN 0 WHEN len(list_filter(golds, lambda g: contains({qa_norm_sql('ans')}, {qa_norm_sql('g')}))) > 0
            THEN 1 ELSE 0 END AS subem
FROM a""", "responses"))
def q_qa(spark, d):
    df = responses(spark, d).withColumn("golden_answers", F.array(F.concat(F.lit("The "), "gold", F.lit(".")),
                                                                  F.concat("gold", F.lit(" dollars"))))
    return GT.grade_qa(df).select("response_id", "model_answer", "em", "subem")


@query("qa_normalize_conversations", f"""
SELECT conv_id, turn, md5({qa_norm_sql('text')}) AS norm_md5 FROM conversations""")
def q_qa_norm(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(T.qa_normalize("text")).alias("norm_md5"))


@query("extract_tags", with_views("""
SELECT response_id,
       CASE WHEN regexp_matches(response, '(?s)<answer>(.*?)</answer>')
            THEN regexp_extract(response, '(?s)<answer>(.*?)</answer>', 1) END AS first_answer,
       CASE WHEN len(regexp_extract_all(response, '(?s)```(?:\\w+)?\\n(.*?)```', 1)) > 0
            THEN regexp_replace(regexp_extract_all(response, '(?s)```(?:\\w+)?\\n(.*?)```', 1)[-1], '^\\s+|\\s+$', '', 'g')
            END AS code,
       CASE WHEN regexp_matches(response, '### Final Score:\\s*([01](?:\\.0)?)')
            THEN CAST(regexp_extract(response, '### Final Score:\\s*([01](?:\\.0)?)', 1) AS DOUBLE) END AS judge_score
FROM responses""", "responses"))
def q_extract(spark, d):
    r = responses(spark, d)
    return r.select("response_id", T.first_tag("response", "answer").alias("first_answer"),
                    T.last_code_block("response").alias("code"), T.judge_score("response").alias("judge_score"))

"""Minerva scoring, strict boxed scoring and heavy answer normalisation (C4,
C6) over the model responses."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rollspark.catalog.core import query
from rollspark.catalog.grade_text import _BOXED_CTES, mathd_sql
from rollspark.functions import text as T
from rollspark.operators import grade_text as GT
from rollspark.sources.fixtures import responses, with_views


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
# the Minerva TeX rewrites in RE2 replacement syntax (same patterns as Spark's)
_SQL_REWRITES = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"),
    (r"(\\text\{)(.*?)(\})", r"\2"),
    (r"(\\textbf\{)(.*?)(\})", r"\2"),
    (r"(\\overline\{)(.*?)(\})", r"\2"),
    (r"(\\boxed\{)(.*)(\})", r"\2"),
    (r"(frac)([^{])(.)", r"frac{\2}{\3}"),
    (r"(sqrt)([^{])", r"sqrt{\2}"),
)


def _minerva_ctes(src: str, x: str, key: str, out: str) -> str:
    e = f"string_split({x}, '=')[-1]"
    for a, b in T.MINERVA_SUBSTITUTIONS:
        e = f"replace({e}, {lit(a)}, {lit(b)})"
    for r in T.MINERVA_REMOVED:
        e = f"replace({e}, {lit(r)}, '')"
    for pat, rep in _SQL_REWRITES:
        e = f"regexp_replace({e}, {lit(pat)}, {lit(rep)}, 'g')"
    e = f"replace({e}, '$', '')"
    fin = _STRIP.format("CASE WHEN regexp_matches(replace(v, ',', ''), '^[0-9]+$') THEN replace(v, ',', '') ELSE v END")
    return (f", {out}_a AS (SELECT {key}, {e} AS v FROM {src}),\n"
            f"{out} AS (SELECT {key}, {fin} AS v FROM {out}_a)")


@query("minerva_scores", with_views(f"""
, s AS (SELECT response_id, gold, coalesce(regexp_extract_all(right(response, 300), {lit(T.MINERVA_ANSWER)}, 1)[-1], '[INVALID]') AS ext
        FROM responses)
{_minerva_ctes("s", "ext", "response_id", "pn")}
{_minerva_ctes("s", "gold", "response_id", "gn")}
SELECT response_id, pn.v AS pred, CAST(CASE WHEN pn.v = gn.v THEN 1.0 ELSE -1.0 END AS DOUBLE) AS score
FROM pn JOIN gn USING (response_id)""", "responses"))
def q_minerva(spark, d):
    r = responses(spark, d)
    score, pred = T.minerva_score("response", "gold")
    return r.select("response_id", pred.alias("pred"), score.alias("score"))


@query("strict_box_scores", with_views("""
, t AS (SELECT response_id, gold, right(right(response, 300), 100) AS s FROM responses),
tl AS (SELECT response_id, '\\boxed{' || string_split(s, '\\boxed{')[-1] AS tail FROM t WHERE contains(s, '\\boxed{')),
ch AS (SELECT response_id, tail, unnest(generate_series(1, length(tail))) AS k FROM tl),
dep AS (SELECT response_id, tail, k, substr(tail, k, 1) AS c,
               sum(CASE WHEN substr(tail, k, 1) = '{' THEN 1 WHEN substr(tail, k, 1) = '}' THEN -1 ELSE 0 END)
                 OVER (PARTITION BY response_id ORDER BY k) AS d FROM ch),
en AS (SELECT response_id, any_value(tail) AS tail, min(k) AS e FROM dep WHERE c = '}' AND d = 0 GROUP BY 1),
p AS (SELECT t.response_id, t.gold, substr(substr(en.tail, 1, en.e), 8, en.e - 8) AS pred
      FROM t LEFT JOIN en USING (response_id))
SELECT response_id, pred, CAST(CASE WHEN pred IS NOT NULL AND pred = gold THEN 1.0 ELSE -1.0 END AS DOUBLE) AS score FROM p""",
                                           "responses"))
def q_strict_box(spark, d):
    r = responses(spark, d)
    score, pred = T.strict_box_score("response", "gold")
    return r.select("response_id", pred.alias("pred"), score.alias("score"))


_SQL_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def _float_sql(e: str) -> str:
    return f"CASE WHEN regexp_full_match({e}, {lit(_SQL_NUMBER)}) THEN TRY_CAST({e} AS DOUBLE) END"


def _whole_sql(f: str) -> str:
    return f"coalesce(abs({f}) < CAST('inf' AS DOUBLE) AND abs({f} - round_even({f}, 0)) <= 1e-7, false)"


def _ungrouped_sql(e: str) -> str:
    for _ in range(2):
        e = f"regexp_replace({e}, '(\\d),(\\d\\d\\d)($|\\D)', '\\1\\2\\3', 'g')"
    return e


def _plain_tex_sql(e: str) -> str:
    for pattern, plain in T.TEX_RULES:
        e = f"regexp_replace({e}, {lit(pattern)}, {lit(re.sub(r'[$]([0-9])', r'\\\1', plain))}, 'g')"
    return e


def _heavy_ctes(src: str, x: str, p: str) -> str:
    """CTEs ending in ``{p}_n(response_id, v)``: column ``x`` of ``src`` after C4."""
    e = f"CASE WHEN regexp_matches({x}, '^\\\\text\\{{.+?\\}}') THEN regexp_extract({x}, '^\\\\text\\{{(.+?)\\}}', 1) ELSE {x} END"
    for a, b in (("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "),
                 ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")):
        e = f"replace({e}, {lit(a)}, {lit(b)})"
    for u in T.HEAVY_UNITS:
        e = f"regexp_replace({e}, {lit(u + r'(es)?(s)? *(\^[0-9]+)?')}, '', 'g')"
    e = f"regexp_replace({e}, {lit(r'\^ *\\circ')}, '', 'g')"
    f, g = "(" + _float_sql(_STRIP.format("v")) + ")", "(" + _float_sql(_ungrouped_sql("v")) + ")"
    digits = "CAST(CAST({} AS HUGEINT) AS VARCHAR)"
    return (f", {p}_a AS (SELECT response_id, {e} AS v FROM {src}),\n"
            f"{p}_b AS (SELECT response_id, regexp_replace(CASE WHEN length(v) > 0 AND starts_with(v, '{{') AND suffix(v, '}}') "
            f"THEN substr(v, 2, length(v) - 2) ELSE v END, ',\\\\! *', '', 'g') AS v FROM {p}_a),\n"
            f"{p}_c AS (SELECT response_id, CASE WHEN {_whole_sql(f)} THEN {digits.format(f'round_even({f}, 0)')} ELSE v END AS v FROM {p}_b),\n"
            f"{p}_t AS (SELECT response_id, CASE WHEN contains(v, chr(92)) THEN {_plain_tex_sql('v')} ELSE v END AS v FROM {p}_c),\n"
            f"{p}_d AS (SELECT response_id, lower(replace(replace(replace(regexp_replace(regexp_replace(v, '- *', '-', 'g'), "
            f"'([0-9]) +([0-9])', '\\1+\\2', 'g'), ' ', ''), '{{', ''), '}}', '')) AS v FROM {p}_t),\n"
            f"{p}_n AS (SELECT response_id, CASE WHEN {_whole_sql(g)} "
            f"THEN {digits.format('trunc(TRY_CAST(' + 'replace(v, ' + lit(',') + ', ' + lit('') + ') AS DOUBLE))')} ELSE v END AS v FROM {p}_d)\n")


@query("heavy_normalized_answers", with_views(_BOXED_CTES + "\n" + _heavy_ctes("bx", "answer", "h") + """
SELECT response_id, v AS answer_norm FROM h_n""", "responses"))
def q_heavy(spark, d):
    r = responses(spark, d)
    b = r.select("response_id", T.boxed_answer(T.after_think("response")).alias("answer"))
    return T.heavy_normalize(b, "answer").select("response_id", "answer_norm")


# The truth of every response written in one of several ways: as it is, with
# thousands separators, with a unit, as a decimal, as a fraction, as a word
# list, as a tuple, as a TeX fraction; the last ones only match where the answer is written alike.
_TRUTH = """CASE WHEN response_id % 11 = 3 THEN concat(chr(92), 'frac{') || CAST(4 * TRY_CAST(gold AS BIGINT) + 2 AS VARCHAR(30)) || '}{4}'
 WHEN response_id % 11 = 5 THEN concat('(', chr(92), 'tfrac', chr(92), 'pi3,', chr(92), 'dfrac{') || CAST(3 * TRY_CAST(gold AS BIGINT) AS VARCHAR(30)) || '}{4}]'
 ELSE CASE response_id % 7 WHEN 0 THEN gold WHEN 1 THEN regexp_replace(gold, '^([0-9]+)([0-9]{3})$', '{1},{2}')
 WHEN 2 THEN gold || ' cm' WHEN 3 THEN gold || '.00' WHEN 4 THEN gold || '/1'
 WHEN 5 THEN gold || ' and 7' ELSE '(' || gold || ', 0.50]' END END"""
# The answer of every fifth response is written as a tuple of its own, too.
_ANSWER = """CASE WHEN response_id % 11 = 3 THEN answer || '.50'
 WHEN response_id % 11 = 5 THEN concat('(', chr(92), 'frac{', chr(92), 'pi}{3}, ') || substr(answer, 1, 0) || CAST(3 * TRY_CAST(gold AS BIGINT) AS VARCHAR(30)) || '/4]'
 WHEN response_id % 5 > 0 THEN answer WHEN response_id % 7 = 5 THEN answer || ' , 7'
 WHEN response_id % 7 = 6 THEN '(' || answer || ',1/2]' ELSE answer END"""


def _value_sql(x: str) -> str:
    num, frac = f"^{_SQL_NUMBER}$", rf"^\(?({_SQL_NUMBER})/({_SQL_NUMBER})\)?$"
    mixed, power = r"^([0-9]+)\+([0-9]+)/([0-9]+)$", rf"^({_SQL_NUMBER})\*10\^([0-9])$"

    def part(pat, i):
        return f"TRY_CAST(regexp_extract({x}, {lit(pat)}, {i}) AS DOUBLE)"
    return (f"CASE WHEN regexp_matches({x}, {lit(num)}) THEN TRY_CAST({x} AS DOUBLE) "
            f"WHEN regexp_matches({x}, {lit(frac)}) THEN {part(frac, 1)} / nullif({part(frac, 2)}, 0) "
            f"WHEN regexp_matches({x}, {lit(mixed)}) THEN {part(mixed, 1)} + {part(mixed, 2)} / nullif({part(mixed, 3)}, 0) "
            f"WHEN regexp_matches({x}, {lit(power)}) THEN {part(power, 1)} * pow(10.0, {part(power, 2)}) END")


_BRACKETED = "regexp_full_match({0}, '[()\\[\\]][^()\\[\\]]+[()\\[\\]]')"
_MEMBERS = ("CASE WHEN " + _BRACKETED + " THEN list_transform(string_split(substr({0}, 2, length({0}) - 2), ','), "
            "lambda x: trim(x)) ELSE [{0}] END")
_IS_FRAC = "regexp_matches({}, '^-?[0-9]+.?/0*[1-9][0-9]*.?$')"
_LETTERS = ("len(list_distinct(regexp_extract_all(regexp_replace(concat(a, b), 'sqrt|frac', '', 'g'), '\\p{L}')))")


def _math_grade_oracle() -> str:
    return with_views(_BOXED_CTES + f"""
, pr AS (SELECT response_id, {_ANSWER} AS answer, {_TRUTH.replace("{1}", "\\1").replace("{2}", "\\2")} AS truth FROM bx),
nn AS (SELECT response_id, {mathd_sql("answer", "g")}, {mathd_sql("truth", "t")} FROM pr)
{_heavy_ctes("pr", "answer", "hg")}{_heavy_ctes("pr", "truth", "ht")}
, hh AS (SELECT response_id, hg_n.v AS g, ht_n.v AS t, {_ungrouped_sql("hg_n.v")} AS gs, {_ungrouped_sql("ht_n.v")} AS ts
         FROM hg_n JOIN ht_n USING (response_id)),
el AS (SELECT response_id, g, t, {_MEMBERS.format("gs")} AS ge, {_MEMBERS.format("ts")} AS te FROM hh
       WHERE g IS NOT NULL AND t IS NOT NULL AND g <> '' AND t <> ''),
mb AS (SELECT response_id, unnest(ge) AS a, unnest(te) AS b FROM el
       WHERE len(ge) = len(te) AND (len(te) = 1 OR (left(g, 1) = left(t, 1) AND right(g, 1) = right(t, 1)))),
eq AS (SELECT response_id, bool_and(coalesce(CASE
         WHEN {_IS_FRAC.format("a")} AND {_IS_FRAC.format("b")} THEN a = b
         WHEN {_whole_sql("(" + _float_sql("a") + ")")} <> {_whole_sql("(" + _float_sql("b") + ")")} THEN false
         WHEN {_LETTERS} > 2 OR regexp_matches(concat(b, ')-(', a), {lit(T.UNSAFE_POWERS)}) THEN false
         ELSE a = b OR coalesce(({_value_sql("a")}) = ({_value_sql("b")}), false) END, false)) AS ok FROM mb GROUP BY 1)
SELECT pr.response_id, pr.answer AS model_answer,
       pr.answer IS NOT NULL AND (coalesce(g_norm = t_norm, false) OR coalesce(hh.g = hh.t, false) OR coalesce(eq.ok, false))
         AS is_correct
FROM pr JOIN nn USING (response_id) JOIN hh USING (response_id) LEFT JOIN eq USING (response_id)""", "responses")


@query("math_answer_grade", _math_grade_oracle())
def q_math_grade(spark, d):
    r = responses(spark, d).withColumn("answer", T.boxed_answer(T.after_think("response")))
    r = r.withColumn("ground_truths", F.array(F.expr(_TRUTH.replace("{1}", "$1").replace("{2}", "$2"))))
    r = r.withColumn("response", F.concat(F.lit("\\boxed{"), F.expr(_ANSWER), F.lit("}")))
    return GT.grade_math(r).select("response_id", "model_answer", "is_correct")

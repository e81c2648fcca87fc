"""Curation queries (P1, P2, P4, P7, J1, J3, J10, J11, O5, O6, A23, A24, A26,
A27, U8) over label tables derived from orders, documents and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.cols import hash_unit, rnd, seeded_hash
from rollspark.operators import advantages as ADV
from rollspark.operators import curate as C
from rollspark.sources.fixtures import math_labels, rollouts, sql_annotations, with_views
from rollspark.sources.tables import table

_INSTR = C.MATH_INSTRUCTION.replace("'", "''")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _flat(df):
    return df.select("data_source", F.col("prompt")[0]["content"].alias("prompt_content"), "env_class",
                     F.col("reward_spec.method").alias("method"),
                     F.col("reward_spec.ground_truth").alias("ground_truth"),
                     F.col("extra_info.split").alias("split"), F.col("extra_info.index").alias("idx"),
                     F.col("extra_info.answer").alias("answer"))


def _hex_int(expr: str) -> str:
    return f"CAST(('0x' || substr({expr}, 1, 8)) AS BIGINT)"


def _mode_sql(source, method, ans):
    return (f"SELECT '{source}' AS data_source, question || ' {_INSTR}' AS prompt_content, "
            f"'math_hard' AS env_class, '{method}' AS method, {ans} AS ground_truth, 'train' AS split, "
            f"CAST(id AS VARCHAR) AS idx, {ans} AS answer FROM math_labels")


_RANDOM_ANSWER = "CAST(" + _hex_int("md5('42|' || CAST(id AS VARCHAR))") + " % 1000 AS VARCHAR)"


@query("math_prompt_rows", with_views("\n" + " UNION ALL ".join([
    _mode_sql("default", "rule", "groundtruth_answer"),
    _mode_sql("incorrect", "rule", "incorrect_answer"),
    _mode_sql("format_reward", "format", "groundtruth_answer"),
    _mode_sql("random_noise", "rule", _RANDOM_ANSWER),
]), "math_labels"))
def q_math_prompt_rows(spark, d):
    lab = math_labels(spark, d).withColumnRenamed("id", "index")
    parts = [_flat(C.math_prompt_rows(lab, m)) for m in ("clean", "noisy", "format_reward", "random_noise")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("noise_ready_rows", with_views(f"""
SELECT CAST(id AS VARCHAR) AS idx, groundtruth_answer AS ground_truth,
       CAST({_hex_int("md5('0|wrong|' || CAST(id AS VARCHAR))")} % 100 AS VARCHAR) AS wrong_answer,
       {R(_hex_int("md5('0|param|' || CAST(id AS VARCHAR))") + " / 4294967296.0")} AS param
FROM math_labels""", "math_labels"))
def q_noise_ready(spark, d):
    lab = math_labels(spark, d).withColumnRenamed("id", "index").withColumnRenamed("groundtruth_answer", "answer")
    rows = C.noise_ready_rows(lab, "deepscaler")
    return rows.select(F.col("extra_info.index").alias("idx"), F.col("reward_spec.ground_truth").alias("ground_truth"),
                       F.col("reward_spec.wrong_answer").alias("wrong_answer"),
                       rnd(F.col("noise_spec.param").cast("double")).alias("param"))


def _clean_noisy(spark, d):
    lab = math_labels(spark, d)
    clean = lab.select("id", F.col("groundtruth_answer").alias("ground_truth"))
    noisy = lab.select("id", F.col("incorrect_answer").alias("ground_truth"), "question")
    return clean, noisy


@query("label_diff", with_views("""
SELECT id, groundtruth_answer AS clean_label, incorrect_answer AS noisy_label FROM math_labels
WHERE groundtruth_answer IS DISTINCT FROM incorrect_answer""", "math_labels"))
def q_label_diff(spark, d):
    clean, noisy = _clean_noisy(spark, d)
    return C.label_diff(clean, noisy)


NOISE_TARGET = 0.1
_MIX_SQL = f"""
, j AS (SELECT id, incorrect_answer AS ground_truth, groundtruth_answer AS gold FROM math_labels),
st AS (SELECT sum(CASE WHEN ground_truth IS DISTINCT FROM gold THEN 1 ELSE 0 END)
              - floor(count(*) * CAST({NOISE_TARGET} AS DOUBLE)) AS rec FROM j),
rk AS (SELECT id, row_number() OVER (ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) - 1 AS r
       FROM j WHERE ground_truth IS DISTINCT FROM gold),
mixed AS (SELECT j.id, CASE WHEN rk.r < st.rec THEN gold ELSE ground_truth END AS ground_truth, gold
          FROM j LEFT JOIN rk USING (id), st)"""


@query("mix_to_noise_rate", with_views(_MIX_SQL + "\nSELECT id, ground_truth FROM mixed", "math_labels"))
def q_mix(spark, d):
    clean, noisy = _clean_noisy(spark, d)
    return C.mix_to_noise_rate(clean, noisy, NOISE_TARGET).select("id", "ground_truth")


@query("noise_rate_before_after", with_views(_MIX_SQL + f"""
SELECT 'before' AS stage, {R("avg(CASE WHEN incorrect_answer IS DISTINCT FROM groundtruth_answer THEN 1.0 ELSE 0.0 END)")} AS noise_rate,
       CAST(sum(CASE WHEN incorrect_answer IS DISTINCT FROM groundtruth_answer THEN 1 ELSE 0 END) AS BIGINT) AS n_diff,
       CAST(count(*) AS BIGINT) AS n_rows FROM math_labels
UNION ALL
SELECT 'after', {R("avg(CASE WHEN ground_truth IS DISTINCT FROM gold THEN 1.0 ELSE 0.0 END)")},
       CAST(sum(CASE WHEN ground_truth IS DISTINCT FROM gold THEN 1 ELSE 0 END) AS BIGINT),
       CAST(count(*) AS BIGINT) FROM mixed""", "math_labels"))
def q_noise_rate(spark, d):
    clean, noisy = _clean_noisy(spark, d)
    mixed = C.mix_to_noise_rate(clean, noisy, NOISE_TARGET)
    out = [C.noise_rate(clean, x).select(F.lit(s).alias("stage"), rnd("noise_rate").alias("noise_rate"),
                                         F.col("n_diff").cast("bigint").alias("n_diff"),
                                         F.col("n_rows").cast("bigint").alias("n_rows"))
           for s, x in (("before", noisy), ("after", mixed))]
    return out[0].unionByName(out[1])


def _noise_ready_flat(spark, d):
    lab = math_labels(spark, d).withColumnRenamed("id", "index").withColumnRenamed("groundtruth_answer", "answer")
    rows = C.noise_ready_rows(lab, "deepscaler")
    return rows.select(F.col("extra_info.index").alias("index"),
                       F.col("reward_spec.ground_truth").alias("ground_truth"),
                       F.col("reward_spec.wrong_answer").alias("wrong_answer"),
                       F.col("noise_spec.param").alias("param"))


_NR = f"""
, nr AS (SELECT CAST(id AS VARCHAR) AS idx, groundtruth_answer AS gt,
              CAST({_hex_int("md5('0|wrong|' || CAST(id AS VARCHAR))")} % 100 AS VARCHAR) AS wrong_answer,
              {_hex_int("md5('0|param|' || CAST(id AS VARCHAR))")} / 4294967296.0 AS param
        FROM math_labels)"""


@query("inject_noise_replace", with_views(_NR + """
SELECT idx, CASE WHEN param < 0.2 THEN wrong_answer ELSE gt END AS ground_truth, param < 0.2 AS noised
FROM nr""", "math_labels"))
def q_inject_replace(spark, d):
    out = C.inject_noise(_noise_ready_flat(spark, d), 0.2, "randomly_replace")
    return out.select(F.col("index").alias("idx"), "ground_truth", "noised")


@query("inject_noise_generate", with_views(_NR + f"""
SELECT idx, CASE WHEN param < 0.2 THEN CAST(greatest(CAST(gt AS BIGINT) - 3, 0)
         + ({_hex_int("md5('0|' || idx)")} % 1073741824) % (CAST(gt AS BIGINT) + 3 - greatest(CAST(gt AS BIGINT) - 3, 0) + 1)
         AS VARCHAR) ELSE gt END AS ground_truth, param < 0.2 AS noised
FROM nr""", "math_labels"))
def q_inject_generate(spark, d):
    out = C.inject_noise(_noise_ready_flat(spark, d), 0.2, "randomly_generate")
    return out.select(F.col("index").alias("idx"), "ground_truth", "noised")


TEST_SOURCES = [f"src{i}" for i in range(10, 20)]  # every other source is training data
_IN_TEST = "(" + ", ".join(f"'{s}'" for s in TEST_SOURCES) + ")"


def _train_and_test(spark, d):
    docs = table(spark, d, "documents")
    held = F.coalesce(F.col("source").isin(TEST_SOURCES), F.lit(False))
    return docs.filter(~held), docs.filter(held)


@query("decontaminate", f"""
SELECT doc_id FROM documents d WHERE (source IN {_IN_TEST}) IS NOT TRUE
AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.source IN {_IN_TEST} AND t.text = d.text)""")
def q_decontaminate(spark, d):
    train, test = _train_and_test(spark, d)
    return C.decontaminate(train, test, text="text").select("doc_id")


@query("contamination_count", f"""
SELECT CAST(count(*) AS BIGINT) AS n_overlap FROM (
  SELECT text FROM documents WHERE (source IN {_IN_TEST}) IS NOT TRUE
  INTERSECT SELECT text FROM documents WHERE source IN {_IN_TEST})""")
def q_contamination(spark, d):
    train, test = _train_and_test(spark, d)
    return C.contamination_count(train, test, text="text")


@query("correction_flags", with_views("""
SELECT question_id, question IS DISTINCT FROM original_question AS question_changed,
       evidence IS DISTINCT FROM original_evidence AS evidence_changed,
       "SQL" IS DISTINCT FROM original_SQL AS SQL_changed
FROM sql_annotations""", "sql_annotations"))
def q_correction_flags(spark, d):
    return C.correction_flags(sql_annotations(spark, d)).select(
        "question_id", "question_changed", "evidence_changed", "SQL_changed")


@query("correction_report", with_views("""
SELECT CASE WHEN grouping(db_id) = 1 THEN 'ALL' ELSE db_id END AS db_id, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN question IS DISTINCT FROM original_question THEN 1 ELSE 0 END) AS BIGINT) AS n_question_changed,
       CAST(sum(CASE WHEN evidence IS DISTINCT FROM original_evidence THEN 1 ELSE 0 END) AS BIGINT) AS n_evidence_changed,
       CAST(sum(CASE WHEN "SQL" IS DISTINCT FROM original_SQL THEN 1 ELSE 0 END) AS BIGINT) AS n_SQL_changed
FROM sql_annotations GROUP BY GROUPING SETS ((db_id), ())""", "sql_annotations"))
def q_correction_report(spark, d):
    return C.correction_report(sql_annotations(spark, d)).withColumn("n_rows", F.col("n_rows").cast("bigint"))


@query("remove_false_incorrect", with_views("""
SELECT id FROM math_labels WHERE id NOT IN (
  SELECT id FROM math_labels WHERE groundtruth_answer IS DISTINCT FROM incorrect_answer
  AND substr(md5(CAST(id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3'))""", "math_labels"))
def q_remove_false(spark, d):
    clean, noisy = _clean_noisy(spark, d)
    diff = C.label_diff(clean, noisy)
    false_ids = diff.filter(F.substring(F.md5(F.col("id").cast("string")), 1, 1).isin("0", "1", "2", "3"))
    return C.remove_ids(noisy, false_ids).select("id")


@query("noise_confusion", """
SELECT quality = 1 AS noisy_correct, toxic = 0 AS truly_correct, CAST(count(*) AS BIGINT) AS n
FROM labels GROUP BY CUBE (quality = 1, toxic = 0)""")
def q_confusion(spark, d):
    lab = table(spark, d, "labels").select((F.col("quality") == 1).alias("noisy_correct"),
                                           (F.col("toxic") == 0).alias("truly_correct"))
    return C.noise_confusion(lab)


@query("advantage_agreement", with_views(f"""
, x AS (SELECT uid, sample_key, reward AS r_true,
              CASE WHEN substr(md5(CAST(uid AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') THEN 1.0 - reward
                   ELSE reward END AS r_noisy FROM rollouts),
g AS (SELECT uid, count(*) AS n, avg(r_true) AS mt, stddev_samp(r_true) AS st,
             avg(r_noisy) AS mn, stddev_samp(r_noisy) AS sn FROM x GROUP BY uid),
a AS (SELECT CASE WHEN n = 1 THEN r_true / (1.0 + 1e-6) ELSE (r_true - mt) / (st + 1e-6) END AS a_t,
             CASE WHEN n = 1 THEN r_noisy / (1.0 + 1e-6) ELSE (r_noisy - mn) / (sn + 1e-6) END AS a_n
      FROM x JOIN g USING (uid))
SELECT {R("sum(a_n * a_t) / sqrt(sum(a_n * a_n) * sum(a_t * a_t))")} AS cosine,
       {R("avg(CASE WHEN sign(a_n) = sign(a_t) THEN 1.0 ELSE 0.0 END)")} AS sign_agreement,
       CAST(count(*) AS BIGINT) AS n FROM a""", "rollouts"))
def q_agreement(spark, d):
    r = rollouts(spark, d).withColumn(
        "r_noisy", F.when(F.substring(F.md5(F.col("uid").cast("string")), 1, 1).isin("0", "1", "2", "3"),
                          1.0 - F.col("reward")).otherwise(F.col("reward")))
    a = ADV.grpo(r, score="reward", out="adv_true")
    a = ADV.grpo(a, score="r_noisy", out="adv_noisy")
    out = C.advantage_agreement(a)
    return out.select(rnd("cosine").alias("cosine"), rnd("sign_agreement").alias("sign_agreement"),
                      F.col("n").cast("bigint").alias("n"))


@query("normalize_benchmark", """
SELECT 'benchmark' AS data_source, text AS question, CAST(item_id AS VARCHAR) AS answer FROM benchmark""")
def q_norm_bench(spark, d):
    b = table(spark, d, "benchmark").select(F.col("text").alias("problem"), F.col("item_id").alias("answer"))
    return C.normalize_benchmark(b, "benchmark")


@query("gsm8k_rows", with_views("""
SELECT id, replace(regexp_extract(solution, '#### (-?[0-9.,]+)', 1), ',', '') AS ground_truth,
       replace(regexp_extract(solution, '#### (-?[0-9.,]+)', 1), ',', '') = groundtruth_answer AS matches_gold
FROM math_labels""", "math_labels"))
def q_gsm8k(spark, d):
    out = C.gsm8k_rows(math_labels(spark, d), solution="solution")
    return out.select("id", "ground_truth", (F.col("ground_truth") == F.col("groundtruth_answer")).alias("matches_gold"))


@query("benchmark_prompt_rows", with_views("\n" + " UNION ALL ".join([
    _mode_sql("default", "rule", "groundtruth_answer").replace("'train'", "'test'"),
    _mode_sql("incorrect", "rule", "incorrect_answer").replace("'train'", "'test'"),
    _mode_sql("format_reward", "format", "incorrect_answer").replace("'train'", "'test'"),
    _mode_sql("random_noise", "rule", _RANDOM_ANSWER).replace("'train'", "'test'"),
]), "math_labels"))
def q_benchmark_prompts(spark, d):
    lab = math_labels(spark, d).withColumnRenamed("id", "index").withColumnRenamed("question", "problem").withColumn("prompt", F.lit("not this one")) \
        .withColumnRenamed("incorrect_answer", "answer")
    return reduce(lambda a, b: a.unionByName(b), [_flat(C.benchmark_prompt_rows(lab, m)) for m in ("default", "incorrect", "format_reward", "random_noise")])


@query("gsm8k_prompt_rows", with_views(f"""
SELECT 'openai/gsm8k' AS data_source, question || {_lit(" " + C.GSM8K_INSTRUCTION)} AS content, 'gsm8k' AS env_class, 'rule' AS method,
       groundtruth_answer AS ground_truth, 'train' AS split, id AS idx, solution AS answer, question FROM math_labels""", "math_labels"))
def q_gsm8k_prompts(spark, d):
    rows = C.gsm8k_prompt_rows(math_labels(spark, d), solution="solution", index="id")
    return rows.select("data_source", F.col("prompt")[0]["content"].alias("content"), "env_class", F.col("reward_spec.method").alias("method"),
                       F.col("reward_spec.ground_truth").alias("ground_truth"), F.col("extra_info.split").alias("split"), F.col("extra_info.index").alias("idx"),
                       F.col("extra_info.answer").alias("answer"), F.col("extra_info.question").alias("question"))


@query("inject_noise_remove", with_views(f"""
SELECT id, CASE WHEN {_hex_int("md5('0|param|' || CAST(id AS VARCHAR))")} / 4294967296.0 < 0.3 THEN 'first test of ' || id ELSE groundtruth_answer END AS ground_truth,
       {_hex_int("md5('0|param|' || CAST(id AS VARCHAR))")} / 4294967296.0 < 0.3 AS noised FROM math_labels""", "math_labels"))
def q_noise_remove(spark, d):
    lab = math_labels(spark, d).withColumn("param", hash_unit(seeded_hash(0, F.lit("param"), "id"))) \
        .withColumn("insufficient_tests", F.concat(F.lit("first test of "), F.col("id").cast("string")))
    out = C.inject_noise(lab, 0.3, "randomly_remove", truth="groundtruth_answer")
    return out.select("id", F.col("groundtruth_answer").alias("ground_truth"), "noised")

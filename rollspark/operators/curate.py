"""Label curation: prompt rows, exact-rate noise mixing, noise injection,
decontamination and correction audits (P1, P2, P4, P7, J1-J3, J10, J11, O5,
O6, A23, A24, A26, A27).

Pairing of clean and noisy tables is by an explicit key (the reference pairs by
position); sampling is by a seeded md5 order, so it is distributed and
reproducible by any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollspark.functions.cols import col, hash_int, hash_unit, seeded_hash, with_scalars
from rollspark.plans.index import hashed_index

# Fixed values that must equal the reference's prompt format.
MATH_INSTRUCTION = "Let's think step by step and output the final answer within \\boxed{}."
MATH_ENV_CLASS = "math_hard"
# Fixed value: system prompt of the text-to-SQL task ({db_details},
# {external_knowledge} and {question} are literal text in it, as in the reference).
SQL_SYSTEM_PROMPT = """\
Task Overview:
You are a data science expert. Below, you are provided with a database schema and a natural language question. Your task is to understand the schema and generate a valid SQL query to answer the question within limited turns. You should breakdown the problem, draft your reasoning process, and generate the solution.

Database Engine:
SQLite

Database Schema:
{db_details}
This schema describes the database's structure, including tables, columns, primary keys, foreign keys, and any relevant relationships or constraints.

External Knowledge:
{external_knowledge}

Question:
{question}

Instructions:
- Make sure you only output the information that is asked in the question. If the question asks for a specific column, make sure to only include that column in the SELECT clause, nothing more.
- The generated query should return all of the information asked in the question without any missing or extra information.
- Before generating the final SQL query, please think through the steps of how to write the query. It should include detailed considerations such as analysing questions, summarizing relevant findings, brainstorming new ideas, verifying the accuracy of the current steps, refining any errors, thinking of how to call SQL tools, and revisiting previous steps.


Format:
- Conduct thinking inside <think>...</think> blocks every time you get new observation or information.
- You can use SQL tool written within a single <sql>your sql</sql> block to explore or verify. SQL tool output will be shown as dataframe inside <observation>...</observation>. Based on this observation, you can think again and refine.
- The returned dataframe will be truncated in 50 rows if observation is too long.
- If you find no further exploration is needed or reaches max turns, you MUST directly provide the final SQL query solution inside <solution>...</solution>.

------------------------ START OF EXAMPLE ------------------------
Question: how many pigs are in the farm?
    Database Schema:
    Table: animals
    - id (INTEGER, PRIMARY KEY)
    - species (TEXT)
    - age (INTEGER)
    - name (TEXT)

<think>I am querying how many pigs are in the farm. I will begin by checking if the 'animals' table exists and contains entries with species = 'pig'.</think>
<sql>SELECT COUNT(*) FROM animals WHERE species = 'pig';</sql>
<observation>
+----------+
| COUNT(*) |
+----------+
|   12     |
+----------+
</observation>
<think>The result indicates that there are 12 pigs in the farm. Since the question asks for how many pigs, I can now output the final SQL as the solution.</think>
<solution>SELECT COUNT(*) FROM animals WHERE species = 'pig';</solution>
------------------------ END OF EXAMPLE ------------------------
"""
SQL_ENV_CLASS = "text2sql"
SQL_MISSING_SCHEMA = "[Database schema for {db_id} not available]"

MODE_SOURCE = {"clean": "default", "noisy": "incorrect", "format_reward": "format_reward",
               "random_noise": "random_noise"}


def _message(role, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def math_prompt_rows(df: DataFrame, mode: str, question="question", gold="groundtruth_answer",
                     wrong="incorrect_answer", index="index", split: str = "train", seed: int = 42) -> DataFrame:
    """Training rows in one of four label modes (P1): clean (gold answer),
    noisy (wrong answer), format_reward (gold answer, method 'format') and
    random_noise (an integer 0-999 from a seeded hash)."""
    if mode not in MODE_SOURCE:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "noisy":
        ans = col(wrong).cast("string")
    elif mode == "random_noise":
        ans = hash_int(seeded_hash(seed, index), 1000).cast("string")
    else:
        ans = col(gold).cast("string")
    method = "format" if mode == "format_reward" else "rule"
    q = col(question)
    return df.select(
        F.lit(MODE_SOURCE[mode]).alias("data_source"),
        F.array(_message("user", F.concat(q, F.lit(" " + MATH_INSTRUCTION)))).alias("prompt"),
        F.lit(MATH_ENV_CLASS).alias("env_class"),
        F.struct(F.lit(method).alias("method"), ans.alias("ground_truth")).alias("reward_spec"),
        F.struct(F.lit(split).alias("split"), col(index).cast("string").alias("index"),
                 ans.alias("answer"), q.alias("question")).alias("extra_info"),
    )


def noise_ready_rows(df: DataFrame, data_source: str, question="question", answer="answer",
                     index="index", split: str = "train", seed: int = 0) -> DataFrame:
    """Rows ready for threshold noise (P7): ``wrong_answer`` an integer 0-99 and
    ``noise_spec.param`` uniform in [0, 1), both from seeded hashes."""
    q = col(question)
    a = col(answer).cast("string")
    wrong = hash_int(seeded_hash(seed, F.lit("wrong"), index), 100).cast("string")
    param = hash_unit(seeded_hash(seed, F.lit("param"), index))
    return df.select(
        F.lit(data_source).alias("data_source"),
        F.array(_message("user", F.concat(q, F.lit(" " + MATH_INSTRUCTION)))).alias("prompt"),
        F.lit(MATH_ENV_CLASS).alias("env_class"),
        F.struct(F.lit("rule").alias("method"), a.alias("ground_truth"), wrong.alias("wrong_answer"))
        .alias("reward_spec"),
        F.struct(F.lit("randomly_replace").alias("method"), param.cast("string").alias("param"))
        .alias("noise_spec"),
        F.struct(F.lit(split).alias("split"), col(index).cast("string").alias("index"),
                 a.alias("answer"), q.alias("question")).alias("extra_info"),
    )


def normalize_benchmark(df: DataFrame, source: str) -> DataFrame:
    """Heterogeneous benchmark rows -> (data_source, question, answer) (P2):
    the question is the first present of problem / question / prompt, the
    answer the first of answer / groundtruth_answer / solution."""
    names = set(df.columns)
    qs = [F.col(c).cast("string") for c in ("problem", "question", "prompt") if c in names]
    ans = [F.col(c).cast("string") for c in ("answer", "groundtruth_answer", "solution") if c in names]
    if not qs or not ans:
        raise ValueError("need a question and an answer column")
    return df.select(F.lit(source).alias("data_source"), F.coalesce(*qs).alias("question"),
                     F.coalesce(*ans).alias("answer"))


def benchmark_prompt_rows(df: DataFrame, source: str, index="index", split: str = "test", seed: int = 42) -> DataFrame:
    """Heterogeneous benchmark rows as the rows of :func:`math_prompt_rows`.

    The question is the first of the columns problem, question and prompt that
    the table has. The label follows ``source``: 'random_noise' a seeded integer
    0-999, 'default' the column groundtruth_answer, any other the column answer;
    'format_reward' is graded by format only."""
    names = set(df.columns)
    questions = [c for c in ("problem", "question", "prompt") if c in names]
    label = {"default": "groundtruth_answer"}.get(source, "answer")
    if not questions or (source != "random_noise" and label not in names):
        raise ValueError(f"a {source!r} benchmark needs a question column and {label!r}; there are {sorted(names)}")
    q = F.col(questions[0]).cast("string")
    ans = hash_int(seeded_hash(seed, index), 1000).cast("string") if source == "random_noise" else F.col(label).cast("string")
    return df.select(
        F.lit(source).alias("data_source"),
        F.array(_message("user", F.concat(q, F.lit(" " + MATH_INSTRUCTION)))).alias("prompt"),
        F.lit(MATH_ENV_CLASS).alias("env_class"),
        F.struct(F.lit("format" if source == "format_reward" else "rule").alias("method"), ans.alias("ground_truth")).alias("reward_spec"),
        F.struct(F.lit(split).alias("split"), col(index).cast("string").alias("index"), ans.alias("answer"), q.alias("question")).alias("extra_info"))


# Fixed values of the grade-school math rows.
GSM8K_SOURCE = "openai/gsm8k"
GSM8K_INSTRUCTION = 'Let\'s think step by step and output the final answer after "####".'


def gsm8k_prompt_rows(df: DataFrame, split: str = "train", question="question", solution="answer", index="index") -> DataFrame:
    """Whole grade-school math rows (P4): prompt with the instruction, the number after '#### ' without commas as
    ground truth, and question and solution as they were. A solution without such a number is an error."""
    found = F.regexp_extract(col(solution), r"#### (-?[0-9.,]+)", 1)
    truth = F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise(F.raise_error(F.lit("a solution has no '#### ' number")))
    return df.select(
        F.lit(GSM8K_SOURCE).alias("data_source"),
        F.array(_message("user", F.concat(col(question), F.lit(" " + GSM8K_INSTRUCTION)))).alias("prompt"),
        F.lit("gsm8k").alias("env_class"),
        F.struct(F.lit("rule").alias("method"), truth.alias("ground_truth")).alias("reward_spec"),
        F.struct(F.lit(split).alias("split"), col(index).alias("index"), col(solution).alias("answer"), col(question).alias("question")).alias("extra_info"))


def gsm8k_rows(df: DataFrame, question="question", solution="answer") -> DataFrame:
    """GSM8K row (P4): answer = text after '#### ' with commas removed; the raw
    solution is kept."""
    ans = F.replace(F.regexp_extract(col(solution), r"#### (-?[0-9.,]+)", 1), F.lit(","), F.lit(""))
    return df.withColumn("ground_truth", ans).withColumn("raw_solution", col(solution))


def label_diff(clean: DataFrame, noisy: DataFrame, key="id", label="ground_truth") -> DataFrame:
    """Keys whose label differs between the clean and the noisy table."""
    c = clean.select(col(key).alias("_k"), col(label).alias("clean_label"))
    n = noisy.select(col(key).alias("_k"), col(label).alias("noisy_label"))
    return c.join(n, "_k").filter(~F.col("clean_label").eqNullSafe(F.col("noisy_label"))) \
        .withColumnRenamed("_k", key if isinstance(key, str) else "key")


def noise_rate(clean: DataFrame, noisy: DataFrame, key="id", label="ground_truth") -> DataFrame:
    """Share of rows whose label differs."""
    c = clean.select(col(key).alias("_k"), col(label).alias("_a"))
    n = noisy.select(col(key).alias("_k"), col(label).alias("_b"))
    return c.join(n, "_k").agg(
        F.avg(F.when(F.col("_a").eqNullSafe(F.col("_b")), 0.0).otherwise(1.0)).alias("noise_rate"),
        F.sum(F.when(F.col("_a").eqNullSafe(F.col("_b")), 0).otherwise(1)).alias("n_diff"),
        F.count(F.lit(1)).alias("n_rows"))


def mix_to_noise_rate(clean: DataFrame, noisy: DataFrame, rate: float, key="id",
                      label="ground_truth", seed: int = 42) -> DataFrame:
    """Restore gold labels on ``n_diff - int(N * rate)`` differing rows chosen by
    a seeded hash so the noisy table has exactly ``int(N * rate)`` wrong labels
    (O5). Other columns of the noisy table are unchanged. Raises (at run time)
    when the noisy table has fewer wrong labels than the target."""
    k = key
    c = clean.select(col(k).alias("_k"), col(label).alias("_gold"))
    j = noisy.join(c, noisy[k] == c["_k"], "left")
    differs = ~j[label].eqNullSafe(F.col("_gold"))
    stats = j.agg(F.count(F.lit(1)).alias("_n"),
                  F.sum(F.when(differs, 1).otherwise(0)).alias("_nd"))
    stats = stats.select((F.col("_nd") - F.floor(F.col("_n") * F.lit(rate))).cast("bigint").alias("_rec"))
    diff = j.filter(differs).select(F.col("_k"), seeded_hash(seed, "_k").alias("_h"))
    ranked = hashed_index(diff, "_h", tiebreak=["_k"], name="_r")
    pick = with_scalars(ranked, stats).select(
        "_k", F.when(F.col("_rec") < 0, F.raise_error(F.lit(f"noise rate {rate} exceeds available noise")))
        .otherwise(F.col("_r") < F.col("_rec")).alias("_recover"))
    out = j.join(pick, "_k", "left")
    restored = F.when(F.coalesce(F.col("_recover"), F.lit(False)), F.col("_gold")).otherwise(F.col(label))
    return out.withColumn(label, restored).drop("_k", "_gold", "_recover")


def inject_noise(df: DataFrame, level: float, method: str, truth="ground_truth", param="param",
                 wrong="wrong_answer", reduced_tests="insufficient_tests", index="index",
                 seed: int = 0) -> DataFrame:
    """Threshold noise (O6): rows with ``param < level`` get noise, so the noisy
    set at level 0.1 is inside the one at 0.2. Methods: randomly_replace (take
    the wrong answer), randomly_remove (take the reduced tests),
    randomly_generate (integer in [max(0, g-3), g+3] from a seeded hash)."""
    hit = col(param).cast("double") < F.lit(level)
    if method == "randomly_replace":
        new = col(wrong)
    elif method == "randomly_remove":
        new = col(reduced_tests)
    elif method == "randomly_generate":
        g = col(truth).cast("bigint")
        lo = F.greatest(g - 3, F.lit(0))
        new = (lo + hash_int(seeded_hash(seed, index), 1 << 30) % (g + 3 - lo + 1)).cast("string")
    else:
        raise ValueError(f"no noise method is called {method!r}")
    return df.withColumn(truth, F.when(hit, new).otherwise(col(truth))).withColumn("noised", hit)


def decontaminate(train: DataFrame, test: DataFrame, text="problem", test_text=None) -> DataFrame:
    """Drop training rows whose text occurs in the test set (J3): left anti join."""
    t = test.select(col(test_text or text).alias("_t")).distinct()
    return train.join(t, col(text) == F.col("_t"), "left_anti")


def contamination_count(train: DataFrame, test: DataFrame, text="problem") -> DataFrame:
    """Number of distinct texts present in both (U8); 0 means clean."""
    a = train.select(col(text).alias("t"))
    b = test.select(col(text).alias("t"))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n_overlap"))


CORRECTION_FIELDS = (("question", "original_question"), ("evidence", "original_evidence"),
                     ("SQL", "original_SQL"))


def correction_flags(df: DataFrame, fields=CORRECTION_FIELDS) -> DataFrame:
    """One flag per corrected field: new value differs from the original."""
    out = df
    for new, old in fields:
        out = out.withColumn(f"{new}_changed", ~col(new).eqNullSafe(col(old)))
    return out


def correction_report(df: DataFrame, by="db_id", fields=CORRECTION_FIELDS) -> DataFrame:
    """Rows changed per field, per database and overall."""
    flags = correction_flags(df, fields)
    aggs = [F.sum(F.col(f"{n}_changed").cast("int")).cast("bigint").alias(f"n_{n}_changed") for n, _ in fields]
    g = flags.groupingSets([[by], []], by).agg(F.grouping(by).alias("_g"),
                                                F.count(F.lit(1)).alias("n_rows"), *aggs)
    return g.withColumn(by, F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(by))).drop("_g")


def noise_confusion(df: DataFrame, noisy_correct="noisy_correct", truly_correct="truly_correct",
                    by=()) -> DataFrame:
    """2x2 counts of (graded correct under noisy labels) x (truly correct),
    with margins via CUBE (A24)."""
    keys = list(by)
    return df.cube(*keys, col(noisy_correct).alias("noisy_correct"), col(truly_correct).alias("truly_correct")) \
        .agg(F.count(F.lit(1)).alias("n"))


def advantage_agreement(df: DataFrame, noisy_adv="adv_noisy", true_adv="adv_true") -> DataFrame:
    """Cosine similarity and sign agreement of two advantage columns."""
    x, y = col(noisy_adv).cast("double"), col(true_adv).cast("double")
    return df.agg(
        (F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"),
        F.avg(F.when(F.signum(x) == F.signum(y), 1.0).otherwise(0.0)).alias("sign_agreement"),
        F.count(F.lit(1)).alias("n"))


def remove_ids(df: DataFrame, ids: DataFrame, key="id") -> DataFrame:
    """Drop rows listed in ``ids`` (J11: falsely-incorrect labels)."""
    return df.join(ids.select(col(key).alias("_rid")).distinct(), col(key) == F.col("_rid"), "left_anti")


def sql_prompt_rows(annotations: DataFrame, schemas: DataFrame, data_source: str,
                    corrected: bool = False) -> DataFrame:
    """Text-to-SQL training rows (P3, J2): rows with blank SQL are skipped, the
    schema text comes from a left lookup on db_id (with a default text when
    missing), the user message carries schema, evidence and question, and
    ``extra_info.index`` is a dense index over the kept rows in question_id
    order (computed without a single-partition window)."""
    from rollspark.plans.ordered import ordered_index
    a = annotations.filter(F.trim(F.coalesce(F.col("SQL"), F.lit(""))) != "")
    # schema lookup table: one row per database, small by nature; AQE picks the
    # broadcast when it measures it small
    j = a.join(schemas.select("db_id", "schema_text"), "db_id", "left")
    details = F.coalesce(F.col("schema_text"),
                         F.concat(F.lit("[Database schema for "), F.col("db_id"), F.lit(" not available]")))
    user = F.concat(F.lit("{db_details}: "), details, F.lit("\n {external_knowledge}: "),
                    F.coalesce(F.col("evidence"), F.lit("")), F.lit(";\n {question}: "), F.col("question"))
    j = ordered_index(j, "question_id", name="_idx")
    data = "bird-platinum" if (corrected or "clean" in data_source) else "bird"
    return j.select(
        F.lit(data_source).alias("data_source"),
        F.array(F.struct(F.lit(SQL_SYSTEM_PROMPT).alias("content"), F.lit("system").alias("role")),
                F.struct(user.alias("content"), F.lit("user").alias("role"))).alias("prompt"),
        F.lit(SQL_ENV_CLASS).alias("env_class"), "db_id", F.lit(data).alias("data"),
        F.struct(F.col("SQL").alias("ground_truth"),
                 F.coalesce(F.col("grading_method"), F.lit("multiset")).alias("method")).alias("reward_spec"),
        F.struct(F.col("_idx").alias("index"), F.lit("dummy").alias("split")).alias("extra_info"),
        "question_id")

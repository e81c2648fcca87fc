"""Shaping queries (P5, P6, P8-P12, P14, P16, P19, P20, F1, F2) over prompts,
parts, conversations, documents and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rollspark.catalog.core import query
from rollspark.operators import shaping as H
from rollspark.sources.fixtures import messages, prompts, with_views
from rollspark.sources.tables import table


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _md5_digit(expr: str) -> str:
    return f"substr(md5({expr}), 1, 1)"


def _spark_md5_digit(*parts):
    return F.substring(F.md5(F.concat(*parts)), 1, 1)


# ----------------------------------------------------------------- P5

@query("search_qa_rows", with_views(f"""
, p AS (SELECT prompt_id, question, answer, data_source,
               CASE WHEN {_md5_digit("CAST(prompt_id AS VARCHAR)")} < '8' THEN struct_pack(ground_truth := [answer]) END AS reward_model,
               [answer, answer || '.0'] AS golden_answers FROM prompts)
SELECT 'searchR1_' || coalesce(CAST(data_source AS VARCHAR), '') AS data_source,
       [struct_pack(role := 'system', content := {lit(H.SEARCH_SYSTEM)}),
        struct_pack(role := 'user', content := {lit(H.SEARCH_USER_PREFIX.rstrip(chr(10)))} || coalesce(question, ''))] AS prompt,
       'search' AS env_class,
       CASE WHEN reward_model IS NOT NULL AND reward_model.ground_truth IS NOT NULL THEN reward_model.ground_truth
            ELSE golden_answers END AS ground_truth,
       prompt_id AS idx, 'train' AS split
FROM p""", "prompts"))
def q_search_rows(spark, d):
    p = prompts(spark, d)
    rm = F.when(_spark_md5_digit(F.col("prompt_id").cast("string")) < "8",
                F.struct(F.array("answer").alias("ground_truth")))
    src = p.select(F.col("prompt_id").alias("index"), "question", "data_source", rm.alias("reward_model"),
                   F.array("answer", F.concat("answer", F.lit(".0"))).alias("golden_answers"))
    r = H.search_qa_rows(src, "train")
    return r.select("data_source", "prompt", "env_class",
                    F.col("extra_info.tools_kwargs.search.create_kwargs.ground_truth").alias("ground_truth"),
                    F.col("extra_info.index").alias("idx"), F.col("extra_info.split").alias("split"))


# ----------------------------------------------------------------- P6

def _code_prompt_sql(problem: str, starter: str) -> str:
    fmt = (f"CASE WHEN coalesce({starter}, '') <> '' THEN "
           f"{lit('### Format: ' + H.CODE_WITH_STARTER + chr(10) + '```python' + chr(10))} || {starter} || "
           f"{lit(chr(10) + '```' + chr(10) + chr(10))} ELSE "
           f"{lit('### Format: ' + H.CODE_WITHOUT_STARTER + chr(10) + '```python' + chr(10) + '# YOUR CODE HERE' + chr(10) + '```' + chr(10) + chr(10))} END")
    return (f"{lit(H.CODE_SYSTEM + chr(10) + chr(10))} || {problem} || {fmt} || "
            f"{lit('### Answer: (use the provided format with backticks)' + chr(10) + chr(10))}")


@query("code_rows", f"""
WITH p AS (SELECT p_partkey, 'Return the size of part ' || p_name || '.' AS problem,
                  [struct_pack(input := CAST(p_partkey AS VARCHAR), output := CAST(p_size AS VARCHAR), testtype := 'functional'),
                   struct_pack(input := p_brand, output := p_type, testtype := 'stdin')] AS tests,
                  {_md5_digit("CAST(p_partkey AS VARCHAR)")} < '8' AS has_meta FROM part)
SELECT 'livecodebench' AS data_source,
       {_code_prompt_sql("problem", "CASE WHEN has_meta THEN 'def size_of(key):' END")} AS content,
       CASE WHEN has_meta THEN to_json(list_transform(tests, lambda t: struct_pack(input := t.input, output := t.output,
                 testtype := t.testtype, metadata := struct_pack(func_name := 'size_of'))))
            ELSE to_json(tests) END AS ground_truth,
       p_partkey AS idx, 'train' AS split
FROM p""")
def q_code_rows(spark, d):
    p = table(spark, d, "part")
    has_meta = _spark_md5_digit(F.col("p_partkey").cast("string")) < "8"
    tests = F.array(F.struct(F.col("p_partkey").cast("string").alias("input"), F.col("p_size").cast("string").alias("output"),
                             F.lit("functional").alias("testtype")),
                    F.struct(F.col("p_brand").alias("input"), F.col("p_type").alias("output"),
                             F.lit("stdin").alias("testtype")))
    src = p.select(F.col("p_partkey").alias("index"),
                   F.concat(F.lit("Return the size of part "), "p_name", F.lit(".")).alias("problem"),
                   tests.alias("tests"),
                   F.when(has_meta, F.struct(F.lit("size_of").alias("func_name"))).alias("metadata"),
                   F.when(has_meta, F.lit("def size_of(key):")).alias("starter_code"))
    r = H.code_rows(src, "livecodebench", "train")
    return r.select("data_source", F.col("prompt")[0]["content"].alias("content"),
                    F.col("reward_spec.ground_truth").alias("ground_truth"),
                    F.col("extra_info.index").alias("idx"), F.col("extra_info.split").alias("split"))


# ----------------------------------------------------------------- P8-P10

@query("from_value_messages", with_views("""
SELECT conv_id, list_transform(messages, lambda m: struct_pack(role := CASE WHEN m.role = 'user' THEN 'user' ELSE 'assistant' END,
                                                               content := m.content)) AS messages
FROM messages""", "messages"))
def q_from_value(spark, d):
    m = messages(spark, d)
    fv = F.transform("messages", lambda x: F.struct(
        F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"),
        x["content"].alias("value")))
    return m.select("conv_id", fv.alias("conversations")) \
        .select("conv_id", H.from_value_to_messages("conversations").alias("messages"))


@query("first_user_prompts", with_views("""
SELECT conv_id, prompt FROM (SELECT conv_id, list_filter(messages, lambda m: m.role = 'user')[1].content AS prompt FROM messages)
WHERE prompt IS NOT NULL AND prompt <> ''""", "messages"))
def q_first_user(spark, d):
    m = messages(spark, d).select("conv_id", H.first_user_message("messages").alias("prompt"))
    return m.filter(F.col("prompt").isNotNull() & (F.col("prompt") != ""))


@query("prompt_response_split", with_views("""
, s AS (SELECT conv_id, messages, len(messages) AS n,
               coalesce(list_position(list_transform(messages, lambda m: m.role), 'assistant'), 0) AS pos FROM messages),
t AS (SELECT *, CASE WHEN pos <= 1 THEN n ELSE pos - 1 END AS st FROM s)
SELECT conv_id, list_slice(messages, 1, st) AS prompt, list_slice(messages, st + 1, n) AS response,
       CAST(greatest(0, floor((n - 2) / 2)) AS INTEGER) AS num_turns FROM t""", "messages"))
def q_split(spark, d):
    return H.split_prompt_response(messages(spark, d)).select("conv_id", "prompt", "response", "num_turns")


# ----------------------------------------------------------------- P11 / P12

_RUBRIC = "The completion is relevant to the conversation."
_NL = "chr(10)"


@query("grader_prompts", with_views(f"""
, c AS (SELECT conv_id, messages, list_slice(messages, 1, len(messages) - 1) AS ctx FROM messages)
SELECT conv_id, [struct_pack(role := 'user', content := concat_ws({_NL},
    {lit(H.GRADER_HEAD)}, '', '<context>',
    CASE WHEN len(ctx) > 0 THEN array_to_string(list_transform(ctx, lambda x: CASE WHEN x.role IN ('user', 'system') THEN 'Human' ELSE 'Chatbot' END || ': ' || x.content), {_NL} || {_NL})
         ELSE '(No prior context)' END,
    '</context>', '', '<completion_to_grade>', 'Chatbot: ' || messages[len(messages)].content, '</completion_to_grade>', '',
    '<rubric>', {lit(_RUBRIC)}, '</rubric>', '', {lit(H.GRADER_TAIL + H.RUBRIC_INSTRUCTION)}))] AS prompt
FROM c""", "messages"))
def q_grader(spark, d):
    m = messages(spark, d)
    return m.select("conv_id", H.grader_prompt("messages", F.lit(_RUBRIC), F.lit(H.RUBRIC_INSTRUCTION)).alias("prompt"))


def _part(text: str, sep: str, i: int) -> str:
    return f"split_part({text}, {sep}, {i})"


@query("rubric_datapoints", f"""
SELECT doc_id, [struct_pack(role := 'user', content := {_part('text', _NL, 1)})] AS convo,
       concat_ws({_NL}, 'Your job is to evaluate the following: ' || {_part('text', "'. '", 1)} || '. Your response should be a score between 1 to 5.',
                 'Here is the calibration for each score:',
                 {", ".join(f"'<score>{i}.0</score>: ' || {_part('text', repr('. '), i + 1)}" for i in range(1, 6))},
                 'Here is a reference response that achieved a score of 5: ' || {_part('text', _NL, 2)}) AS rubric_str,
       {lit(H.RUBRIC_REGEX)} AS extraction_regex, {lit(H.RUBRIC_INSTRUCTION)} AS instruction
FROM documents""")
def q_rubric(spark, d):
    docs = table(spark, d, "documents")
    sp = lambda sep, i: F.split_part(F.col("text"), F.lit(sep), F.lit(i))
    src = docs.select("doc_id", sp("\n", 1).alias("instruction_text"), sp(". ", 1).alias("criteria"),
                      *[sp(". ", i + 1).alias(f"level{i}") for i in range(1, 6)], sp("\n", 2).alias("reference"))
    return src.select("doc_id", F.array(H.message("user", F.col("instruction_text"))).alias("convo"),
                      H.rubric_from_levels("criteria", [f"level{i}" for i in range(1, 6)], "reference").alias("rubric_str"),
                      F.lit(H.RUBRIC_REGEX).alias("extraction_regex"), F.lit(H.RUBRIC_INSTRUCTION).alias("instruction"))


# ----------------------------------------------------------------- P14 / P16

@query("dataset_items", with_views("""
SELECT 2 AS n_prompt, 'search' AS env_class, 'searchR1_' || data_source AS data_source, prompt_id AS idx, 'train' AS split
FROM prompts""", "prompts"))
def q_items(spark, d):
    p = prompts(spark, d)
    src = p.select(F.col("prompt_id").alias("index"), "question", "data_source",
                   F.lit(None).cast("struct<ground_truth:array<string>>").alias("reward_model"),
                   F.array("answer").alias("golden_answers"))
    it = H.dataset_item(H.search_qa_rows(src, "train"))
    return it.select(F.size("prompt").alias("n_prompt"), "env_class", F.col("env_extras.data_source").alias("data_source"),
                     F.col("env_extras.extra_info.index").alias("idx"), F.col("env_extras.extra_info.split").alias("split"))


def _flag_sql(mode: str) -> str:
    return {
        "last_assistant_message": "CAST(i = len(messages) AND x.role = 'assistant' AS INTEGER)",
        "all_assistant_messages": "CAST(x.role = 'assistant' AS INTEGER)",
        "all_messages": "1",
        "all_tokens": "1",
        "all_user_and_system_messages": "CAST(x.role IN ('user', 'system') AS INTEGER)",
        "customized": "CAST(substr(md5(CAST(conv_id AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR)), 1, 1) < '8' AS INTEGER)",
    }[mode]


def _mode_sql(mode: str) -> str:
    f = _flag_sql(mode)
    hw = 1 if mode == "all_tokens" else 0
    return (f"SELECT conv_id, '{mode}' AS mode, list_transform(messages, lambda x, i: {f}) AS flags, "
            f"flatten(list_transform(messages, lambda x, i: list_concat([{hw}, {hw}], "
            f"list_transform(range(len(string_split(x.content, ' '))), lambda _: {f})))) AS weights FROM messages")


@query("loss_flags_by_mode", with_views("\n" + "\nUNION ALL\n".join(_mode_sql(m) for m in H.LOSS_MODES), "messages"))
def q_loss_flags(spark, d):
    m = messages(spark, d)
    trainable = F.transform("messages", lambda x, i: _spark_md5_digit(
        F.col("conv_id").cast("string"), F.lit("|"), i.cast("string")) < "8")
    m = m.withColumn("trainable", trainable)
    # all modes of a conversation from one reading of its messages
    modes = []
    for mode in H.LOSS_MODES:
        fl = H.loss_flags("messages", mode, trainable="trainable" if mode == "customized" else None)
        modes.append(F.struct(F.lit(mode).alias("mode"), fl.alias("flags"), H.token_weights("messages", fl, 2, mode).alias("weights")))
    return m.select("conv_id", F.explode(F.array(*modes)).alias("_m")).select("conv_id", "_m.mode", "_m.flags", "_m.weights")


# ----------------------------------------------------------------- P19 / P20

_FA = "substr(md5('fa|' || CAST(doc_id AS VARCHAR)), 1, 1) < 'c'"


@query("distill_sft_rows", f"""
WITH t AS (SELECT split_part(text, chr(10), 1) AS question,
                  CASE WHEN {_FA} THEN 'Reasoning done. Final Answer: ' || lang ELSE 'I am not sure.' END AS response
           FROM documents)
SELECT [struct_pack(role := 'user', content := question),
        struct_pack(role := 'assistant', content := regexp_extract(response, 'Final Answer: ([\\pL\\pN_]+)', 1))] AS messages
FROM t WHERE regexp_matches(response, 'Final Answer: ([\\pL\\pN_]+)')""")
def q_distill(spark, d):
    docs = table(spark, d, "documents")
    fa = _spark_md5_digit(F.lit("fa|"), F.col("doc_id").cast("string")) < "c"
    t = docs.select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("question"),
                    F.when(fa, F.concat(F.lit("Reasoning done. Final Answer: "), "lang"))
                    .otherwise(F.lit("I am not sure.")).alias("response"))
    return H.distill_sft_rows(t)


def _run_name_sql() -> str:
    return (
        "'ds' || lower(o_orderstatus) || '-Qwen-Qwen3-8B-' || CAST(8 * (1 + o_orderkey % 4) AS STRING) || 'rank-' || "
        "CASE WHEN substr(md5(CAST(o_orderkey AS STRING)), 1, 1) < '5' THEN '0.0005' "
        "WHEN substr(md5(CAST(o_orderkey AS STRING)), 1, 1) < 'a' THEN '5e-4' ELSE '1e-3' END || 'lr-' || "
        "CAST(16 * (1 + o_custkey % 3) AS STRING) || 'batch-' || "
        "CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(1 + o_orderkey % 8 AS STRING) || 'shot-' END || "
        "'seed' || CAST(o_orderkey % 3 AS STRING) || '-' || CAST(CAST(o_orderdate AS DATE) AS STRING)")


def _opt_sql(pat: str, cast: str | None) -> str:
    v = f"CASE WHEN regexp_matches(name, '{pat}') THEN regexp_extract(name, '{pat}', 1) END"
    return f"CAST({v} AS {cast})" if cast else v


@query("sweep_run_params", f"""
WITH r AS (SELECT {_run_name_sql()} AS name FROM orders)
SELECT name, split_part(name, '-', 1) AS dataset, {_opt_sql(r'-(\d+)rank-', 'INTEGER')} AS lora_rank,
       {_opt_sql(r'-([\d.e+-]+)lr-', 'DOUBLE')} AS learning_rate, {_opt_sql(r'-(\d+)batch', 'INTEGER')} AS batch_size,
       {_opt_sql(r'-(\d+)shot-', 'INTEGER')} AS examples_per_class, {_opt_sql(r'-seed(\d+)-', 'INTEGER')} AS subset_seed,
       {_opt_sql(r'-(\d{4}-\d{2}-\d{2})$', None)} AS date
FROM r""")
def q_sweep(spark, d):
    r = table(spark, d, "orders").select(F.expr(_run_name_sql()).alias("name"))
    return r.select("name", *H.sweep_params("name"))


# ----------------------------------------------------------------- F1 / F2

@query("prompt_length_filter", """
SELECT doc_id, 2 + len(string_split(text, ' ')) AS prompt_len FROM documents WHERE 2 + len(string_split(text, ' ')) <= 400""")
def q_length(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array(H.message("user", F.col("text"))).alias("prompt"))
    ln = H.prompt_length("prompt")
    return H.drop_long_prompts(docs, 400, ln).select("doc_id", ln.alias("prompt_len"))


@query("usable_rows_quarantine", """
WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS question, split_part(text, chr(10), 2) AS answer FROM documents)
SELECT doc_id, CASE WHEN question IS NULL OR trim(question) = '' THEN 'missing_question'
                    WHEN answer IS NULL OR trim(answer) = '' THEN 'missing_answer' END AS reason FROM t""")
def q_usable(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("question"),
                                            F.split_part("text", F.lit("\n"), F.lit(2)).alias("answer"))
    kept, quarantine = H.split_usable(t)
    return kept.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(
        quarantine.select("doc_id", "reason"))

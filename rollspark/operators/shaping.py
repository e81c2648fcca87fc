"""Dataset shaping: prompt rows for search QA and code tasks, message list
rewrites, prompt/response splits, grader prompts, rubrics, dataset items,
loss flags, distillation rows, run-name parsing, length and usability filters
(P5, P6, P8-P12, P14, P16, P19, P20, F1, F2).

All are column expressions over array<struct<role, content>> message lists,
so they run inside whole-stage codegen with no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollspark.functions.cols import col

# Prompt text that must equal the reference's, verbatim.
SEARCH_SYSTEM = "You are a helpful and harmless assistant."
SEARCH_USER_PREFIX = (
    "Answer the given question. You must conduct reasoning inside <think> and </think> "
    "first every time you get new information. After reasoning, if you find you lack "
    "some knowledge, you can call a search engine by <search> query </search> "
    "and it will return the top searched results between <information> and "
    "</information>. You can search as many times as you want. If you find no "
    "further external knowledge needed, you can directly provide the answer inside "
    "<answer> and </answer>, without detailed illustrations. For example, "
    "<answer> Beijing </answer>. Question: "
)
CODE_SYSTEM = ("You are an expert Python programmer. You will be given a question (problem specification) and will "
               "generate a correct Python program that matches the specification and passes all tests.")
CODE_WITH_STARTER = ("You will use the following starter code to write the solution to the problem and enclose your "
                     "code within delimiters.")
CODE_WITHOUT_STARTER = ("Read the inputs from stdin solve the problem and write the answer to stdout (do not directly "
                        "test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when "
                        "the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT.")
GRADER_HEAD = ("I will show you a conversation context, a chatbot completion to grade, and a rubric.\n"
               "Please grade the chatbot's completion based on the rubric.")
GRADER_TAIL = "Please grade the chatbot's completion based on the rubric. "
RUBRIC_REGEX = "<score>(.*)</score>"
RUBRIC_INSTRUCTION = "Please output your score between 1 and 5 wrapped in <score> ... </score>"
LOSS_MODES = ("last_assistant_message", "all_assistant_messages", "all_messages", "all_tokens",
              "all_user_and_system_messages", "customized")


def message(role, content) -> Column:
    return F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"),
                    content.alias("content"))


# ----------------------------------------------------------------- P5 / P6

def search_qa_rows(df: DataFrame, split: str, question="question", reward_model="reward_model",
                   golden="golden_answers", source="data_source", index="index") -> DataFrame:
    """P5: search-QA prompt rows. The ground truth is the reward struct's, else
    the golden answers; the source is tagged ``searchR1_``."""
    q = F.coalesce(col(question), F.lit(""))
    tagged = F.concat(F.lit("searchR1_"), F.coalesce(col(source).cast("string"), F.lit("")))
    truth = F.when(col(reward_model).isNotNull() & col(reward_model)["ground_truth"].isNotNull(),
                   col(reward_model)["ground_truth"]).otherwise(col(golden))
    create = F.struct(truth.alias("ground_truth"), q.alias("question"), tagged.alias("data_source"))
    return df.select(
        tagged.alias("data_source"),
        F.array(message("system", F.lit(SEARCH_SYSTEM)),
                message("user", F.concat(F.lit(SEARCH_USER_PREFIX.rstrip("\n")), q))).alias("prompt"),
        F.lit("search").alias("env_class"), col(reward_model).alias("reward_spec"),
        F.struct(col(index).alias("index"), F.lit(True).alias("need_tools_kwargs"), q.alias("question"),
                 F.lit(split).alias("split"),
                 F.struct(F.struct(create.alias("create_kwargs")).alias("search")).alias("tools_kwargs"))
        .alias("extra_info"))


def code_question(problem, starter) -> Column:
    """The code-generation prompt with or without starter code."""
    fmt = F.when(F.coalesce(starter, F.lit("")) != "",
                 F.concat(F.lit(f"### Format: {CODE_WITH_STARTER}\n```python\n"), starter, F.lit("\n```\n\n"))) \
        .otherwise(F.lit(f"### Format: {CODE_WITHOUT_STARTER}\n```python\n# YOUR CODE HERE\n```\n\n"))
    return F.concat(F.lit(CODE_SYSTEM + "\n\n"), problem, fmt,
                    F.lit("### Answer: (use the provided format with backticks)\n\n"))


def code_rows(df: DataFrame, dataset: str, split: str, problem="problem", tests="tests", metadata="metadata",
              starter="starter_code", index="index", with_system_prompt: bool = True) -> DataFrame:
    """Code rows; the test list becomes JSON with the row's metadata pushed
    into every test (when the row has metadata)."""
    t = F.when(col(metadata).isNotNull(),
               F.to_json(F.transform(col(tests), lambda x: x.withField("metadata", col(metadata))))) \
        .otherwise(F.to_json(col(tests)))
    q = code_question(col(problem), col(starter)) if with_system_prompt else col(problem)
    return df.select(
        F.lit(dataset).alias("data_source"), F.array(message("user", q)).alias("prompt"),
        F.lit("code").alias("ability"),
        F.struct(F.lit("rule").alias("method"), t.alias("ground_truth")).alias("reward_spec"),
        F.struct(F.lit(split).alias("split"), col(index).alias("index"), F.lit(None).cast("string").alias("reference"))
        .alias("extra_info"))


# ----------------------------------------------------------------- P8-P12

def from_value_to_messages(conv) -> Column:
    """from/value records to role/content: 'human' -> user, anything else -> assistant."""
    return F.transform(col(conv), lambda m: F.struct(
        F.when(m["from"] == "human", "user").otherwise("assistant").alias("role"), m["value"].alias("content")))


def first_user_message(messages) -> Column:
    """Content of the first user message (NULL when there is none)."""
    return F.try_element_at(F.filter(col(messages), lambda m: m["role"] == "user"), F.lit(1))["content"]


def split_prompt_response(df: DataFrame, messages="messages") -> DataFrame:
    """P10: prompt = messages before the first assistant message, response =
    the rest, turns = max(0, (n - 2) // 2). No assistant message, or one that
    opens the list, makes the whole list the prompt (as the reference)."""
    m = col(messages)
    n = F.size(m)
    pos = F.array_position(F.transform(m, lambda x: x["role"]), "assistant")  # 1-based, 0 if none
    start = F.when(pos <= 1, n).otherwise(pos - 1)  # messages in the prompt
    return df.withColumn("prompt", F.slice(m, 1, start)) \
        .withColumn("response", F.slice(m, start + 1, n - start)) \
        .withColumn("num_turns", F.greatest(F.lit(0), F.floor((n - 2) / 2)).cast("int"))


def _speaker(role: Column) -> Column:
    return F.when(role.isin("user", "system"), "Human").otherwise("Chatbot")


def grader_prompt(messages, rubric_str, instruction) -> Column:
    """One user message asking a grader to score the last message of the
    conversation against the rubric, with the earlier turns as context."""
    m = col(messages)
    ctx = F.slice(m, 1, F.size(m) - 1)
    flat = F.array_join(F.transform(ctx, lambda x: F.concat(_speaker(x["role"]), F.lit(": "), x["content"])), "\n\n")
    context = F.when(F.size(ctx) > 0, flat).otherwise(F.lit("(No prior context)"))
    text = F.concat_ws("\n", F.lit(GRADER_HEAD), F.lit(""), F.lit("<context>"), context, F.lit("</context>"),
                       F.lit(""), F.lit("<completion_to_grade>"),
                       F.concat(F.lit("Chatbot: "), F.try_element_at(m, F.lit(-1))["content"]),
                       F.lit("</completion_to_grade>"), F.lit(""), F.lit("<rubric>"), col(rubric_str),
                       F.lit("</rubric>"), F.lit(""), F.concat(F.lit(GRADER_TAIL), col(instruction)))
    return F.array(message("user", text))


def rubric_from_levels(criteria, levels: list, reference) -> Column:
    """Rubric text from a criterion, five score descriptions and a
    reference answer."""
    parts = [F.concat(F.lit("Your job is to evaluate the following: "), col(criteria),
                      F.lit(". Your response should be a score between 1 to 5.")),
             F.lit("Here is the calibration for each score:")]
    parts += [F.concat(F.lit(f"<score>{i}.0</score>: "), col(c)) for i, c in enumerate(levels, start=1)]
    parts.append(F.concat(F.lit("Here is a reference response that achieved a score of 5: "), col(reference)))
    return F.concat_ws("\n", *parts)


# ----------------------------------------------------------------- P14 / P16

def dataset_item(df: DataFrame, prompt_key="prompt", env_class_key="env_class") -> DataFrame:
    """(messages, env_class, env_extras) where the extras struct holds
    every other column."""
    rest = [c for c in df.columns if c not in (prompt_key, env_class_key)]
    env = col(env_class_key) if env_class_key in df.columns else F.lit(None).cast("string")
    return df.select(col(prompt_key).alias("prompt"), env.alias("env_class"),
                     F.struct(*[col(c) for c in rest]).alias("env_extras"))


def loss_flags(messages, mode: str, trainable=None) -> Column:
    """Per-message 0/1 loss flag for a train-on-what mode; ``customized``
    reads the message's ``trainable`` field (or the ``trainable`` array)."""
    if mode not in LOSS_MODES:
        raise ValueError(f"no rule for which messages to train on is called {mode!r}")
    m = col(messages)
    n = F.size(m)

    def flag(x, i):
        if mode == "last_assistant_message":
            f = (i == n - 1) & (x["role"] == "assistant")
        elif mode == "all_assistant_messages":
            f = x["role"] == "assistant"
        elif mode in ("all_messages", "all_tokens"):
            f = F.lit(True)
        elif mode == "all_user_and_system_messages":
            f = x["role"].isin("user", "system")
        else:
            f = F.coalesce((x["trainable"] if trainable is None else F.try_element_at(col(trainable), i + 1)), F.lit(False))
        return f.cast("int")
    return F.transform(m, flag)


def token_weights(messages, flags, header_tokens: int = 2, mode: str = "") -> Column:
    """Expand message flags to token weights. Each message is a header of
    ``header_tokens`` tokens (weighted only in ``all_tokens`` mode) and one
    token per space-separated word of its content."""
    hw = F.lit(1 if mode == "all_tokens" else 0)
    z = F.arrays_zip(col(messages).alias("m"), col(flags).alias("f"))
    return F.flatten(F.transform(z, lambda x: F.concat(
        F.array_repeat(hw, header_tokens), F.array_repeat(x["f"], F.size(F.split(x["m"]["content"], " "))))))


# ----------------------------------------------------------------- P19 / P20

FINAL_ANSWER = r"Final Answer: ([\p{L}\p{N}_]+)"


def distill_sft_rows(df: DataFrame, question="question", response="response") -> DataFrame:
    """The word after ``Final Answer:`` in the teacher's output becomes
    the assistant message; rows without it are dropped."""
    ans = F.regexp_extract(col(response), FINAL_ANSWER, 1)
    return df.filter(col(response).rlike(FINAL_ANSWER)).select(
        F.array(message("user", col(question)), message("assistant", ans)).alias("messages"))


def _opt(name, pattern: str, cast: str | None) -> Column:
    v = F.when(col(name).rlike(pattern), F.regexp_extract(col(name), pattern, 1))
    return v.cast(cast) if cast else v


def sweep_params(name="name") -> list[Column]:
    """P20: hyperparameters parsed from a sweep run name
    ``{dataset}-{model}-{rank}rank-{lr}lr-{batch}batch-{shot}shot-seed{seed}-{date}``;
    a missing part is NULL."""
    return [
        F.split_part(col(name), F.lit("-"), F.lit(1)).alias("dataset"),
        _opt(name, r"-(\d+)rank-", "int").alias("lora_rank"),
        _opt(name, r"-([\d.e+-]+)lr-", "double").alias("learning_rate"),
        _opt(name, r"-(\d+)batch", "int").alias("batch_size"),
        _opt(name, r"-(\d+)shot-", "int").alias("examples_per_class"),
        _opt(name, r"-seed(\d+)-", "int").alias("subset_seed"),
        _opt(name, r"-(\d{4}-\d{2}-\d{2})$", None).alias("date"),
    ]


# ----------------------------------------------------------------- F1 / F2

def word_count(text) -> Column:
    return F.size(F.split(col(text), " "))


def prompt_length(messages) -> Column:
    """Default prompt length: space-separated words over all message contents
    plus two header tokens per message (a tokenizer can be swapped in by
    passing any length column to :func:`drop_long_prompts`)."""
    return F.aggregate(col(messages), F.lit(0), lambda acc, m: acc + 2 + word_count(m["content"]))


def drop_long_prompts(df: DataFrame, max_len: int, length: Column) -> DataFrame:
    """keep rows whose prompt length is at most ``max_len``."""
    return df.filter(length <= max_len)


def usability(question, answer) -> Column:
    """NULL when the row is usable, else the reason it is quarantined."""
    blank = lambda c: col(c).isNull() | (F.trim(col(c)) == "")
    return F.when(blank(question), "missing_question").when(blank(answer), "missing_answer")


def split_usable(df: DataFrame, question="question", answer="answer") -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantine rows with ``reason``) from one projection."""
    d = df.withColumn("reason", usability(question, answer))
    return d.filter(F.col("reason").isNull()).drop("reason"), d.filter(F.col("reason").isNotNull())

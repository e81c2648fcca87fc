"""File sources and sinks for prompt, conversation, trace, comparison, rubric
and corpus files, and the writers for curated tables, eval dumps, predictions,
metric logs and saved batches (S1-S13).

Everything is a distributed read or write: files are split across tasks by
Spark's file source, nothing passes through the driver. Paths may name a
directory, a glob or a file; writers never produce one file per row.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollspark.session import checkpoint_dir

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return os.path.join(checkpoint_dir(spark), "tables", name, uuid.uuid4().hex)


# ----------------------------------------------------------------- readers

def read_prompts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Read each path by extension (``.parquet`` or ``.json``/``.jsonl``;
    anything else is rejected) and union them by column name; a column
    missing from one file set is NULL there."""
    parts = []
    for p in paths:
        ext = os.path.splitext(p.rstrip("/"))[-1].lower()
        if ext == ".parquet":
            parts.append(spark.read.parquet(p))
        elif ext in (".json", ".jsonl"):
            parts.append(spark.read.json(p))
        else:
            raise ValueError(f"Unsupported file extension: {ext!r} ({p})")
    if not parts:
        raise ValueError("no input files")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_conversations(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """JSONL conversations with a ``messages`` list of role/content
    structs. A row without messages is an error (one counting job)."""
    df = spark.read.schema(T.StructType([T.StructField("messages", MESSAGES)])).json(path)
    if check:
        bad = df.filter(F.col("messages").isNull()).limit(1).count()
        if bad:
            raise ValueError(f"{path}: a row has no 'messages'")
    return df


def read_traces(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """S3: conversation traces whose shape varies, one ``messages`` row per
    conversation.

    JSONL (default): each line is a list of messages (one conversation) or a
    single message object (a one-message conversation). With
    ``whole_files`` every file is one JSON value: a list of conversations, a
    list of messages (one conversation) or one message.
    """
    raw = spark.read.text(path, wholetext=whole_files).select(F.trim("value").alias("v")).filter(F.col("v") != "")
    as_list = F.from_json("v", MESSAGES)
    as_msg = F.array(F.from_json("v", MESSAGE))
    if not whole_files:
        return raw.select(F.when(F.col("v").startswith("["), as_list).otherwise(as_msg).alias("messages"))
    as_lists = F.from_json("v", T.ArrayType(MESSAGES))
    nested = F.col("v").rlike(r"^\[\s*\[")
    convs = F.when(nested, as_lists).when(F.col("v").startswith("["), F.array(as_list)).otherwise(F.array(as_msg))
    return raw.select(F.explode(convs).alias("messages"))


COMPARISON = T.StructType([
    T.StructField("prompt_conversation", MESSAGES), T.StructField("completion_A", MESSAGES),
    T.StructField("completion_B", MESSAGES)])


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    """JSONL labeled comparisons; rows lacking the comparison or the label
    are dropped."""
    schema = T.StructType([T.StructField("comparison", COMPARISON), T.StructField("label", T.StringType())])
    return spark.read.schema(schema).json(path).filter(F.col("comparison").isNotNull() & F.col("label").isNotNull())


RUBRIC_ITEM = T.StructType([
    T.StructField("rubric_str", T.StringType()), T.StructField("extraction_regex", T.StringType()),
    T.StructField("grader_output_format_instruction", T.StringType())])


def read_rubrics(spark: SparkSession, path: str) -> DataFrame:
    """Rubric JSONL into nested rows (conversation + rubric items)."""
    schema = T.StructType([T.StructField("convo", MESSAGES),
                           T.StructField("rubric_items", T.ArrayType(RUBRIC_ITEM))])
    return spark.read.schema(schema).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus JSONL (``id``, ``contents``); the title is the first line of
    the contents, the text is what follows it."""
    df = spark.read.schema("id STRING, contents STRING").json(path)
    return df.select("id", "contents", F.expr("trim(BOTH '\"' FROM split_part(contents, '\n', 1))").alias("title"),
                     F.when(F.instr("contents", "\n") > 0,
                            F.expr("substring(contents, instr(contents, '\n') + 1)")).otherwise(F.lit(""))
                     .alias("text"))


# ----------------------------------------------------------------- writers

def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a curated table as parquet."""
    df.write.mode(mode).parquet(path)


def sanitize_source(c) -> F.Column:
    """NULL -> 'unknown', '/' -> '_'."""
    return F.translate(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("unknown")), "/", "_")


def dump_eval(df: DataFrame, path: str, metrics: DataFrame, source: str = "data_source") -> None:
    """Eval rows as JSON lines, one folder per sanitised data source
    (``source_file=<name>``), plus the aggregate metrics under
    ``aggregated_results``."""
    df.withColumn("source_file", sanitize_source(source)).write.mode("overwrite") \
        .partitionBy("source_file").json(os.path.join(path, "per_source"))
    metrics.write.mode("overwrite").json(os.path.join(path, "aggregated_results"))


def read_eval_dump(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("basePath", os.path.join(path, "per_source"))
    if schema is not None:
        r = r.schema(schema)
    return r.json(os.path.join(path, "per_source"))


def write_predictions(df: DataFrame, path: str, key: str = "question_id", files: int | None = None) -> None:
    """Predictions keyed by question id as one parquet table, clustered by
    key (a few large files, never one per question)."""
    d = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    d.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append one batch of per-step metric rows as JSON lines."""
    df.write.mode("append").json(path)


def save_batch(df: DataFrame, path: str, step_col: str = "step") -> None:
    """Save training batches keyed by step (one partition folder per
    step; re-saving a step replaces only that step)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step_col).parquet(path)


def load_batch(spark: SparkSession, path: str, step: int | None = None, step_col: str = "step") -> DataFrame:
    """Reload all saved batches, or one step (partition pruning)."""
    df = spark.read.parquet(path)
    return df if step is None else df.filter(F.col(step_col) == step)


def synth_multiplication(keys: DataFrame, key: str, digits: int = 3, seed: int = 0) -> DataFrame:
    """One n-digit multiplication prompt per key; operands are drawn from
    md5(seed|key|side) so the table is reproducible and needs no driver RNG."""
    lo, hi = 10 ** (digits - 1), 10 ** digits - 1

    def operand(side: str):
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.lit(side)))
        return (F.lit(lo) + F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % (hi - lo + 1)).cast("bigint")

    d = keys.select(F.col(key), operand("a").alias("a"), operand("b").alias("b"))
    return d.select(key, "a", "b",
                    F.format_string("What is %d * %d?", "a", "b").alias("question"),
                    (F.col("a") * F.col("b")).cast("string").alias("answer"))


def write_combined(trains: list[DataFrame], test: DataFrame, path: str) -> None:
    """Union the training sets by name into one parquet table; the test
    set is written as JSON records next to it."""
    out = trains[0]
    for df in trains[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    out.write.mode("overwrite").parquet(os.path.join(path, "train"))
    test.write.mode("overwrite").json(os.path.join(path, "test"))

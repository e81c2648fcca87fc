"""Source and sink queries (S1-S13): each writes tables derived from the driver
tables to files under the shared checkpoint folder, reads them back with the
operator under test and returns what was read."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollspark.catalog.core import ORACLE, QUERIES, query
from rollspark.sources import files as S
from rollspark.sources.fixtures import messages, prompts, rollouts, with_views
from rollspark.sources.tables import table


def _hex8(expr: str) -> str:
    return f"CAST(('0x' || substr({expr}, 1, 8)) AS BIGINT)"


def _md5_low(col: str) -> str:
    return f"substr(md5(CAST({col} AS VARCHAR)), 1, 1) < '8'"


@query("read_prompt_files", """
SELECT doc_id, lang, CASE WHEN lang = 'en' THEN source END AS source, n_chars, text FROM documents""")
def q_read_prompts(spark, d):
    docs = table(spark, d, "documents")
    base = S.scratch_path(spark, "prompt_files")
    docs.filter(F.col("lang") == "en").write.parquet(base + "/en.parquet")
    docs.filter(F.col("lang") != "en").drop("source").write.json(base + "/other.jsonl")
    out = S.read_prompts(spark, [base + "/en.parquet", base + "/other.jsonl"])
    return out.select("doc_id", "lang", "source", "n_chars", "text")


@query("read_conversation_file", with_views("SELECT messages FROM messages", "messages"))
def q_read_conversations(spark, d):
    path = S.scratch_path(spark, "conversations") + "/conv.jsonl"
    messages(spark, d).write.json(path)
    return S.read_conversations(spark, path)


@query("read_trace_files", with_views(f"""
SELECT messages FROM messages WHERE {_md5_low('conv_id')}
UNION ALL
SELECT [struct_pack(role := role, content := text)] AS messages FROM conversations WHERE NOT {_md5_low('conv_id')}""",
                                      "messages"))
def q_read_traces(spark, d):
    low = F.substring(F.md5(F.col("conv_id").cast("string")), 1, 1) < "8"
    path = S.scratch_path(spark, "traces")
    m = messages(spark, d)
    m.filter(low).select(F.to_json("messages").alias("value")).write.text(path + "/lists")
    c = table(spark, d, "conversations")
    c.filter(~low).select(F.to_json(F.struct(F.col("role"), F.col("text").alias("content"))).alias("value")) \
        .write.text(path + "/messages")
    return S.read_traces(spark, path + "/*")


_LABEL = "substr(md5('label|' || CAST(conv_id AS VARCHAR)), 1, 1)"


@query("read_comparison_file", with_views(f"""
SELECT struct_pack(prompt_conversation := list_slice(messages, 1, 1), completion_A := list_slice(messages, 2, 2),
                   completion_B := [messages[len(messages)]]) AS comparison,
       CASE WHEN {_LABEL} < '5' THEN 'A' WHEN {_LABEL} < 'a' THEN 'B' ELSE 'Tie' END AS label
FROM messages WHERE len(messages) >= 3 AND {_LABEL} < 'c'""", "messages"))
def q_read_comparisons(spark, d):
    h = F.substring(F.md5(F.concat(F.lit("label|"), F.col("conv_id").cast("string"))), 1, 1)
    m = messages(spark, d)
    comp = F.when(F.size("messages") >= 3, F.struct(
        F.slice("messages", 1, 1).alias("prompt_conversation"), F.slice("messages", 2, 1).alias("completion_A"),
        F.slice("messages", -1, 1).alias("completion_B")))
    label = F.when(h < "5", "A").when(h < "a", "B").when(h < "c", "Tie")  # NULL label: dropped on read
    path = S.scratch_path(spark, "comparisons") + "/comparisons.jsonl"
    m.select(comp.alias("comparison"), label.alias("label")).write.json(path)
    return S.read_comparisons(spark, path)


@query("read_rubric_file", with_views("""
SELECT messages AS convo,
       list_transform(list_filter(messages, lambda m: m.role = 'assistant'),
                      lambda m: struct_pack(rubric_str := 'The response mentions ' || split_part(m.content, ' ', 1),
                                            extraction_regex := '<score>(.*)</score>',
                                            grader_output_format_instruction := 'Reply with <score>0-10</score>.')) AS rubric_items
FROM messages""", "messages"))
def q_read_rubrics(spark, d):
    items = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.struct(
        F.concat(F.lit("The response mentions "), F.split_part(m["content"], F.lit(" "), F.lit(1))).alias("rubric_str"),
        F.lit("<score>(.*)</score>").alias("extraction_regex"),
        F.lit("Reply with <score>0-10</score>.").alias("grader_output_format_instruction")))
    path = S.scratch_path(spark, "rubrics") + "/rubrics.jsonl"
    messages(spark, d).select(F.col("messages").alias("convo"), items.alias("rubric_items")).write.json(path)
    return S.read_rubrics(spark, path)


@query("read_corpus_file", """
SELECT CAST(doc_id AS VARCHAR) AS id, trim(split_part(text, chr(10), 1), '"') AS title,
       CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS text
FROM documents""")
def q_read_corpus(spark, d):
    path = S.scratch_path(spark, "corpus") + "/corpus.jsonl"
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contents")) \
        .write.json(path)
    return S.read_corpus(spark, path).select("id", "title", "text")


def _curated_sql():
    return ORACLE["math_prompt_rows"]


def q_curated(spark, d):
    path = S.scratch_path(spark, "curated") + "/math.parquet"
    S.write_table(QUERIES["math_prompt_rows"](spark, d), path)
    return spark.read.parquet(path)


@query("eval_dump_per_source", with_views("""
SELECT uid, sample_key, reward AS score, stop_reason, data_source,
       replace(coalesce(data_source, 'unknown'), '/', '_') AS source_file FROM rollouts""", "rollouts"))
def q_eval_dump(spark, d):
    from rollspark.catalog.metrics import pass_at_n_by_source
    r = rollouts(spark, d, with_source=True).select("uid", "sample_key", F.col("reward").alias("score"),
                                                    "stop_reason", "data_source")
    path = S.scratch_path(spark, "eval_dump")
    S.dump_eval(r, path, pass_at_n_by_source(spark, d))
    schema = T.StructType(r.schema.fields + [T.StructField("source_file", T.StringType())])
    return S.read_eval_dump(spark, path, schema)


@query("predictions_table", with_views("""
SELECT prompt_id AS question_id, answer AS prediction, data_source FROM prompts""", "prompts"))
def q_predictions(spark, d):
    p = prompts(spark, d).select(F.col("prompt_id").alias("question_id"), F.col("answer").alias("prediction"),
                                 "data_source")
    path = S.scratch_path(spark, "predictions")
    S.write_predictions(p, path)
    return spark.read.parquet(path)


@query("metrics_log", """
SELECT CAST(dayofmonth(ts) AS BIGINT) AS step, 'avg_value/' || event_type AS name, round(avg(value), 6) AS value
FROM events GROUP BY 1, 2
UNION ALL
SELECT CAST(dayofmonth(ts) AS BIGINT) AS step, 'count/' || event_type AS name, CAST(count(*) AS DOUBLE) AS value
FROM events GROUP BY 1, 2""")
def q_metrics_log(spark, d):
    ev = table(spark, d, "events").withColumn("step", F.dayofmonth("ts").cast("bigint"))
    path = S.scratch_path(spark, "metrics_log")
    S.append_metrics(ev.groupBy("step", "event_type").agg(F.round(F.avg("value"), 6).alias("value"))
                     .select("step", F.concat(F.lit("avg_value/"), "event_type").alias("name"), "value"), path)
    S.append_metrics(ev.groupBy("step", "event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
                     .select("step", F.concat(F.lit("count/"), "event_type").alias("name"), "value"), path)
    return spark.read.schema("step BIGINT, name STRING, value DOUBLE").json(path)


@query("saved_batches", """
SELECT event_id, user_id, value, CAST(dayofmonth(ts) AS INTEGER) AS step FROM events""")
def q_saved_batches(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "value", F.dayofmonth("ts").alias("step"))
    path = S.scratch_path(spark, "batches")
    S.save_batch(ev, path)
    return S.load_batch(spark, path).select("event_id", "user_id", "value", F.col("step").cast("int").alias("step"))


def _operand(side: str) -> str:
    return f"(100 + {_hex8(f'md5(' + chr(39) + '0|' + chr(39) + ' || CAST(o_orderkey AS VARCHAR) || ' + chr(39) + '|' + side + chr(39) + ')')} % 900)"


@query("synth_multiplication", f"""
WITH o AS (SELECT o_orderkey, {_operand('a')} AS a, {_operand('b')} AS b FROM orders)
SELECT o_orderkey, a, b, 'What is ' || CAST(a AS VARCHAR) || ' * ' || CAST(b AS VARCHAR) || '?' AS question,
       CAST(a * b AS VARCHAR) AS answer FROM o""")
def q_synth(spark, d):
    return S.synth_multiplication(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", digits=3, seed=0)


@query("combined_train_table", """
SELECT doc_id, text, lang FROM documents
UNION ALL SELECT item_id AS doc_id, text, NULL AS lang FROM benchmark""")
def q_combined(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    test = table(spark, d, "labels")
    path = S.scratch_path(spark, "combined")
    S.write_combined([docs, bench], test, path)
    return spark.read.parquet(os.path.join(path, "train")).select("doc_id", "text", "lang")


def register_late():
    """S7 reuses the P1 query and its oracle, registered by the curate module."""
    if "curated_table_roundtrip" not in QUERIES:
        query("curated_table_roundtrip", _curated_sql())(q_curated)

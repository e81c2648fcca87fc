"""Parsing queries (C12, C13, C14, C16): typed content blocks of assistant
turns, tool-call arguments, code test lists and arena content parts, over
conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import query
from rollspark.operators import parts as P
from rollspark.sources.fixtures import messages, with_views
from rollspark.sources.tables import table

_H = "substr(md5(CAST(conv_id AS STRING) || '|' || CAST(turn AS STRING)), 1, 1)"

_CONTENT = f"""CASE WHEN {_H} < '4' THEN '<think>' || split_part(text, '. ', 1) || '</think>' || text
     WHEN {_H} < '8' THEN text || '<tool_call>{{"name": "search", "arguments": {{"query": "q' || CAST(turn AS STRING) || '"}}}}</tool_call>'
     WHEN {_H} < 'a' THEN '<think></think>' || text || '<tool_call>{{bad</tool_call>'
     WHEN {_H} < 'c' THEN '<tool_call>[1]</tool_call>' || text
     ELSE text END"""


def q_blocks(spark, d):
    c = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", P.parse_content_blocks(F.expr(_CONTENT)).alias("parts"))


query("content_blocks")(q_blocks)  # rows-only check: JSON tool-call parsing has no faithful SQL twin here

_ARGS = f"""CASE WHEN {_H} < '3' THEN '{{"query": "SELECT ' || CAST(turn AS STRING) || '"}}'
     WHEN {_H} < '6' THEN '{{"query_list": ["' || role || '", "c' || CAST(conv_id AS STRING) || '"]}}'
     WHEN {_H} < '8' THEN '{{"query_list": []}}'
     WHEN {_H} < 'a' THEN 'not json ' || CAST(turn AS STRING)
     WHEN {_H} < 'c' THEN '{{"query_list": "' || role || '"}}'
     WHEN {_H} < 'e' THEN '{{"query_list": ["a", " "]}}'
     ELSE '{{"other": 1}}' END"""


@query("tool_call_arguments", f"""
WITH a AS (SELECT conv_id, turn, {_ARGS} AS a FROM conversations),
j AS (SELECT *, json_valid(a) AS ok FROM a),
k AS (SELECT *, CASE WHEN ok THEN json_extract(a, '$.query') END AS q,
             CASE WHEN ok THEN json_extract(a, '$.query_list') END AS ql FROM j),
e AS (SELECT *, CASE WHEN NOT ok THEN 'Error in parsing tool call arguments: invalid JSON'
                     WHEN q IS NULL THEN 'Error in parsing tool call arguments: ''query''' END AS sql_error,
             CASE WHEN NOT ok THEN 'Error invoking search tool: Invalid JSON in arguments'
                  WHEN ql IS NULL OR json_type(ql) <> 'ARRAY' THEN 'Error invoking search tool: query_list is required'
                  WHEN json_array_length(ql) = 0
                       OR NOT list_bool_and(list_transform(json_extract(ql, '$[*]'),
                                lambda x: json_type(x) = 'VARCHAR' AND trim(json_extract_string(x, '$')) <> ''))
                  THEN 'Error invoking search tool: query_list must be a list of non-empty strings' END AS search_error
      FROM k)
SELECT conv_id, turn, CASE WHEN sql_error IS NULL THEN json_extract_string(a, '$.query') END AS sql, sql_error,
       CASE WHEN search_error IS NULL THEN json_extract_string(a, '$.query_list[*]') END AS queries, search_error
FROM e""")
def q_args(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_ARGS).alias("a"))
    s, q = P.sql_tool_query("a"), P.search_query_list("a")
    return c.select("conv_id", "turn", s["sql"].alias("sql"), s["error"].alias("sql_error"),
                    q["queries"].alias("queries"), q["error"].alias("search_error"))


_PH = "substr(md5(CAST(p_partkey AS STRING)), 1, 1)"
_TESTS = f"""CASE WHEN {_PH} < '4' THEN '[{{"input": "' || CAST(p_partkey AS STRING) || '", "output": "' || CAST(p_size AS STRING) || '", "testtype": "functional"}}]'
     WHEN {_PH} < '8' THEN '{{"inputs": ["' || CAST(p_partkey AS STRING) || '", "' || CAST(p_size AS STRING) || '"], "outputs": [["' || p_brand || '"]], "fn_name": "f"}}'
     WHEN {_PH} < 'c' THEN '{{"input": ' || CAST(p_size AS STRING) || ', "output": "' || p_type || '"}}'
     ELSE '{{oops' END"""


def q_code_tests(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(_TESTS).alias("raw"), F.lit("size_of").alias("fn"))
    return p.select("p_partkey", P.normalize_code_tests("raw", "fn").alias("tests"))


query("code_tests_normalized")(q_code_tests)  # rows-only check


_IMG = "substr(md5('img|' || CAST(conv_id AS VARCHAR)), 1, 1) < '3'"


@query("arena_messages", with_views(f"""
, c AS (SELECT conv_id, list_transform(messages, lambda m, i: struct_pack(role := m.role, content :=
            list_concat([struct_pack(type := 'text', text := split_part(m.content, '. ', 1)),
                         struct_pack(type := 'text', text := split_part(m.content, '. ', 2))],
                        CASE WHEN i = len(messages) AND {_IMG} THEN [struct_pack(type := 'image', text := NULL)]
                             ELSE [] END))) AS conversation FROM messages)
SELECT conv_id, CASE WHEN NOT list_bool_or(list_transform(conversation, lambda m: list_bool_or(list_transform(m.content, lambda p: coalesce(p.type, '') <> 'text'))))
            THEN list_transform(list_filter(conversation, lambda m: len(m.content) > 0 AND m.role IN ('user', 'assistant')),
                                lambda m: struct_pack(role := m.role, content := array_to_string(list_transform(m.content, lambda p: coalesce(p.text, '')), ' ')))
            END AS messages
FROM c""", "messages"))
def q_arena(spark, d):
    img = F.substring(F.md5(F.concat(F.lit("img|"), F.col("conv_id").cast("string"))), 1, 1) < "3"
    m = messages(spark, d)
    part = "struct<type:string,text:string>"
    conv = F.transform("messages", lambda x, i: F.struct(x["role"].alias("role"), F.concat(
        F.array(F.struct(F.lit("text").alias("type"), F.split_part(x["content"], F.lit(". "), F.lit(1)).alias("text")),
                F.struct(F.lit("text").alias("type"), F.split_part(x["content"], F.lit(". "), F.lit(2)).alias("text"))),
        F.when((i == F.size("messages") - 1) & img,
               F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))))
        .otherwise(F.array().cast(f"array<{part}>"))).alias("content")))
    return m.select("conv_id", P.arena_messages(conv).alias("messages"))

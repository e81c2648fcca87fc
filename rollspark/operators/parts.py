"""Response and dataset parsing: typed content blocks, tool-call arguments,
code test lists and arena content parts (C12, C13, C14, C16).

JSON is read with Spark's own parsers (``from_json``, ``try_parse_json`` and
variant type checks), arrays with higher-order functions: no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollspark.functions.cols import col

BLOCK = r"(?s)<think>(.*?)</think>|<tool_call>(.*?)</tool_call>"

# Messages that must equal the reference's (tool-call parsing,
# SQL tool arguments, search tool arguments), in that order.
ERR_INVALID_JSON = "Invalid JSON"
ERR_NOT_OBJECT = "Tool call is not a JSON object"
ERR_NAME = "Missing or invalid 'name' field"
ERR_ARGUMENTS = "Missing or invalid 'arguments' field"
ERR_SQL_ARGS = "Error in parsing tool call arguments: "
ERR_SEARCH_JSON = "Error invoking search tool: Invalid JSON in arguments"
ERR_SEARCH_REQUIRED = "Error invoking search tool: query_list is required"
ERR_SEARCH_NONEMPTY = "Error invoking search tool: query_list must be a list of non-empty strings"


def _part(kind: str, text=None, name=None, arguments=None, error=None, id=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), (text if text is not None else none).alias("text"),
                    (name if name is not None else none).alias("name"),
                    (arguments if arguments is not None else none).alias("arguments"),
                    (error if error is not None else none).alias("error"),
                    (id if id is not None else none).alias("id"))


def _json_kind(v: Column) -> Column:
    """Upper-case type name of a variant value (OBJECT, ARRAY, STRING, ...)."""
    return F.upper(F.split_part(F.schema_of_variant(v), F.lit("<"), F.lit(1)))


def parse_tool_call(block: Column) -> Column:
    """One ``<tool_call>`` block -> a ``tool_call`` part (name, compact JSON
    arguments, the id if it is a text) or an ``unparsed_tool_call`` part with
    the reason."""
    body = F.trim(F.regexp_extract(block, BLOCK, 2))
    v = F.try_parse_json(body)
    name, args = F.try_variant_get(v, "$.name", "variant"), F.try_variant_get(v, "$.arguments", "variant")
    err = F.when(v.isNull(), ERR_INVALID_JSON) \
        .when(~_json_kind(v).startswith("OBJECT"), ERR_NOT_OBJECT) \
        .when(name.isNull() | (_json_kind(name) != "STRING"), ERR_NAME) \
        .when(args.isNull() | ~_json_kind(args).startswith("OBJECT"), ERR_ARGUMENTS)
    ok = _part("tool_call", name=F.try_variant_get(v, "$.name", "string"),
               arguments=F.get_json_object(body, "$.arguments"),
               id=F.when(_json_kind(F.try_variant_get(v, "$.id", "variant")) == "STRING",
                         F.try_variant_get(v, "$.id", "string")))
    return F.when(err.isNull(), ok).otherwise(_part("unparsed_tool_call", text=block, error=err))


def parse_content_blocks(content) -> Column:
    """Ordered typed parts of a message: text between blocks, ``thinking``
    for ``<think>`` blocks, tool calls for ``<tool_call>`` blocks; empty text
    and empty thinking are dropped. NULL when the content has neither tag."""
    c = col(content)
    blocks = F.regexp_extract_all(c, F.lit(BLOCK), 0)
    texts = F.split(c, BLOCK, -1)  # one more piece than blocks

    def at(i):
        b = F.try_element_at(blocks, i + 1)
        is_think = b.startswith("<think>")
        thinking = F.regexp_extract(b, BLOCK, 1)
        block_part = F.when(is_think & (thinking != ""), _part("thinking", text=thinking)) \
            .when(~is_think, parse_tool_call(b))
        t = F.try_element_at(texts, i + 1)
        return F.array(F.when(t != "", _part("text", text=t)), block_part)

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.size(blocks)), at))
    parts = F.filter(pieces, lambda p: p.isNotNull())
    return F.when(c.contains("<think>") | c.contains("<tool_call>"), parts)


# ----------------------------------------------------------------- C13

def sql_tool_query(arguments) -> Column:
    """C13 (SQL tool): struct(sql, error) from the call's JSON arguments; the
    error names why parsing failed (the reference appends the Python message)."""
    a = col(arguments)
    v = F.try_parse_json(a)
    q = F.try_variant_get(v, "$.query", "variant")
    err = F.when(v.isNull(), ERR_SQL_ARGS + "invalid JSON").when(q.isNull(), ERR_SQL_ARGS + "'query'")
    return F.struct(F.when(err.isNull(), F.try_variant_get(v, "$.query", "string")).alias("sql"), err.alias("error"))


def search_query_list(arguments) -> Column:
    """C13 (search tool): struct(queries, error): ``query_list`` must be a
    non-empty list of non-blank strings."""
    a = col(arguments)
    v = F.try_parse_json(a)
    ql = F.try_variant_get(v, "$.query_list", "variant")
    items = F.try_variant_get(v, "$.query_list", "array<variant>")
    good = F.forall(items, lambda x: (_json_kind(x) == "STRING") & (F.trim(x.cast("string")) != ""))
    err = F.when(v.isNull(), ERR_SEARCH_JSON) \
        .when(ql.isNull() | ~_json_kind(ql).startswith("ARRAY"), ERR_SEARCH_REQUIRED) \
        .when((F.size(items) == 0) | ~good, ERR_SEARCH_NONEMPTY)
    return F.struct(F.when(err.isNull(), F.try_variant_get(v, "$.query_list", "array<string>")).alias("queries"),
                    err.alias("error"))


# ----------------------------------------------------------------- C14

TEST = "struct<input:string,output:string,testtype:string,metadata:struct<func_name:string,other:map<string,string>>>"


def normalize_code_tests(raw, row_func_name=None) -> Column:
    """C14: code tests given as a JSON list of tests, one test object, or a
    TACO dict of ``inputs``/``outputs`` (+ ``fn_name``) -> array of
    (input, output, testtype, metadata). Metadata may be an object or its JSON
    text; ``func_name`` is a field of its own and the other keys are a map of
    their values as text. A shorter TACO list is
    filled with its first element; a list-valued output takes its first item;
    testtype defaults to stdin_stdout; a functional test without its own
    func_name takes the row's. Unparsable JSON gives an empty list."""
    r = col(raw)
    v = F.try_parse_json(r)
    kind = _json_kind(v)
    fn_row = F.lit(None).cast("string") if row_func_name is None else col(row_func_name)
    taco = kind.startswith("OBJECT") & F.try_variant_get(v, "$.inputs", "variant").isNotNull() \
        & F.try_variant_get(v, "$.outputs", "variant").isNotNull()
    ins = F.try_variant_get(v, "$.inputs", "array<variant>")
    outs = F.try_variant_get(v, "$.outputs", "array<variant>")
    fn = F.try_variant_get(v, "$.fn_name", "string")

    no_keys = F.create_map().cast("map<string,string>")

    def text(x):
        return F.when(_json_kind(x) == "STRING", x.cast("string")).otherwise(F.to_json(x))

    def first_if_list(x):
        return F.when(_json_kind(x).startswith("ARRAY"), F.try_element_at(x.cast("array<variant>"), F.lit(1))) \
            .otherwise(x)

    def pick(arr, i):
        return F.coalesce(F.try_element_at(arr, i + 1), F.try_element_at(arr, F.lit(1)))

    n = F.greatest(F.coalesce(F.size(ins), F.lit(0)), F.coalesce(F.size(outs), F.lit(0)))
    # sequence(0, -1) would count down: an empty TACO dict must give no tests
    taco_tests = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(
        F.coalesce(text(pick(ins, i)), F.lit("")).alias("input"),
        F.coalesce(text(first_if_list(pick(outs, i))), F.lit("")).alias("output"),
        F.when(fn.isNotNull(), "functional").otherwise("stdin_stdout").alias("testtype"),
        F.struct(fn.alias("func_name"), no_keys.alias("other")).alias("metadata")))
    objs = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")) \
        .when(kind.startswith("OBJECT"), F.array(v))

    def one(t):
        tt = F.coalesce(F.nullif(F.try_variant_get(t, "$.testtype", "string"), F.lit("")), F.lit("stdin_stdout"))
        given = F.try_variant_get(t, "$.metadata", "variant")
        meta = F.when(_json_kind(given) == "STRING", F.try_parse_json(given.cast("string"))).otherwise(given)
        own = F.try_variant_get(meta, "$.func_name", "string")
        func = F.when(tt == "functional", F.coalesce(F.nullif(own, F.lit("")), fn_row, own)).otherwise(own)
        keys = F.when(_json_kind(meta).startswith("OBJECT"), F.from_json(F.to_json(meta), "map<string,string>"))
        other = F.coalesce(F.map_filter(keys, lambda k, _: k != "func_name"), no_keys)
        inp = F.try_variant_get(t, "$.input", "variant")
        out = F.try_variant_get(t, "$.output", "variant")
        return F.when(_json_kind(t).startswith("OBJECT"), F.struct(
            F.coalesce(text(inp), F.lit("")).alias("input"), F.coalesce(text(out), F.lit("")).alias("output"),
            tt.alias("testtype"), F.struct(func.alias("func_name"), other.alias("other")).alias("metadata")))

    listed = F.filter(F.transform(objs, one), lambda x: x.isNotNull())
    empty = F.array().cast(f"array<{TEST}>")
    return F.when(v.isNull(), empty).when(taco & (n == 0), empty).when(taco, taco_tests) \
        .otherwise(F.coalesce(listed, empty))


# ----------------------------------------------------------------- C16

def arena_messages(conversation) -> Column:
    """Arena messages whose content is a list of typed parts -> role /
    content messages (text parts joined by a space); NULL when any part is not
    text; only user and assistant messages with some text are kept."""
    conv = col(conversation)
    non_text = F.exists(conv, lambda m: F.exists(m["content"], lambda p: F.coalesce(p["type"], F.lit("")) != "text"))
    msgs = F.transform(conv, lambda m: F.struct(
        m["role"].alias("role"),
        F.array_join(F.transform(m["content"], lambda p: F.coalesce(p["text"], F.lit(""))), " ").alias("content"),
        F.size(m["content"]).alias("_n")))
    kept = F.filter(msgs, lambda m: (m["_n"] > 0) & m["role"].isin("user", "assistant"))
    return F.when(~non_text, F.transform(kept, lambda m: F.struct(m["role"].alias("role"),
                                                                   m["content"].alias("content"))))

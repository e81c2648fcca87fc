"""Rollout-shaped views derived from the driver tables.

The driver ships TPC-H-like tables, not rollouts, so the operators read views
that Spark derives from them; their size grows with the tables. Each view has a
SQL twin (``SQL[name]``) so that an independent engine can rebuild the same
input for the correctness check. Token arrays are built with ``sequence`` +
``transform`` from integer arithmetic only, so both engines produce identical
values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollspark.plans.index import hashed_index
from rollspark.sources.tables import table

EOS_TOKEN = 2


def _seq(n):
    """1..n, empty for n < 1 (sequence(1, 0) would count down)."""
    return F.when(n >= 1, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all tasks by the row's own key where its files make fewer splits than the session has cores
    (one small file would be one task); larger inputs stay as they are read."""
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(*keys) if few else df


def rollouts(spark: SparkSession, d: str, with_source: bool = False,
             with_index: bool = False, with_tokens: bool = False) -> DataFrame:
    """One row per rollout, from ``lineitem``.

    uid = order key (the prompt), sample_key = md5 of (linenumber, partkey, suppkey, quantity),
    reward = 1 for return flag 'R' else 0, resp_len = quantity,
    stop_reason = 'stop' for line status 'F' else 'length'.
    """
    li = dealt(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    if with_source:  # the lines meet their orders before the token arrays are built, so no array is shuffled
        o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                             F.col("o_orderpriority").alias("data_source"))
        li = li.join(o, "l_orderkey", "left")
    df = rollout_columns(li, with_tokens, keep=("data_source",) if with_source else ())
    if with_index:
        df = hashed_index(df, "sample_key", partition_by=["uid"], name="sample_idx")
    return df


def rollout_columns(li: DataFrame, with_tokens: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rollout projection of ``lineitem`` rows; works on a batch or a
    streaming DataFrame alike."""
    q = F.col("l_quantity").cast("bigint")
    cols = [
        F.col("l_orderkey").alias("uid"),
        F.md5(F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey", q)).alias("sample_key"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
        (F.col("l_returnflag") == "R").alias("is_correct"),
        q.alias("resp_len"),
        (F.lit(5) + F.col("l_partkey") % 20).cast("bigint").alias("prompt_len"),
        F.when(F.col("l_linestatus") == "F", "stop").otherwise("length").alias("stop_reason"),
    ]
    if with_tokens:
        pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        lf = F.col("l_linestatus")
        cols += [
            F.transform(_seq(q), lambda i: F.when((i == q) & (lf == "F"), F.lit(EOS_TOKEN).cast("bigint"))
                        .otherwise(3 + (i * 31 + pk) % 997)).alias("response_ids"),
            F.transform(_seq(q), lambda i: F.when((i + sk) % 11 == 0, 0).otherwise(1)).alias("loss_mask"),
            F.transform(_seq(q), lambda i: -((i * sk) % 97).cast("double") / 100).alias("rollout_logprobs"),
            F.transform(_seq(q), lambda i: -((i * pk) % 89).cast("double") / 100).alias("log_probs"),
            F.transform(_seq(q), lambda i: -((i * (pk + sk)) % 83).cast("double") / 100).alias("base_log_probs"),
            F.transform(_seq(q), lambda i: ((i * ln) % 13).cast("double") / 10).alias("values"),
        ]
    return li.select(*cols, *keep)


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """One prompt per order: question text, gold integer answer, source."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("prompt_id"),
        F.col("o_orderpriority").alias("data_source"),
        F.concat(F.lit("What is the total price of order "), F.col("o_orderkey").cast("string"),
                 F.lit("?")).alias("question"),
        F.floor("o_totalprice").cast("bigint").cast("string").alias("answer"),
        F.col("o_orderstatus").alias("status"),
    )


def _md5_pick(c, digits: str):
    """Rows whose md5(key) starts with one of ``digits``: a stable pseudo-random subset."""
    return F.substring(F.md5(F.col(c).cast("string")), 1, 1).isin(*list(digits))


def math_labels(spark: SparkSession, d: str) -> DataFrame:
    """Raw math label table (question, gold answer, incorrect answer) from
    ``orders``: finished orders ('F', about a third) carry a wrong answer."""
    o = table(spark, d, "orders")
    gold = F.floor("o_totalprice").cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("What is the total price of order "), F.col("o_orderkey").cast("string"),
                 F.lit("?")).alias("question"),
        gold.cast("string").alias("groundtruth_answer"),
        F.when(F.col("o_orderstatus") == "F", (gold + 1 + F.col("o_custkey") % 9).cast("string"))
        .otherwise(gold.cast("string")).alias("incorrect_answer"),
        F.concat(F.lit("Add the line totals.\n#### "), F.format_number(gold, 0)).alias("solution"),
    )


def sql_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Corrected text-to-SQL annotations with their originals, from
    ``orders`` joined to ``customer`` (db_id = market segment)."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                           F.col("c_mktsegment").alias("db_id"))
    j = o.join(c, "o_custkey", "left")
    q = F.concat(F.lit("List the orders of customer "), F.col("o_custkey").cast("string"))
    ev = F.concat(F.lit("priority is "), F.col("o_orderpriority"))
    sql = F.concat(F.lit("SELECT o_orderkey FROM orders WHERE o_custkey = "), F.col("o_custkey").cast("string"))
    return j.select(
        F.col("o_orderkey").alias("question_id"), "db_id",
        q.alias("question"), ev.alias("evidence"),
        F.when(_md5_pick("o_orderkey", "0"), F.lit("  ")).otherwise(sql).alias("SQL"),
        F.when(F.col("o_orderstatus") == "F", "multiset").when(F.col("o_orderstatus") == "O", "set")
        .otherwise("list").alias("grading_method"),
        F.when(_md5_pick("o_orderkey", "12"), F.concat(q, F.lit(" please"))).otherwise(q).alias("original_question"),
        F.when(_md5_pick("o_orderkey", "34"), F.concat(F.lit("status is "), F.col("o_orderstatus")))
        .otherwise(ev).alias("original_evidence"),
        F.when(_md5_pick("o_orderkey", "5"), F.concat(sql, F.lit(" LIMIT 5"))).otherwise(sql).alias("original_SQL"),
        F.when(_md5_pick("o_orderkey", "12345"), F.lit("annotation error")).alias("reason"),
    )


def _code(c, pos: int = 1):
    return F.substring(F.md5(F.col(c).cast("string")), pos, 1)


def sql_results(spark: SparkSession, d: str) -> DataFrame:
    """Gold and predicted SQL result sets in long form
    ``(question_id, side, row_idx, vals)``.

    Question = an order: gold rows are its line items; the predicted copy is
    perturbed by the first md5 digit of the key: '0','1' drop the first row,
    '2','3' reverse the columns, '4' change a value, '5' swap the first two
    rows, '6' duplicate the first row, '7' add a blank row. Negative ids are
    1x1 numeric answers (-(order key + 1); order total, predicted with an offset)."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("question_id"), F.lit(False).alias("_one"), F.col("l_linenumber").cast("bigint").alias("_n"),
        F.col("l_partkey").cast("bigint").alias("_a"), F.col("l_suppkey").cast("bigint").alias("_b"), F.col("l_returnflag").alias("_f"), F.col("l_quantity").alias("_q"))
    o = table(spark, d, "orders")
    ones = o.select(
        (-F.col("o_orderkey") - 1).cast("bigint").alias("question_id"), F.lit(True).alias("_one"), F.lit(None).cast("bigint").alias("_n"),
        F.floor("o_totalprice").cast("bigint").alias("_a"), F.col("o_custkey").cast("bigint").alias("_b"), F.lit(None).cast("string").alias("_f"),
        F.lit(None).cast(li.schema["_q"].dataType).alias("_q"))
    # lines and totals move once, as plain columns; a total comes after every line, so lines are numbered as if alone
    h = F.when(F.col("_one"), "fff~").otherwise(F.md5(F.concat_ws("|", "_n", "_a", "_b")))
    lr = hashed_index(li.unionByName(ones), h, ["question_id"], tiebreak=["_q"], name="row_idx")
    text = F.array(F.col("_a").cast("string"), F.col("_b").cast("string"), F.col("_f"), F.col("_q").cast("bigint").cast("string"))
    lr = lr.select("question_id", "_one", "_a", "_b", "row_idx", _code("question_id").alias("_c"), text.alias("vals"))
    c, i, v = F.col("_c"), F.col("row_idx"), F.col("vals")

    def row(side, idx, vals):
        return F.struct(F.lit(side).alias("side"), idx.cast("bigint").alias("row_idx"), vals.alias("vals"))
    # one pass over the indexed lines: each line yields its gold row and up to
    # three predicted rows (the index is computed once, not once per branch)
    of_line = F.array(
        row("gold", i, v),
        F.when(~(c.isin("0", "1") & (i == 0)), row(
            "pred", F.when((c == "5") & (i == 0), F.lit(1)).when((c == "5") & (i == 1), F.lit(0)).otherwise(i),
            F.when(c.isin("2", "3"), F.reverse(v)).when((c == "4") & (i == 0), F.array(v[0], v[1], F.lit("X"), v[3]))
            .otherwise(v))),
        F.when((c == "6") & (i == 0), row("pred", F.lit(1000), v)),
        F.when((c == "7") & (i == 0), row("pred", F.lit(1001), F.array(*[F.lit("")] * 4))))
    of_total = F.array(row("gold", F.lit(0), F.array(F.col("_a").cast("string"))),
                       row("pred", F.lit(0), F.array((F.col("_a") + F.col("_b") % 3000).cast("string"))))
    return lr.select("question_id", F.explode(F.when(F.col("_one"), of_total).otherwise(of_line)).alias("_r")).filter(F.col("_r").isNotNull()) \
        .select("question_id", "_r.side", "_r.row_idx", "_r.vals")


def sql_questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per order key (and its negative for the 1x1 answers) with
    a grading method, an execution status and a model completion."""
    o = dealt(table(spark, d, "orders"), "o_orderkey")
    q = o.select(F.col("o_orderkey").alias("question_id")).unionByName(
        o.select((-F.col("o_orderkey") - 1).alias("question_id")))
    c2, c3 = _code("question_id", 2), _code("question_id", 3)
    method = F.when(c2.isin(*"012345"), "multiset").when(c2.isin(*"678"), "set").when(c2.isin("9", "a"), "list") \
        .when(c2.isin("b", "c"), "subset,>=,1").when(c2 == "d", "subset,=,2").otherwise("multiset")
    sql = F.concat(F.lit("SELECT * FROM lineitem WHERE l_orderkey = "), F.col("question_id").cast("string"))
    completion = F.when(c3 == "1", F.concat(F.lit("<think>plan</think>\n<solution>"), sql)) \
        .when(c3 == "2", F.concat(F.lit("<think>plan</think>\n<solution><think>again</think>"), sql,
                                 F.lit("</solution>"))) \
        .when(c3 == "3", F.concat(F.lit("<think>a</think><sql>SELECT 1</sql><observation>1</observation>"
                                        "<solution>"), sql, F.lit("</solution>"))) \
        .otherwise(F.concat(F.lit("<think>plan</think>\n<solution>"), sql, F.lit("</solution>")))
    return q.select("question_id", method.alias("grading_method"), (c3 != "0").alias("pred_ok"),
                    completion.alias("completion"))


def db_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Schema text per database (one per market segment; HOUSEHOLD has none)."""
    c = table(spark, d, "customer").filter(F.col("c_mktsegment") != "HOUSEHOLD")
    return c.select(F.col("c_mktsegment").alias("db_id")).distinct().select(
        "db_id", F.concat(F.lit("CREATE TABLE orders_"), F.lower("db_id"),
                          F.lit(" (o_orderkey INTEGER, o_custkey INTEGER)")).alias("schema_text"))


# response templates by the first md5 digit of the order key; {G} = gold answer
RESPONSE_TEMPLATES = {
    "0": "<think>Sum the lines.</think>\nThe total is \\boxed{{G}}.",
    "1": "<think>Sum the lines.</think>\nThe total is \\boxed{{G}}.",
    "2": "<think>a</think>b</think>\nThe total is \\boxed{{G}}.",
    "3": "<think>x</think> so \\boxed{\\frac{{G}}{2}} or rather \\boxed{{G}}",
    "4": "The total is \\boxed{{G}+1}",
    "5": "Adding up.\n#### {C}",
    "6": "Answer: {G}",
    "7": "<answer>{G}</answer> then <answer> The {G}. </answer>",
    "8": "```python\nprint({G})\n```\n### Final Score: 1",
    "9": "\\boxed{\\text{{G} dollars}}",
    "a": "\\boxed{ {G} }",
    "b": "\\boxed{0.5}",
    "c": "\\boxed{3/4} and \\boxed{\\dfrac12}",
    "d": "\\fbox{{G}}",
    "e": "no answer here, ratio 1,234.5 and .",
    "f": "x = \\boxed{x = {G}}",
}


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Model responses with gold answers, one per order: the template is
    chosen by the first md5 digit of the key (boxed, nested boxed, wrong,
    '####', 'Answer:', <answer> tags, code blocks, \\text, fractions, ...)."""
    o = dealt(table(spark, d, "orders"), "o_orderkey")
    g = F.floor("o_totalprice").cast("bigint")
    gs, cs = g.cast("string"), F.format_number(g, 0)
    code = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1)
    text = None
    for k, tpl in RESPONSE_TEMPLATES.items():
        parts = []
        rest = tpl
        while rest:
            i = min([x for x in (rest.find("{G}"), rest.find("{C}")) if x >= 0], default=-1)
            if i < 0:
                parts.append(F.lit(rest))
                break
            if i:
                parts.append(F.lit(rest[:i]))
            parts.append(gs if rest[i:i + 3] == "{G}" else cs)
            rest = rest[i + 3:]
        e = F.concat(*parts)
        text = F.when(code == k, e) if text is None else text.when(code == k, e)
    return o.select(F.col("o_orderkey").alias("response_id"), gs.alias("gold"), text.alias("response"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """One row per conversation: ``conv_id`` and its ``messages`` (role,
    content) in turn order."""
    c = table(spark, d, "conversations")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
    return m.select("conv_id", F.transform("_m", lambda x: F.struct(x["role"].alias("role"),
                                                                     x["text"].alias("content"))).alias("messages"))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Multi-turn transitions from ``conversations`` (tokens = words).

    Each assistant turn is a step of trajectory ``traj_id`` = conv_id: ``ob`` is
    every word before it (the whole history, so consecutive steps extend one
    sequence), except when md5(conv_id|turn) starts with 0-3, where the first
    word is dropped (the history is not a prefix: a new sequence starts).
    ``ac`` is the turn's words, ``ac_logprobs`` = -(len(word) % 7) / 10,
    ``reward`` = (words % 3) / 2, ``group_id`` = first md5 digit of conv_id.
    The conversation is assembled once per conversation (bounded by its
    context length); word offsets are a skew-safe running sum. The view is
    written once, as its users read it several times."""
    from rollspark.plans.ordered import ordered_cumsum
    from rollspark.session import materialize
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.split("text", " ").alias("words"))
    c = c.withColumn("n", F.size("words").cast("bigint"))
    c = ordered_cumsum(c, "turn", "n", ["conv_id"], name="_end").withColumn("offset", F.col("_end") - F.col("n"))
    conv = c.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "words"))),
                                                          lambda x: x["words"])).alias("all_words"))
    a = c.filter(F.col("role") == "assistant").join(conv, "conv_id")
    reset = F.substring(F.md5(F.concat_ws("|", "conv_id", "turn")), 1, 1).isin("0", "1", "2", "3")
    off = F.col("offset").cast("int")
    ob = F.when(reset, F.slice("all_words", 2, F.greatest(off - 1, F.lit(0)))).otherwise(F.slice("all_words", 1, off))
    return materialize(a.select(
        F.substring(F.md5(F.col("conv_id").cast("string")), 1, 1).alias("group_id"),
        F.col("conv_id").alias("traj_id"), F.col("turn").alias("step"), ob.alias("ob"),
        F.col("words").alias("ac"),
        F.transform("words", lambda w: -(F.length(w) % 7).cast("double") / 10).alias("ac_logprobs"),
        ((F.col("n") % 3).cast("double") / 2).alias("reward")), "transitions")


# --------------------------------------------------------------------------
# SQL twins (DuckDB dialect) of the views above, for the oracle queries.
# --------------------------------------------------------------------------

def _responses_sql() -> str:
    def lit(x):
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    cases = []
    for k, tpl in RESPONSE_TEMPLATES.items():
        out, rest = [], tpl
        while rest:
            i = min([x for x in (rest.find("{G}"), rest.find("{C}")) if x >= 0], default=-1)
            if i < 0:
                out.append(lit(rest))
                break
            if i:
                out.append(lit(rest[:i]))
            out.append("g" if rest[i:i + 3] == "{G}" else "format('{:,}', CAST(g AS BIGINT))")
            rest = rest[i + 3:]
        cases.append(f"WHEN c = '{k}' THEN " + " || ".join(out))
    return ("SELECT response_id, g AS gold, CASE " + " ".join(cases) + " END AS response FROM ("
            "SELECT o_orderkey AS response_id, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS g, "
            "substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) AS c FROM orders)")


def _tok(expr: str) -> str:
    return f"list_transform(generate_series(1, CAST(l_quantity AS BIGINT)), lambda i: {expr})"


SQL = {
    "rollouts": f"""
        SELECT l_orderkey AS uid,
               md5(concat_ws('|', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT))) AS sample_key,
               CAST(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS reward,
               l_returnflag = 'R' AS is_correct,
               CAST(l_quantity AS BIGINT) AS resp_len,
               CAST(5 + l_partkey % 20 AS BIGINT) AS prompt_len,
               CASE WHEN l_linestatus = 'F' THEN 'stop' ELSE 'length' END AS stop_reason,
               {_tok("CASE WHEN i = CAST(l_quantity AS BIGINT) AND l_linestatus = 'F' THEN 2 ELSE 3 + (i * 31 + l_partkey) % 997 END")} AS response_ids,
               {_tok("CASE WHEN (i + l_suppkey) % 11 = 0 THEN 0 ELSE 1 END")} AS loss_mask,
               {_tok("-CAST((i * l_suppkey) % 97 AS DOUBLE) / 100")} AS rollout_logprobs,
               {_tok("-CAST((i * l_partkey) % 89 AS DOUBLE) / 100")} AS log_probs,
               {_tok("-CAST((i * (l_partkey + l_suppkey)) % 83 AS DOUBLE) / 100")} AS base_log_probs,
               {_tok("CAST((i * l_linenumber) % 13 AS DOUBLE) / 10")} AS "values",
               o_orderpriority AS data_source,
               row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY md5(concat_ws('|', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)))) - 1 AS sample_idx
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "prompts": """
        SELECT o_orderkey AS prompt_id, o_orderpriority AS data_source,
               'What is the total price of order ' || CAST(o_orderkey AS VARCHAR) || '?' AS question,
               CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS answer,
               o_orderstatus AS status
        FROM orders""",
    "math_labels": """
        SELECT o_orderkey AS id,
               'What is the total price of order ' || CAST(o_orderkey AS VARCHAR) || '?' AS question,
               CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS groundtruth_answer,
               CASE WHEN o_orderstatus = 'F'
                    THEN CAST(CAST(floor(o_totalprice) AS BIGINT) + 1 + o_custkey % 9 AS VARCHAR)
                    ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS incorrect_answer,
               'Add the line totals.' || chr(10) || '#### ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS solution
        FROM orders""",
    "sql_annotations": """
        SELECT o_orderkey AS question_id, c_mktsegment AS db_id,
               'List the orders of customer ' || CAST(o_custkey AS VARCHAR) AS question,
               'priority is ' || o_orderpriority AS evidence,
               CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) IN ('0') THEN '  '
                    ELSE 'SELECT o_orderkey FROM orders WHERE o_custkey = ' || CAST(o_custkey AS VARCHAR) END AS "SQL",
               CASE WHEN o_orderstatus = 'F' THEN 'multiset' WHEN o_orderstatus = 'O' THEN 'set' ELSE 'list' END AS grading_method,
               CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) IN ('1', '2')
                    THEN 'List the orders of customer ' || CAST(o_custkey AS VARCHAR) || ' please'
                    ELSE 'List the orders of customer ' || CAST(o_custkey AS VARCHAR) END AS original_question,
               CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) IN ('3', '4') THEN 'status is ' || o_orderstatus
                    ELSE 'priority is ' || o_orderpriority END AS original_evidence,
               'SELECT o_orderkey FROM orders WHERE o_custkey = ' || CAST(o_custkey AS VARCHAR)
                 || CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) IN ('5') THEN ' LIMIT 5' ELSE '' END AS original_SQL,
               CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) IN ('1', '2', '3', '4', '5') THEN 'annotation error' END AS reason
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "sql_results": """
        WITH li AS (SELECT l_orderkey AS question_id, md5(concat_ws('|', l_linenumber, l_partkey, l_suppkey)) AS h, l_quantity AS q,
                           [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag,
                            CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)] AS vals FROM lineitem),
             lr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY h, q) - 1 AS row_idx,
                           substr(md5(CAST(question_id AS VARCHAR)), 1, 1) AS c FROM li)
        SELECT question_id, 'gold' AS side, row_idx, vals FROM lr
        UNION ALL
        SELECT question_id, 'pred',
               CASE WHEN c = '5' AND row_idx = 0 THEN 1 WHEN c = '5' AND row_idx = 1 THEN 0 ELSE row_idx END,
               CASE WHEN c IN ('2', '3') THEN list_reverse(vals)
                    WHEN c = '4' AND row_idx = 0 THEN [vals[1], vals[2], 'X', vals[4]] ELSE vals END
        FROM lr WHERE NOT (c IN ('0', '1') AND row_idx = 0)
        UNION ALL SELECT question_id, 'pred', 1000, vals FROM lr WHERE c = '6' AND row_idx = 0
        UNION ALL SELECT question_id, 'pred', 1001, ['', '', '', ''] FROM lr WHERE c = '7' AND row_idx = 0
        UNION ALL SELECT -o_orderkey - 1, 'gold', 0, [CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)] FROM orders
        UNION ALL SELECT -o_orderkey - 1, 'pred', 0,
                         [CAST(CAST(floor(o_totalprice) AS BIGINT) + o_custkey % 3000 AS VARCHAR)] FROM orders""",
    "sql_questions": """
        WITH q AS (SELECT o_orderkey AS question_id FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders),
             c AS (SELECT question_id, substr(md5(CAST(question_id AS VARCHAR)), 2, 1) AS c2,
                          substr(md5(CAST(question_id AS VARCHAR)), 3, 1) AS c3,
                          'SELECT * FROM lineitem WHERE l_orderkey = ' || CAST(question_id AS VARCHAR) AS s FROM q)
        SELECT question_id,
               CASE WHEN c2 IN ('0','1','2','3','4','5') THEN 'multiset' WHEN c2 IN ('6','7','8') THEN 'set'
                    WHEN c2 IN ('9','a') THEN 'list' WHEN c2 IN ('b','c') THEN 'subset,>=,1'
                    WHEN c2 = 'd' THEN 'subset,=,2' ELSE 'multiset' END AS grading_method,
               c3 <> '0' AS pred_ok,
               CASE WHEN c3 = '1' THEN '<think>plan</think>' || chr(10) || '<solution>' || s
                    WHEN c3 = '2' THEN '<think>plan</think>' || chr(10) || '<solution><think>again</think>' || s || '</solution>'
                    WHEN c3 = '3' THEN '<think>a</think><sql>SELECT 1</sql><observation>1</observation><solution>' || s || '</solution>'
                    ELSE '<think>plan</think>' || chr(10) || '<solution>' || s || '</solution>' END AS completion
        FROM c""",
    "db_schemas": """
        SELECT db_id, 'CREATE TABLE orders_' || lower(db_id) || ' (o_orderkey INTEGER, o_custkey INTEGER)' AS schema_text
        FROM (SELECT DISTINCT c_mktsegment AS db_id FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')""",
    "responses": _responses_sql(),
    "messages": """
        SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS messages
        FROM conversations GROUP BY conv_id""",
    "transitions": """
        WITH c AS (SELECT conv_id, turn, role, string_split(text, ' ') AS words,
                          CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM conversations),
             o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS "offset" FROM c),
             cv AS (SELECT conv_id, flatten(list(words ORDER BY turn)) AS all_words FROM c GROUP BY conv_id)
        SELECT substr(md5(CAST(conv_id AS VARCHAR)), 1, 1) AS group_id, conv_id AS traj_id, turn AS step,
               CASE WHEN substr(md5(CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3')
                    THEN list_slice(all_words, 2, greatest("offset", 1)) ELSE list_slice(all_words, 1, "offset") END AS ob,
               words AS ac, list_transform(words, lambda w: -CAST(length(w) % 7 AS DOUBLE) / 10) AS ac_logprobs,
               CAST(n % 3 AS DOUBLE) / 2 AS reward
        FROM o JOIN cv USING (conv_id) WHERE role = 'assistant'""",
}

DEPS: dict[str, list[str]] = {}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with CTEs for the named views (dependencies first)."""
    ordered: list[str] = []

    def visit(n):
        for dep in DEPS.get(n, []):
            visit(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered)
    return f"WITH {ctes}\n{body}"

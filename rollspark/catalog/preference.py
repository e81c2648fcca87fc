"""Preference queries
over parts (prompt = brand, response = part name, helpfulness = size) and
conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.catalog.core import R, query
from rollspark.functions.cols import rnd
from rollspark.operators import preference as P
from rollspark.plans.batching import swap_augment
from rollspark.sources.tables import table


def _scored(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("prompt"), F.col("p_name").alias("response"),
                                          F.col("p_size").alias("helpfulness"), F.col("p_partkey").alias("input_order"))


_BW = """
bw AS (SELECT p_brand AS prompt,
              arg_max(p_name, CAST(p_size AS BIGINT) * 1000000000 - p_partkey) AS chosen_response,
              arg_min(p_name, CAST(p_size AS BIGINT) * 1000000000 - p_partkey) AS rejected_response,
              max(p_size) - min(p_size) AS helpfulness_diff, count(*) AS n
       FROM part GROUP BY p_brand HAVING count(*) >= 2 AND max(p_size) > min(p_size))"""


@query("best_worst_pairs", f"WITH {_BW}\nSELECT prompt, chosen_response, rejected_response, helpfulness_diff FROM bw")
def q_best_worst(spark, d):
    return P.best_worst_pairs(_scored(spark, d))


_TOURNAMENT = """
WITH pl AS (SELECT p_brand AS g, p_name AS name, p_size,
                   row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS player FROM part),
ch AS (SELECT *, player // 4 AS chunk FROM pl),
m AS (SELECT a.g, a.player AS i, b.player AS j, sign(length(a.name) - length(b.name)) AS j_reward
      FROM ch a JOIN ch b ON a.g = b.g AND a.chunk = b.chunk AND a.player < b.player),
s AS (SELECT g, i AS player, -j_reward AS r FROM m UNION ALL SELECT g, j, j_reward FROM m),
per AS (SELECT g, player, sum(r) AS wml, count(*) AS cnt FROM s GROUP BY 1, 2)"""


@query("tournament_rewards", _TOURNAMENT + f"""
SELECT ch.g AS group_id, CAST(ch.player AS BIGINT) AS player, CAST(coalesce(cnt, 0) AS BIGINT) AS matchup_count,
       {R("wml / cnt")} AS win_minus_loss,
       {R("wml / cnt + 1.0 * (CASE WHEN p_size > 3 THEN 1.0 ELSE 0.0 END - 1.0)")} AS reward
FROM ch LEFT JOIN per ON ch.g = per.g AND ch.player = per.player""")
def q_tournament(spark, d):
    from rollspark.plans.ordered import ordered_index
    p = table(spark, d, "part").select(F.col("p_brand").alias("group_id"), F.col("p_name").alias("name"),
                                       "p_size", F.col("p_partkey").alias("player_order"))
    pairs = P.tournament_pairs(p, chunk_size=4)
    players = ordered_index(p, "player_order", ["group_id"], name="player")
    names = players.select("group_id", "player", "name")
    m = pairs.join(names.withColumnRenamed("player", "i").withColumnRenamed("name", "name_i"), ["group_id", "i"]) \
        .join(names.withColumnRenamed("player", "j").withColumnRenamed("name", "name_j"), ["group_id", "j"])
    m = m.withColumn("j_reward", P.shorter_preference(F.length("name_i"), F.length("name_j")))
    valid = players.select("group_id", "player", (F.col("p_size") > 3).alias("is_valid"))
    out = P.win_minus_loss(m, valid=valid)
    return out.select("group_id", F.col("player").cast("bigint").alias("player"),
                      F.coalesce(F.col("matchup_count"), F.lit(0)).cast("bigint").alias("matchup_count"),
                      rnd("win_minus_loss").alias("win_minus_loss"), rnd("reward").alias("reward"))


@query("tournament_pairs_both_ways", """
WITH pl AS (SELECT p_brand AS g, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS player FROM part),
ch AS (SELECT *, player // 4 AS chunk FROM pl)
SELECT a.g AS group_id, CAST(a.chunk AS BIGINT) AS chunk, CAST(a.player AS BIGINT) AS i, CAST(b.player AS BIGINT) AS j
FROM ch a JOIN ch b ON a.g = b.g AND a.chunk = b.chunk AND a.player <> b.player""")
def q_pairs_both(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("player_order"))
    return P.tournament_pairs(p, chunk_size=4, both_ways=True)


@query("swap_augment", f"""WITH {_BW}
SELECT prompt, chosen_response AS completion_A, rejected_response AS completion_B, 'A' AS label, false AS swapped FROM bw
UNION ALL
SELECT prompt, rejected_response, chosen_response, 'B', true FROM bw""")
def q_swap(spark, d):
    pairs = P.best_worst_pairs(_scored(spark, d)).select(
        "prompt", F.col("chosen_response").alias("completion_A"), F.col("rejected_response").alias("completion_B"),
        F.lit("A").alias("label"))
    return swap_augment(pairs)


@query("swap_augment_by_coin", """
WITH b AS (SELECT p_partkey, p_name AS a, p_brand AS b, CASE WHEN p_size % 3 = 0 THEN 'Tie' WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS label,
                  substr(md5('0|' || CAST(p_partkey AS VARCHAR)), 1, 1) >= '8' AS flip FROM part)
SELECT p_partkey, CASE WHEN flip THEN b ELSE a END AS completion_A, CASE WHEN flip THEN a ELSE b END AS completion_B,
       CASE WHEN NOT flip OR label = 'Tie' THEN label WHEN label = 'A' THEN 'B' ELSE 'A' END AS label, flip AS swapped FROM b""")
def q_swap_coin(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("completion_A"), F.col("p_brand").alias("completion_B"),
                                       F.when(F.col("p_size") % 3 == 0, "Tie").when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("label"))
    return swap_augment(p, mode="coin", key="p_partkey")


@query("verdict_scores", """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN -1.0 WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM orders""")
def q_verdict(spark, d):
    o = table(spark, d, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", " B\n").otherwise("maybe")
    return o.select(F.col("o_orderkey").alias("id"), P.verdict_score(verdict).alias("score"))


@query("parse_transcripts", """
WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role,
                  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM conversations WHERE role <> 'system')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages,
       md5(string_agg(role || ':' || content, chr(1) ORDER BY turn)) AS messages_md5
FROM m GROUP BY conv_id""")
def q_transcripts(spark, d):
    c = table(spark, d, "conversations").filter(F.col("role") != "system")
    line = F.concat(F.when(F.col("role") == "assistant", "Assistant: ").otherwise("Human: "), F.col("text"))
    t = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))),
                                                          lambda x: x["l"]), "\n").alias("transcript"))
    msgs = t.select("conv_id", P.parse_transcript("transcript").alias("m"))
    return msgs.select("conv_id", F.size("m").cast("bigint").alias("n_messages"),
                       F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])),
                                          "\u0001")).alias("messages_md5"))


@query("comparison_prompts", f"""WITH {_BW}
SELECT prompt, CAST(7 AS BIGINT) AS n_messages,
       md5(prompt || chr(1) || '{P.SEP_A}' || chr(1) || chosen_response || chr(1) || '{P.SEP_B}' || chr(1)
           || rejected_response || chr(1) || '{P.SEP_PREF}' || chr(1) || 'A') AS convo_md5
FROM bw""")
def q_comparison(spark, d):
    pairs = P.best_worst_pairs(_scored(spark, d))
    msg = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    conv = P.comparison_conversation(msg("user", F.col("prompt")), msg("assistant", F.col("chosen_response")),
                                     msg("assistant", F.col("rejected_response")), F.lit("A"))
    return pairs.select("prompt", F.size(conv).cast("bigint").alias("n_messages"),
                        F.md5(F.array_join(F.transform(conv, lambda x: x["content"]), "\u0001")).alias("convo_md5"))


@query("usable_comparisons", """
WITH c AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id)
SELECT conv_id, (CASE WHEN substr(md5(CAST(conv_id AS VARCHAR)), 1, 1) < '8' THEN 'A'
                      WHEN substr(md5(CAST(conv_id AS VARCHAR)), 1, 1) < 'c' THEN 'B' ELSE 'Tie' END) IN ('A', 'B')
                AND n >= 2 AND last_role = 'assistant' AS usable,
       substr(md5(CAST(conv_id AS VARCHAR)), 1, 1) >= '4' AS valid_pair
FROM c""")
def q_usable(spark, d):
    c = table(spark, d, "conversations")
    conv = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    code = F.substring(F.md5(F.col("conv_id").cast("string")), 1, 1)
    winner = F.when(code < "8", "A").when(code < "c", "B").otherwise("Tie")
    # a rejected copy that differs in its last message only, or (a quarter) not at all
    rejected = F.when(code < "4", F.col("m")).otherwise(F.concat(F.slice("m", 1, F.size("m") - 1),
                        F.array(F.struct(F.lit(-1).cast("bigint").alias("turn"), F.lit("assistant").alias("role"),
                                         F.lit("(rejected)").alias("text")))))
    return conv.select("conv_id", P.usable_comparison("m", winner).alias("usable"),
                       P.valid_pair("m", rejected).alias("valid_pair"))


@query("dpo_report", f"""WITH {_BW},
x AS (SELECT -length(chosen_response) / 10.0 - (-length(prompt) / 20.0) AS c,
             -length(rejected_response) / 10.0 - (-helpfulness_diff / 10.0) AS r FROM bw)
SELECT {R("avg(ln(1 + exp(-abs(0.1 * (c - r)))) + greatest(-(0.1 * (c - r)), 0.0))")} AS dpo_loss,
       {R("avg(CASE WHEN c > r THEN 1.0 ELSE 0.0 END)")} AS accuracy, {R("avg(0.1 * (c - r))")} AS margin,
       {R("avg(0.1 * c)")} AS chosen_reward, {R("avg(0.1 * r)")} AS rejected_reward, CAST(count(*) AS BIGINT) AS n_pairs
FROM x""")
def q_dpo(spark, d):
    pairs = P.best_worst_pairs(_scored(spark, d)).select(
        (-F.length("chosen_response") / 10.0).alias("chosen_logprob"),
        (-F.length("rejected_response") / 10.0).alias("rejected_logprob"),
        (-F.length("prompt") / 20.0).alias("chosen_ref_logprob"),
        (-F.col("helpfulness_diff") / 10.0).alias("rejected_ref_logprob"))
    r = P.dpo_report(pairs)
    return r.select(*[rnd(c).alias(c) for c in ("dpo_loss", "accuracy", "margin", "chosen_reward", "rejected_reward")],
                    F.col("n_pairs").cast("bigint").alias("n_pairs"))


@query("rubric_rewards", f"""
WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS a, CAST(o_custkey % 7 AS DOUBLE) + 0.5 AS b,
                  CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE 1.0 END AS fmt FROM orders)
SELECT o_orderkey, {R("(a + b + 0) / 3.0")} AS rubric_score, {R("(a + b + 0) / 3.0 + 0.1 * (fmt - 1)")} AS reward FROM s""")
def q_rubric_rewards(spark, d):
    o = table(spark, d, "orders")
    score = ((F.col("o_orderkey") % 11) / 10).cast("string")
    o = o.select("o_orderkey", (F.col("o_orderstatus") != "P").cast("int").alias("format_ok"), F.array(
        F.concat(F.lit("Good. Score: "), score),
        F.concat(F.lit("<score>"), (F.col("o_custkey") % 7).cast("string"), F.lit(".5</score>")),
        F.lit("no score here")).alias("grader_outputs"))
    o = o.withColumn("extraction_regexes", F.array(F.lit(r"Score: ([0-9.]+)"), F.lit(r"<score>([0-9.]+)</score>"),
                                                   F.lit(r"([0-9]+)")))
    return P.rubric_reward(o).select("o_orderkey", rnd("rubric_score").alias("rubric_score"), rnd("reward").alias("reward"))

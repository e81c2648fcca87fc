"""Grading of SQL result sets held as tables.

Input is a long table ``results(question_id, side, row_idx, vals ARRAY<STRING>)``
with ``side`` in {'gold', 'pred'}; values are already rendered as text (NULL
stands for Python ``None`` and compares as 'None').

One aggregation per question (partial sums, so a large question is combined where
its rows are) gives the counts, the first rows and, for each side, sums of two
independent 64-bit hashes of its rows: sides whose sums differ are different.
Only questions that this does not decide go on: their rows meet keyed by
(question, sorted row), or by (question, position) for ordered results, so no
question's rows are ever gathered into one list and every verdict is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollspark.functions.cols import col, pystrip
from rollspark.plans.ordered import ordered_index
from rollspark.session import materialize as write_once

GOLD, PRED = "gold", "pred"

# Fixed tag strings of the answer format.
SOLUTION_START, SOLUTION_END = "<solution>", "</solution>"


def non_empty_rows(df: DataFrame, vals="vals") -> DataFrame:
    """Drop rows whose every value is NULL or blank."""
    return df.filter(F.exists(col(vals), lambda v: v.isNotNull() & (pystrip(v) != "")))


def row_key(vals="vals") -> Column:
    """Row with its values sorted as text: column order is ignored."""
    return F.array_sort(F.transform(col(vals), lambda v: F.coalesce(v, F.lit("None"))))


def _halves(h: Column) -> list[Column]:
    """The two halves of a 64-bit hash: their sums cannot overflow below 2^31 rows."""
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1))]


_STEP = 10 ** 10  # more than any width


def _shapes(rows: DataFrame) -> DataFrame:
    """Per question: rows of each side, the width of each side's first row, its value if it is the only one (as a
    number), and by how much the sums of the sides' row hashes differ. Numbers alone, so it is a hash aggregate."""
    gold = F.col("side") == GOLD
    sign = F.when(gold, 1).otherwise(-1).cast("bigint")
    rows = rows.select("question_id", "side", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("rows"), "_key").alias("_h2"),
                       F.col("vals")[0].try_cast("double").alias("_first"),
                       # the first row's width: the least (row_idx, width) as one number
                       (F.coalesce("row_idx", F.lit(-(1 << 63))).cast("decimal(20,0)") * F.lit(_STEP).cast("decimal(11,0)")
                        + F.size("vals").cast("decimal(11,0)")).alias("_at"))
    hashes = [*_halves(F.col("_h1")), *_halves(F.col("_h2"))]

    def side(name):
        of = F.col("side") == name
        return [F.pmod(F.min(F.when(of, F.col("_at"))), F.lit(_STEP).cast("decimal(11,0)")).cast("int").alias(f"_w_{name}"),
                F.max(F.when(of, F.col("_first"))).alias(f"_v_{name}")]

    return rows.groupBy("question_id").agg(
        F.count_if(gold).alias("n_gold"), F.count_if(F.col("side") == PRED).alias("n_pred"), *side(GOLD), *side(PRED),
        F.greatest(*[F.abs(F.sum(sign * h)) for h in hashes]).alias("_apart"))


def _undecided(rows: DataFrame, questions: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    return rows.join(questions.filter(F.col("_open").isin(*rules)).select("question_id"), "question_id", "left_semi")


def _by_row(rows: DataFrame) -> DataFrame:
    """Exact verdicts from the counts of each sorted row on both sides. This is J4 (a full outer join of per-side
    row counts) as one aggregation over both sides."""
    k = rows.groupBy("question_id", "_key").agg(
        F.count_if(F.col("side") == GOLD).alias("cg"), F.count_if(F.col("side") == PRED).alias("cp"))
    return k.groupBy("question_id").agg(
        F.bool_and(F.col("cg") == F.col("cp")).alias("multiset_eq"),
        F.bool_and((F.col("cg") > 0) == (F.col("cp") > 0)).alias("set_eq"))


def _by_subset(rows: DataFrame) -> DataFrame:
    """Distinct predicted rows (raw, unsorted) and whether each predicted row, sorted, is a gold row: one grouping by
    sorted row, in which the raw rows of a key are its orders of the same values."""
    raw = rows.groupBy("question_id", "_key", F.when(F.col("side") == PRED, F.col("vals")).alias("_raw")) \
        .agg(F.count_if(F.col("side") == GOLD).alias("cg"))
    k = raw.groupBy("question_id", "_key").agg(F.sum("cg").alias("cg"), F.count("_raw").alias("raws"))
    return k.groupBy("question_id").agg(
        F.bool_and((F.col("raws") == 0) | (F.col("cg") > 0)).alias("pred_in_gold"), F.sum("raws").alias("n_pred_distinct"))


def _by_place(rows: DataFrame) -> DataFrame:
    """Ordered comparison: position among non-empty rows, then equal keys."""
    p = ordered_index(rows, "row_idx", ["question_id", "side"], name="_pos")
    byp = p.groupBy("question_id", "_pos").agg(
        F.min(F.when(F.col("side") == GOLD, F.col("_key"))).alias("_kg"),
        F.min(F.when(F.col("side") == PRED, F.col("_key"))).alias("_kp"))
    return byp.groupBy("question_id").agg(
        F.bool_and(F.coalesce(F.col("_kg") == F.col("_kp"), F.lit(False))).alias("list_eq"))


def grade_results(results: DataFrame, questions: DataFrame, method="grading_method",
                  force_method: str | None = None) -> DataFrame:
    """Verdict per question (U2-U6), reproducing the reference dispatcher:

    empty rows dropped; both empty -> equal; one empty or different first-row
    widths -> not equal; 1x1 results equal within 1% relative to gold (gold 0
    or non-numbers fall through); then by method: 'multiset', 'subset,=,n' /
    'subset,>=,n', 'list', 'set' (tested in that order, by substring).
    ``questions`` has ``question_id`` and the method column.

    The questions with what the first pass says of them are written once as a
    table under the shared ``spark.checkpoint.dir``. The rows are read twice; if
    ``results`` is partitioned by question, as long as none is large, both passes
    leave them where they are.
    """
    rows = non_empty_rows(results).select("question_id", "side", "row_idx", "vals", row_key().alias("_key"))
    m = F.lit(force_method) if force_method else col(method)
    q = questions.select("question_id", m.alias("method")).join(_shapes(rows), "question_id", "left")
    ng, npr = F.coalesce(F.col("n_gold"), F.lit(0)), F.coalesce(F.col("n_pred"), F.lit(0))
    basic = F.when((ng == 0) | (npr == 0), ng == npr).otherwise(F.col("_w_gold") == F.col("_w_pred"))
    g, p = F.col("_v_gold"), F.col("_v_pred")
    one_by_one = (ng == 1) & (npr == 1) & (F.col("_w_gold") == 1) & (F.col("_w_pred") == 1)
    close = F.coalesce(F.abs(F.try_divide(g - p, g)) < F.lit(1e-2), F.lit(False))
    both_empty = (ng == 0) & (npr == 0)
    parts = F.split(F.col("method"), ",")
    q = q.select("question_id", "method", ng.cast("bigint").alias("n_gold"), npr.cast("bigint").alias("n_pred"),
                 F.get(parts, F.lit(1)).alias("_op"), F.try_element_at(parts, F.lit(3)).try_cast("int").alias("_n"),
                 F.when(F.col("method").contains("multiset"), "multiset").when(F.col("method").contains("subset"), "subset")
                 .when(F.col("method").contains("list"), "list").when(F.col("method").contains("set"), "set").otherwise("").alias("_rule"),
                 (~basic).alias("_no"), (one_by_one & close).alias("_yes"), both_empty.alias("_empty"),
                 ((ng != npr) | (F.col("_apart") != 0)).alias("_apart"))
    # what the sums leave open: rules on repeats or order only where all sums agree, a set only where they differ
    same = ~F.col("_empty") & ~F.col("_no") & ~F.col("_yes")
    rule = F.col("_rule")
    opened = F.when(same & rule.isin("multiset", "list") & ~F.col("_apart"), rule) \
        .when(same & rule.isin("set", "subset"), rule)
    q = write_once(q.withColumn("_open", opened), "sql_questions")
    # a rule that no question is left open for has no branch
    left = {r["_open"] for r in q.select("_open").distinct().collect()}
    j = q
    for rules, exact, empty in ((("multiset", "set"), _by_row, "multiset_eq boolean, set_eq boolean"),
                                (("subset",), _by_subset, "pred_in_gold boolean, n_pred_distinct bigint"), (("list",), _by_place, "list_eq boolean")):
        if left & set(rules):
            j = j.join(exact(_undecided(rows, q, rules)), "question_id", "left")
        else:
            j = j.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in empty.split(", ")])
    nd = F.coalesce(F.col("n_pred_distinct"), F.lit(0))
    sub = F.when(F.col("_op") == "=", nd == F.col("_n")).when(F.col("_op") == ">=", nd >= F.col("_n")).otherwise(F.lit(False)) \
        & F.coalesce(F.col("pred_in_gold"), F.lit(True))
    by_method = F.when(rule == "subset", sub).when(rule == "", F.lit(False)).when(F.col("_empty"), F.lit(True)) \
        .when(rule == "multiset", F.col("multiset_eq")).when(rule == "list", F.col("list_eq")).otherwise(F.col("set_eq"))
    verdict = F.when(F.col("_no"), F.lit(False)).when(F.col("_yes"), F.lit(True)).otherwise(by_method)
    return j.select("question_id", "method", "n_gold", "n_pred", F.coalesce(verdict, F.lit(False)).alias("is_correct"))


def solution_format(text) -> Column:
    """Lenient answer format (F10): text after the last '<solution>' must hold
    exactly one '</solution>', and the solution may not contain think / sql /
    observation tags. Returns the stripped SQL, or NULL when the format fails."""
    t = col(text)
    tail = F.substring_index(t, SOLUTION_START, -1)
    one_end = F.regexp_count(tail, F.lit(SOLUTION_END)) == 1
    sol = F.substring_index(tail, SOLUTION_END, 1)
    bad_tag = sol.rlike(r"(?i)</?(think|sql|observation)\b")
    return F.when(one_end & ~bad_tag, pystrip(sol))


def solution_format_strict(text) -> Column:
    """Strict format (F11): exactly one '<solution>', after it exactly one
    '</solution>', no think / sql / observation tag inside, at least one think
    block, and before the solution every '</observation>' followed (after
    blanks) by '<think>'. Returns the stripped SQL or NULL."""
    t = col(text)
    before, tail = F.substring_index(t, SOLUTION_START, 1), F.substring_index(t, SOLUTION_START, -1)
    sol = F.substring_index(tail, SOLUTION_END, 1)
    ok = (F.regexp_count(t, F.lit(SOLUTION_START)) == 1) & (F.regexp_count(tail, F.lit(SOLUTION_END)) == 1) \
        & ~sol.rlike(r"(?i)</?(think|sql|observation)\b") & t.rlike(r"(?s)<think>.*?</think>") \
        & ~before.rlike(r"(?is)</observation>(?!\s*<think>)")
    return F.when(ok, pystrip(sol))


def stops_at_tag(text, tags=("</sql>", "</solution>")) -> Column:
    """Action text is valid (F15): where one of the stop tags occurs, nothing
    follows its first occurrence. Text without a tag is valid."""
    t = col(text)
    ok = F.lit(True)
    for tag in tags:
        at = F.instr(t, tag)
        ok = ok & ((at == 0) | (F.length(t) == at + len(tag) - 1))
    return ok


def sql_reward(graded: DataFrame, completions: DataFrame, status: DataFrame, text="completion") -> DataFrame:
    """-1 for a bad answer format, 0 for an execution error on either side
    or a mismatch, 1 for a match. ``status(question_id, side, ok)``."""
    fmt = completions.select("question_id", solution_format(text).isNull().alias("bad_format"))
    errs = status.groupBy("question_id").agg(F.bool_and("ok").alias("all_ok"))
    j = fmt.join(graded.select("question_id", "is_correct"), "question_id", "left") \
        .join(errs, "question_id", "left")
    reward = F.when(F.col("bad_format"), F.lit(-1.0)) \
        .when(~F.coalesce(F.col("all_ok"), F.lit(True)), F.lit(0.0)) \
        .when(F.coalesce(F.col("is_correct"), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
    return j.select("question_id", reward.alias("reward"))


# Fixed message prefixes of the result preview.
PREVIEW_FULL = "SQL execution results: "
PREVIEW_TRUNCATED = "Truncated to 50 lines since returned response too long: "


def result_preview(results: DataFrame, max_rows: int = 50, sep: str = " ") -> DataFrame:
    """Text preview of each result set (P18): the first ``max_rows`` rows, one
    per line (values joined by ``sep``, NULL as 'None'), behind the reference's
    full / truncated message prefix. Row positions come from
    :func:`ordered_index`, so a huge result set is never sorted in one task;
    only ``max_rows`` rows per set are collected."""
    p = ordered_index(results, "row_idx", ["question_id", "side"], name="_pos")
    head = p.filter(F.col("_pos") < max_rows)
    agg = head.groupBy("question_id", "side").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "vals"))),
                                 lambda s: F.array_join(s["vals"], sep, "None")), "\n").alias("_body"))
    tot = results.groupBy("question_id", "side").agg(F.count(F.lit(1)).alias("n_rows"))
    prefix = F.when(F.col("n_rows") > max_rows, F.lit(PREVIEW_TRUNCATED)).otherwise(F.lit(PREVIEW_FULL))
    return tot.join(agg, ["question_id", "side"]).select(
        "question_id", "side", F.col("n_rows").cast("bigint").alias("n_rows"),
        F.concat(prefix, F.col("_body")).alias("preview"))


def table_text(rows: Column) -> Column:
    """Rows (arrays of text) as an aligned table: a header of column numbers from 0 on, every column right-aligned to
    its widest entry, columns apart by one space, NULL as 'None', line breaks inside a value as '\\n'."""
    told = F.transform(rows, lambda r: F.transform(r, lambda v: F.replace(F.coalesce(v, F.lit("None")), F.lit("\n"), F.lit("\\n"))))
    header = F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda i: i.cast("string"))

    def aligned(x):
        lines = x["lines"]
        widths = F.array(F.transform(lines[0], lambda _, i: F.array_max(F.transform(lines, lambda r: F.length(F.get(r, i))))))
        return F.get(F.transform(widths, lambda w: F.array_join(
            F.transform(lines, lambda r: F.array_join(F.transform(r, lambda v, i: F.lpad(v, F.get(w, i), F.lit(" "))), " ")), "\n")), F.lit(0))

    return F.get(F.transform(F.array(F.struct(F.concat(F.array(header), told).alias("lines"))), aligned), F.lit(0))


def result_text(results: DataFrame, rule: str = "rows", max_rows: int = 50, max_chars: int = 9000) -> DataFrame:
    """Result sets as aligned text.

    rule 'rows': all rows behind the full prefix, or of more than ``max_rows``
    rows the first ones behind the truncated prefix. rule 'chars': the text of
    all rows without a prefix, or where it has more than ``max_chars``
    characters the first ``max_rows`` rows behind the truncated prefix.

    Only rows that can be shown are gathered: a row takes two characters at
    least, so more than ``max_chars`` / 2 rows are too long anyway."""
    if rule not in ("rows", "chars"):
        raise ValueError(f"unknown rule {rule!r}")
    most = max_rows if rule == "rows" else max(max_rows, max_chars // 2)
    p = ordered_index(results, "row_idx", ["question_id", "side"], name="_pos")
    tot = p.groupBy("question_id", "side").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_list(F.when(F.col("_pos") < most, F.struct("_pos", "vals")))).alias("_shown"))
    tot = tot.withColumn("_shown", F.transform("_shown", lambda r: r["vals"]))
    head = table_text(F.slice("_shown", 1, max_rows))
    if rule == "rows":
        text = F.concat(F.when(F.col("n_rows") > max_rows, F.lit(PREVIEW_TRUNCATED)).otherwise(F.lit(PREVIEW_FULL)), head)
    else:
        tot = tot.withColumn("_all", F.when(F.col("n_rows") <= most, table_text(F.col("_shown"))))
        text = F.when(F.length("_all") <= max_chars, F.col("_all")).otherwise(F.concat(F.lit(PREVIEW_TRUNCATED), head))
    return tot.select("question_id", "side", F.col("n_rows").cast("bigint").alias("n_rows"), text.alias("text"))

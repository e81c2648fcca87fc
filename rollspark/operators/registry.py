"""User-extension registries: policy losses (X2), graders per env_class (X3),
preference models (X4), and row functions for dataset building (X5). The advantage estimator
registry (X1) lives with the estimators."""

from __future__ import annotations

import os
import uuid
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollspark.functions import text as T
from rollspark.operators import grade_sql as G
from rollspark.operators import losses as L
from rollspark.session import checkpoint_dir


class Registry:
    """Name -> function, with errors on duplicate and unknown names."""

    def __init__(self, kind: str):
        self.kind, self._fns = kind, {}

    def register(self, name: str, fn: Callable | None = None):
        def deco(f):
            if name in self._fns:
                raise ValueError(f"{self.kind} {name!r} already registered")
            self._fns[name] = f
            return f
        return deco(fn) if fn is not None else deco

    def get(self, name: str) -> Callable:
        try:
            return self._fns[name]
        except KeyError:
            raise ValueError(f"unknown {self.kind} {name!r}; have {sorted(self._fns)}") from None

    def unregister(self, name: str) -> None:
        if name not in self._fns:
            raise ValueError(f"unknown {self.kind} {name!r}")
        del self._fns[name]

    def names(self) -> list[str]:
        return sorted(self._fns)


# ----------------------------------------------------------------- X2
POLICY_LOSSES = Registry("policy loss")
"""name -> fn(log_probs, old_log_probs, advantages, **cfg) -> token loss array column.
A loss named in ``MASKED_LOSSES`` also gets the mask, as ``mask``."""
MASKED_LOSSES = {"gspo"}


def _gspo(lp, old, adv, mask, **k):
    return L.gspo_tokens(adv, L.gspo_seq_ratio(lp, old, mask), **k)[0]


def _tis(lp, old, adv, rollout_log_probs=None, cap=2.0, **k):
    """The clipped surrogate weighted by min(exp(old - rollout), cap); without rollout log-probs the weight is 1."""
    weights = L.tis_weights(old, old if rollout_log_probs is None else rollout_log_probs, cap)
    return F.zip_with(L.ppo_tokens(lp, old, adv, **k)[0], weights, lambda x, w: x * w)


POLICY_LOSSES.register("regular", lambda lp, old, adv, **k: L.ppo_tokens(lp, old, adv, **k)[0])
POLICY_LOSSES.register("dual_clip", lambda lp, old, adv, clip_ratio_c=3.0, **k: L.ppo_tokens(
    lp, old, adv, dual_clip=clip_ratio_c, **k)[0])
POLICY_LOSSES.register("sapo", lambda lp, old, adv, **k: L.sapo_tokens(lp, old, adv, **k))
POLICY_LOSSES.register("reinforce", lambda lp, old, adv, **k: L.reinforce_tokens(lp, adv))
POLICY_LOSSES.register("importance_sampling", lambda lp, old, adv, **k: L.importance_sampling_tokens(lp, old, adv))
POLICY_LOSSES.register("gspo", _gspo)
POLICY_LOSSES.register("tis", _tis)
POLICY_LOSSES.register("cispo", lambda lp, old, adv, clip_low=0.8, clip_high=1.2: L.cispo_tokens(
    lp, old, adv, clip_low, clip_high))
POLICY_LOSSES.register("dro", lambda lp, old, adv, beta=0.05: L.dro_tokens(lp, old, adv, beta))
POLICY_LOSSES.register("cross_entropy", lambda lp, old, adv, **k: L.cross_entropy_tokens(lp, adv))


def _token_loss(name, log_probs, old_log_probs, advantages, mask, cfg):
    more = {"mask": mask} if name in MASKED_LOSSES else {}
    return POLICY_LOSSES.get(name)(log_probs, old_log_probs, advantages, **more, **cfg)


def policy_loss(df: DataFrame, name: str, log_probs: str, old_log_probs: str, advantages: str, mask: str,
                reduction: str = "token_mean", max_seq_len: int | None = None, **cfg) -> DataFrame:
    """Reduced loss of the registered policy loss ``name`` (one-row frame)."""
    tok = _token_loss(name, log_probs, old_log_probs, advantages, mask, cfg)
    return L.reduce_tokens(df, tok, mask, reduction, max_seq_len)


def policy_losses(df: DataFrame, names, log_probs: str, old_log_probs: str, advantages: str, mask: str,
                  **cfg) -> DataFrame:
    """Token-mean loss of several registered policy losses in one pass over
    the token arrays: one row per loss (``loss_name``, ``loss``)."""
    from rollspark.functions.arrays import mask_count, masked_sum
    names = list(names)
    d = df.select(*[masked_sum(_token_loss(n, log_probs, old_log_probs, advantages, mask, cfg), mask)
                    .alias(f"_l{i}") for i, n in enumerate(names)], mask_count(mask).alias("_mc"))
    den = F.greatest(F.sum("_mc"), F.lit(1.0))
    one = d.agg(*[(F.sum(f"_l{i}") / den).alias(f"_l{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(n).alias("loss_name"), F.col(f"_l{i}").alias("loss")) for i, n in enumerate(names)])
    return one.select(F.explode(rows).alias("_x")).select("_x.loss_name", "_x.loss")


# ----------------------------------------------------------------- X3
GRADERS = Registry("grader")
"""env_class -> fn(response column, truth column) -> score column (double)."""

TABLE_GRADERS = Registry("table grader")
"""env_class -> (fn, names of tables); fn(rows, **tables) -> one row per ``question_id`` with ``score``. ``rows`` has
``question_id`` (one row each), ``completion`` and ``truth`` of the class."""

GRADERS.register("math", lambda r, t: F.when(T.answers_equal(T.boxed_answer(T.after_think(r)), F.array(t)), 1.0).otherwise(0.0))
GRADERS.register("gsm8k", lambda r, t: T.gsm8k_score(r, t))
GRADERS.register("aime", lambda r, t: T.minerva_score(r, t)[0])
GRADERS.register("search", lambda r, t: F.coalesce(T.qa_exact_match(T.last_answer_tag(r), F.array(t)).cast("double"),
                                                   F.lit(0.0)))


def _grade_sql_rows(rows: DataFrame, sql_results: DataFrame, sql_status: DataFrame) -> DataFrame:
    """Result sets compared by the method that the truth names (multiset without one), behind format and execution."""
    asked = rows.select("question_id", "completion", F.coalesce("truth", F.lit("multiset")).alias("grading_method"))
    mine = asked.select("question_id")
    graded = G.grade_results(sql_results.join(mine, "question_id", "left_semi"), asked)
    return G.sql_reward(graded, asked, sql_status.join(mine, "question_id", "left_semi")).withColumnRenamed("reward", "score")


def _grade_code_rows(rows: DataFrame, code_results: DataFrame) -> DataFrame:
    """1 where every test of the question has passed and there is one at least, else 0; 0 as well without a code block."""
    ran = code_results.join(rows.select("question_id"), "question_id", "left_semi") \
        .groupBy("question_id").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("all_passed"))
    wrote = F.coalesce(F.col("completion").rlike(r"(?s)```.*?```"), F.lit(False))
    ok = wrote & F.coalesce("all_passed", F.lit(False))
    return rows.join(ran, "question_id", "left").select("question_id", ok.cast("double").alias("score"))


TABLE_GRADERS.register("text2sql", (_grade_sql_rows, ("sql_results", "sql_status")))
TABLE_GRADERS.register("code", (_grade_code_rows, ("code_results",)))


def grade_by_env(df: DataFrame, env_class: str = "env_class", response: str = "response", truth: str = "gold",
                 out: str = "score", key: str | None = None, **tables: DataFrame) -> DataFrame:
    """Grade each row with the grader of its env_class; unknown classes score NULL.

    The rows are written once, partitioned by class, so the input is read once
    and each grader reads its own rows only: column graders as a projection (one
    CASE over every grader would be too large for whole-stage codegen), table
    graders as a join of the rows' ``key`` (unique per row) with the tables given
    as ``tables``. Rows of a table grader's class score NULL without its tables."""
    by_table = [n for n in TABLE_GRADERS.names() if key is not None and set(TABLE_GRADERS.get(n)[1]) <= set(tables)]
    by_column = [n for n in GRADERS.names() if n not in by_table]
    path = os.path.join(checkpoint_dir(df.sparkSession), "graded", uuid.uuid4().hex)
    cls = F.when(F.col(env_class).isin(*by_table, *by_column), F.col(env_class)).otherwise("-")
    df.withColumn("_class", cls).write.partitionBy("_class").parquet(path)
    d = df.sparkSession.read.schema(StructType(list(df.schema.fields)).add("_class", "string")).parquet(path)
    parts = [d.filter(F.col("_class") == "-").withColumn(out, F.lit(None).cast("double"))]
    for n in by_column:
        parts.append(d.filter(F.col("_class") == n).withColumn(out, GRADERS.get(n)(F.col(response), F.col(truth)).cast("double")))
    for n in by_table:
        fn, needs = TABLE_GRADERS.get(n)
        rows = d.filter(F.col("_class") == n)
        asked = rows.select(F.col(key).alias("question_id"), F.col(response).alias("completion"), F.col(truth).alias("truth"))
        scores = fn(asked, **{t: tables[t] for t in needs}).select(F.col("question_id").alias("_q"), F.col("score").cast("double").alias(out))
        parts.append(rows.join(scores, F.col(key) == F.col("_q"), "left").drop("_q"))
    return reduce(lambda a, b: a.unionByName(b), parts).drop("_class")


# ----------------------------------------------------------------- X4
PREFERENCE_MODELS = Registry("preference model")
"""name -> fn(comparisons, **cfg) -> comparisons with ``preference`` (double):
1 prefers B, -1 prefers A, 0 is a tie."""


def _from_scores(df: DataFrame, a: str, b: str, score: Callable) -> DataFrame:
    """The completion with the higher ``score(column)``; NULL when a score is missing."""
    diff = score(F.col(b)).cast("double") - score(F.col(a)).cast("double")
    return df.withColumn("preference", F.signum(diff))


def _from_table(df: DataFrame, keys, verdicts: DataFrame, verdict: str = "preference") -> DataFrame:
    """The verdict a judge has left for the comparison's keys (one row each); NULL without one."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(verdicts.select(*keys, F.col(verdict).cast("double").alias("preference")), keys, "left")


PREFERENCE_MODELS.register("score", _from_scores)
PREFERENCE_MODELS.register("table", _from_table)


def prefer(df: DataFrame, model: str, **cfg) -> DataFrame:
    """Add ``preference`` by the registered preference model ``model``."""
    return PREFERENCE_MODELS.get(model)(df, **cfg)


# ----------------------------------------------------------------- X5

def flat_map_pandas(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Escape hatch: ``fn(pandas.DataFrame) -> pandas.DataFrame`` applied to
    Arrow batches of each partition (any number of output rows per input
    row). Runs in Python workers; use only where columns cannot express it."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)

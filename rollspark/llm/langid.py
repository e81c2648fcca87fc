"""Language identification by rank-order n-gram profiles.

A profile is a list of the most frequent character n-grams (one to three
characters, inside words, blanks marking word ends) ordered by frequency. A
document gets the language whose profile has the smallest out-of-place distance
to the document's own: the sum over the document's n-grams of the difference of
the two ranks, or of the profile's length where the language lacks the n-gram.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollspark.llm.common import forget, lean, table, widened

UNDETERMINED = "und"
WINDOW = 1 << 20  # characters of one text that are counted at a time
MERGE_AT = 1_000_000


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def merged(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    c = np.concatenate(codes)
    order = np.argsort(c, kind="stable")
    c, n = c[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    return c[first], (np.add.reduceat(n, first) if len(c) else n)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the whole text as packed code points (ascending), and their counts."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    let = letters()[a]
    if not let.any():
        return none, none
    keep = let.copy()
    keep[1:] |= let[:-1]  # a run of other characters counts as one blank
    b = np.concatenate([[32], np.where(let, a, 32)[keep].astype(np.int64), [32]])
    if b[-2] == 32:
        b = b[:-1]
    codes, counts = [], []
    for s in range(0, len(b), WINDOW):
        w, n = b[s:s + WINDOW + 2], min(WINDOW, len(b) - s)
        two, three = w[1:n + 1], w[2:n + 2]
        one = w[:n]
        pairs = one[:len(two)] | two << 21
        triples = one[:len(three)] | two[:len(three)] << 21 | three << 42
        found = np.concatenate([one[one != 32], pairs, triples[two[:len(three)] != 32]])
        found.sort()
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        codes.append(found[first])
        counts.append(np.diff(np.concatenate([first, [len(found)]])))
    return (codes[0], counts[0]) if len(codes) == 1 else merged(codes, counts)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = 400,
             max_languages: int = 2000) -> dict[str, list[int]]:
    """Profile per language from all rows with a text and a language.

    Tasks count n-grams over the whole texts and emit one row per (language,
    n-gram); Spark adds them up and keeps the ``size`` most frequent of each
    language. What reaches the driver is ``size`` rows a language; more than
    ``max_languages`` languages raise an error instead of being dropped.
    """
    def count(batches):
        forget()
        held: dict[str, tuple[list, list]] = {}
        rows = 0

        def out():
            for k, (c, n) in held.items():
                codes, counts = merged(c, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())],
                    ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for x, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                codes, counts = ngrams(x.as_py())
                if len(codes):
                    c, n = held.setdefault(k, ([], []))
                    c.append(codes)
                    n.append(counts)
                    rows += len(codes)
                if rows > MERGE_AT:
                    for y, (c, n) in held.items():
                        codes, counts = merged(c, n)
                        held[y] = ([codes], [counts])
                    rows = sum(len(c[0]) for c, _ in held.values())
                    if rows > MERGE_AT // 2:
                        yield from out()
                        rows = 0
        yield from out()

    grams = (labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
             .where("text is not null and lang is not null")
             .mapInArrow(lean(count), "lang string, gram long, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = grams.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).select("lang", "gram", "r").collect()
    out: dict[str, list[int]] = {}
    for x in sorted(rows, key=lambda x: (x["lang"], x["r"])):
        out.setdefault(x["lang"], []).append(x["gram"])
    if len(out) > max_languages:
        raise ValueError(f"{len(out)} languages; max_languages is {max_languages}")
    return out


class Ranks:
    """The profiles as a rank matrix; small, sent with the task."""

    def __init__(self, by_lang: dict[str, list[int]], doc_size: int):
        self.langs = sorted(by_lang)
        self.doc_size = doc_size
        self.absent = max([len(x) for x in by_lang.values()], default=0)
        self.codes = np.unique(np.array(sorted({g for x in by_lang.values() for g in x}), np.int64))
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, k in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, by_lang[k])] = np.arange(len(by_lang[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        mine = ranked(codes, counts, self.doc_size)
        at = np.searchsorted(self.codes, mine)
        at[np.append(self.codes, -1)[at] != mine] = len(self.codes)
        r = self.rank[:, at]
        d = np.where(r < 0, self.absent, np.minimum(np.abs(r - np.arange(len(mine))), self.absent)).sum(axis=1)
        best = int(d.argmin())  # ties: the first language by name
        return self.langs[best], float(1.0 - d[best] / (self.absent * len(mine)))


def identify(docs: DataFrame, by_lang: dict[str, list[int]], text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             doc_size: int = 300, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``keep`` columns of every row with the predicted language and its score.

    The score is one minus the out-of-place distance over its largest value.
    Null texts, texts without a letter and any text when no profile was learned
    get ``und`` and 0. Whole texts are read, very long ones in windows. Only the
    named columns are used, so further columns of any name do not matter;
    ``pred`` and ``score`` name the two new ones.
    """
    ranks = Ranks(by_lang, doc_size)
    src = docs.select(*keep, *([] if text in keep else [text]))
    at = src.columns.index(text)
    schema = widened(docs.select(*keep).schema, **{pred: "string", score: "double"})

    def run(batches):
        forget()
        for batch in batches:
            said = [ranks.predict(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())],
                schema.names)

    return src.mapInArrow(lean(run), schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> dict[str, list[int]]:
    return profiles(docs.where(~held_out()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

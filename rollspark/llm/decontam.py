"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask of token positions of which some are ignored; hashing the
others finds passages that agree there, whatever stands in the ignored places.
Several masks together find passages with replaced words. The steps:

1. A bit table of all seed hashes of the benchmark (a Bloom filter, about
   ``SEED_BITS`` bits a seed, ``MOST_BITS`` at most) goes to every task.
2. One scan of the documents hashes every position under every mask. Positions
   that pass the filter are kept with the token hashes around them, close ones
   in one region.
3. The kept seed hashes are joined with the benchmark's by value; each match
   puts a benchmark item at one place of a document (a diagonal).
4. On each diagonal the tokens are compared one by one and the longest stretch
   with enough equal words is taken, then the longest on either side of it, and
   so on.

The masks leave no gap from 10 words on: whichever places are replaced inside a
stretch of at least 10 words with 80 % the same, some mask fits on equal words
only (a test goes through all patterns).

Whole texts are read. Only regions that share a seed with the benchmark are
shuffled, never the documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollspark.llm.common import kept, lean, table, write_once

#: The masks; 1 takes part, 0 is ignored.
MASKS = ("111111", "1111011", "11001111", "1101000111", "1110100011")
SPAN = max(map(len, MASKS))
#: Size of the filter; at ``MOST_BITS`` it is 32 MB, and a larger benchmark only lets more positions through.
SEED_BITS, LEAST_BITS, MOST_BITS = 128, 1 << 16, 1 << 28
KNOWN_WORDS = 300_000
WORD = re.compile(r"\w+")
ODD = [np.uint64(x) for x in range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + 2 * SPAN, 2)]
EXACT = len(MASKS)  # number of the seed that is a whole short item


class Words(dict):
    """64-bit hashes of words; remembers up to ``KNOWN_WORDS`` of them."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h

    def hashes(self, text: str | None) -> np.ndarray:
        """The hashes of a text's lower-case words, in their order."""
        words = WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_seen() -> Words:
    return kept("decontam words", Words)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def seeds(tokens: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the unmasked tokens at every position where the mask fits, as signed 64 bits."""
    places = [i for i, x in enumerate(MASKS[mask]) if x == "1"]
    n = len(tokens) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, mask + 1, np.uint64)
    for k, p in enumerate(places):
        h += tokens[p:p + n] * ODD[k]
        h ^= h >> np.uint64(32)
    return mixed(h).astype(np.int64)


def whole_seed(tokens: np.ndarray) -> int:
    """One hash of a whole item too short for the masks."""
    return xxhash.xxh64_intdigest(tokens.tobytes(), seed=7) - (1 << 63)


def filter_size(n_seeds: int) -> int:
    """Bits of the filter for so many seeds: a power of two."""
    return min(max(1 << (SEED_BITS * n_seeds - 1).bit_length(), LEAST_BITS), MOST_BITS) if n_seeds else LEAST_BITS


def passed(h: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The positions of the hashes that the filter lets through."""
    u, top = h.astype(np.uint64), np.uint64(8 * len(packed) - 1)
    p = np.arange(len(h))
    for spot in (u & top, (u >> np.uint64(32)) & top):
        at = spot[p].astype(np.int64)
        p = p[(packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
    return p


def benchmark_seeds(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """(seed, item_id, item_pos, tokens): a row for each position and mask of each item.

    Items with fewer words than the shortest mask are held as a whole (they
    match documents that have all their words in a row); items without a word
    match nothing.
    """
    src = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")

    def run(batches):
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = words_seen().hashes(x)
                found = [(h, p) for m in range(len(MASKS)) for p, h in enumerate(seeds(t, m).tolist())]
                if not found and len(t):
                    found = [(whole_seed(t), 0)]
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([h for h, _ in found], pa.int64()), pa.array([i] * n, pa.int64()), pa.array([p for _, p in found], pa.int32()),
                    pa.array([len(t)] * n, pa.int32())], ["seed", "item_id", "item_pos", "item_words"])

    return src.mapInArrow(run, "seed long, item_id long, item_pos int, item_words int")


def item_tokens(items: DataFrame, text: str, item_id: str) -> DataFrame:
    src = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")

    def run(batches):
        for batch in batches:
            t = [words_seen().hashes(x).astype(np.int64).tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.list_(pa.int64()))], ["item_id", "item"])

    return src.mapInArrow(run, "item_id long, item array<long>")


def bit_table(seed_rows: DataFrame) -> bytes:
    """The Bloom filter, packed; Spark ors the bits of each of its words, so what is collected is the filter itself."""
    size = filter_size(seed_rows.count())
    u = F.col("seed")
    spots = F.array(u.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(u, 32).bitwiseAND(F.lit(size - 1)))
    rows = (seed_rows.select(F.explode(spots).alias("bit"))
            .groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))
            .toArrow())
    words = np.zeros(size // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words.astype("<i8").tobytes()


def candidate_regions(docs: DataFrame, filter_bits, short_lengths: list[int], text: str, doc_id: str, radius: int) -> DataFrame:
    """(row, doc_id, mark, start, tokens, seed_pos, seed): stretches of a document around positions that pass the filter.

    ``row`` numbers the input's rows, ids or not; ``mark`` is a hash of the text.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark")).where("text is not null")
    schema = "row long, doc_id long, mark long, start int, tokens array<long>, seed_pos array<int>, seed array<long>"

    def run(batches):
        packed = np.frombuffer(filter_bits.value, np.uint8)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            ids, texts, marks = (batch.column(i).to_pylist() for i in range(3))
            for first in range(0, len(ids), 64):  # a few documents at a time, in one array
                each = [words_seen().hashes(x) for x in texts[first:first + 64]]
                end = np.cumsum([len(t) for t in each])
                every = np.concatenate(each)
                where, what = [], []

                def passing(h, length, end=end, where=where, what=what):
                    p = passed(h, packed)
                    p = p[p + length <= end[np.searchsorted(end, p, "right")]]  # not across two documents
                    where.append(p)
                    what.append(h[p])

                for m in range(len(MASKS)):
                    passing(seeds(every, m), len(MASKS[m]))
                for n in short_lengths:
                    passing(np.array([whole_seed(every[p:p + n]) for p in range(len(every) - n + 1)], np.int64), n)
                where, what = np.concatenate(where), np.concatenate(what)
                if not len(where):
                    continue
                order = np.argsort(where, kind="stable")
                where, what = where[order], what[order]
                doc = np.searchsorted(end, where, "right")
                cuts = np.flatnonzero((np.diff(where) > radius) | (np.diff(doc) > 0)) + 1
                for p, h in zip(np.split(where, cuts), np.split(what, cuts), strict=True):
                    k = int(np.searchsorted(end, p[0], "right"))
                    t, p = each[k], p - (end[k] - len(each[k]))
                    lo, hi = max(0, int(p[0]) - radius), min(len(t), int(p[-1]) + SPAN + radius)
                    for c, v in zip(out, (row + first + k, ids[first + k], marks[first + k], lo, t[lo:hi].astype(np.int64), p.astype(np.int32), h), strict=True):
                        c.append(v)
            row += len(ids)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                                 ["row", "doc_id", "mark", "start", "tokens", "seed_pos", "seed"])

    return src.mapInArrow(lean(run), schema)


def stretches(same: np.ndarray, least: int, min_same: float) -> list[tuple[int, int]]:
    """Start and end of the longest stretch of ``least`` words or more, of which ``min_same`` are the same, and of those beside it.

    Stretches begin and end with an equal word, but for one that is the whole.
    """
    out, rest = [], [(0, len(same))]
    while rest:
        lo, hi = rest.pop()
        at = np.flatnonzero(same[lo:hi]) + lo
        if hi - lo < least or len(at) < min_same * least - 1e-9:
            continue
        n = np.arange(len(at))
        before, after = n - min_same * at, n + 1 - min_same * (at + 1)  # surplus of equal words up to each
        best_after = np.maximum.accumulate(after[::-1])[::-1]  # falls, so the last place with enough is found by search
        last = len(at) - 1 - np.searchsorted(best_after[::-1], before - 1e-9)
        k = int((at[last] - at).argmax())
        s, e = int(at[k]), int(at[last[k]]) + 1
        if e - s >= least:
            out.append((s, e))
            rest += [(lo, s), (e, hi)]
        elif least == len(same):
            out.append((lo, hi))
    return out


def verified(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
             item_id: str = "item_id", min_words: int = 10, min_same: float = 0.8, radius: int = 64) -> DataFrame:
    """The rows of ``overlaps`` with ``mark``, a hash of the document's text."""
    spark = docs.sparkSession
    rows = write_once(benchmark_seeds(items, item_text, item_id), "benchmark_seeds")
    filter_bits = spark.sparkContext.broadcast(bit_table(rows))
    short = sorted(x["item_words"] for x in rows.where(f"item_words < {len(MASKS[0])}").select("item_words").distinct().collect())
    regions = write_once(candidate_regions(docs, filter_bits, short, text, doc_id, radius), "regions")
    hits = regions.select("row", "start", F.explode(F.arrays_zip("seed_pos", "seed")).alias("z")) \
        .select("row", "start", F.col("z.seed_pos").alias("pos"), F.col("z.seed").alias("seed"))
    diagonals = (hits.join(rows.select("seed", "item_id", "item_pos"), "seed")
                 .select("row", "start", "item_id", (F.col("pos") - F.col("item_pos")).alias("at")).distinct())
    placed = (diagonals.join(regions.select("row", "doc_id", "mark", "start", "tokens"), ["row", "start"])
              .join(item_tokens(items, item_text, item_id), "item_id")
              .select("doc_id", "mark", "item_id", "start", "at", "tokens", "item"))

    def verify(batches):
        for b in batches:
            out = ([], [], [], [], [], [], [])
            cols = [b.column(i).to_pylist() for i in range(5)]
            for k, (d, mark, i, start, at) in enumerate(zip(*cols, strict=True)):
                t, item = b.column(5)[k].values.to_numpy(), b.column(6)[k].values.to_numpy()
                lo, hi = max(start, at), min(start + len(t), at + len(item))
                if hi <= lo:
                    continue
                same = t[lo - start:hi - start] == item[lo - at:hi - at]
                for s, e in stretches(same, min(min_words, len(item)), min_same):
                    for c, v in zip(out, (d, mark, i, lo + s, lo + s - at, e - s, int(same[s:e].sum())), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 3, *[pa.int32()] * 4), strict=True)],
                ["doc_id", "mark", "item_id", "doc_start", "item_start", "n_words", "n_same"])

    return placed.mapInArrow(verify, "doc_id long, mark long, item_id long, doc_start int, item_start int, n_words int, n_same int").distinct()


def overlaps(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_same): one row for each verified overlap.

    An overlap is a stretch of an alignment that has at least ``min_words``
    words (or the whole item, where it is shorter) of which ``min_same`` are the
    same: the longest, and all others beside it. Positions count words.
    Alignments are followed up to ``radius`` words beyond the outermost seed
    match of a region. Null and empty texts overlap nothing; null ids have
    their rows like others. Repeated documents each have their rows; repeated
    (doc_id, place, item) rows are one. ``how``: the parameters of ``verified``.
    """
    return verified(docs, items, **how).drop("mark").distinct()


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that overlap an item, whatever their ids; a clean text that shares its id with another stays."""
    found = verified(docs, items, **how).select(F.col("doc_id").alias("__hit"), F.col("mark").alias("__mark")).distinct()
    return docs.join(found, F.col(how.get("doc_id", "doc_id")).eqNullSafe(F.col("__hit")) & (F.xxhash64(how.get("text", "text")) == F.col("__mark")), "left_anti")


def op6_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

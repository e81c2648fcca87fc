"""Periodic runs of words: block convolution at dyadic scales.

A run is a stretch of words with smallest period q, of at least ``LEAST`` words
and two periods, that no neighbouring word extends. Its words that equal the
word q further on form a stretch of q words or more, so it holds a whole
aligned block of every length B with 2B - 1 <= q. The scale B = 2, 4, 8, ...
therefore looks for the periods 2B - 1 to 4B - 2 (B = 2: 1 to 6): the sum of
squared differences of a block against every place of the window that follows,
by number-theoretic transforms in integers, is zero exactly where the block
occurs again. Each such distance is a seed; the stretch around it is extended
word by word, which also settles that it is a run.

Two exact rules save work. A block with a word that does not come again within
the largest distance of its scale has no zero. A block that occurs again inside
a known run of period q <= B does so at a multiple of q, which is that run
again; so such seeds go, and blocks whose whole window lies in the run.

Work is linear in the words but for the blocks that pass these rules, which
cost B log B each. Texts are worked on in groups of about ``GROUP`` bytes; one
text is always whole, so memory follows the longest text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollspark.llm.common import table, widened

#: The least number of words of a run.
LEAST = 12
GROUP = 1 << 20
#: Cells of one transform call (one block at least), so that it stays in the cache.
CELLS = 1 << 16
#: Primes with roots of unity of order 2^30 and 2^27, and their generators: products of two residues fit 64 bits.
PRIMES = ((3221225473, 5), (2013265921, 31))
#: Steps by which all seeds are extended together before the longer ones go on singly.
STEPS = 16


@functools.lru_cache(maxsize=128)
def _powers(prime: int, generator: int, half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    root = pow(generator, (prime - 1) // (2 * half), prime)
    if inverse:
        root = pow(root, prime - 2, prime)
    out = np.ones(half, np.uint64)
    have = 1
    while have < half:
        out[have:2 * have] = out[:have] * np.uint64(pow(root, have, prime)) % np.uint64(prime)
        have *= 2
    return out


def _transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Number-theoretic transform of each row (power-of-two length), in bit-reversed order."""
    p, (m, size) = np.uint64(prime), rows.shape
    half = size // 2
    while half:
        parts = rows.reshape(m, -1, 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1]
        rows = np.empty_like(parts)
        np.remainder(low + high, p, out=rows[:, :, 0])
        np.remainder((low + (p - high)) % p * _powers(prime, generator, half, False), p, out=rows[:, :, 1])
        rows = rows.reshape(m, size)
        half //= 2
    return rows


def _invert(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The inverse of ``_transform``."""
    p, (m, size) = np.uint64(prime), rows.shape
    half = 1
    while half < size:
        parts = rows.reshape(m, -1, 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1] * _powers(prime, generator, half, True) % p
        rows = np.empty_like(parts)
        np.remainder(low + high, p, out=rows[:, :, 0])
        np.remainder(low + (p - high), p, out=rows[:, :, 1])
        rows = rows.reshape(m, size)
        half *= 2
    return rows * np.uint64(pow(size, prime - 2, prime)) % p


def squared_differences(blocks: np.ndarray, windows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of each block against every place of its window.

    A block of B and a window of W numbers (W + B - 1 <= 4B) give W - B + 1 sums.
    """
    (m, b), w = blocks.shape, windows.shape[1]
    p = np.uint64(prime)
    a, t = np.zeros((m, 4 * b), np.uint64), np.zeros((m, 4 * b), np.uint64)
    a[:, :b] = blocks[:, ::-1] % p
    t[:, :w] = windows % p
    both = _invert(_transform(a, prime, generator) * _transform(t, prime, generator) % p, prime, generator)[:, b - 1:w]
    total = np.zeros((m, w + 1), np.uint64)
    np.cumsum(windows * windows, axis=1, out=total[:, 1:])
    squares = (total[:, b:] - total[:, :w - b + 1]) % p + (blocks * blocks).sum(axis=1, keepdims=True) % p
    return (squares + (p - both) + (p - both)) % p


def _zeros(blocks: np.ndarray, windows: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each zero sum of squared differences; with a second prime where one cannot hold the sum."""
    (prime, generator), second = PRIMES
    zero = squared_differences(blocks, windows, prime, generator) == 0
    if blocks.shape[1] * largest * largest >= prime:
        rows = np.flatnonzero(zero.any(axis=1))
        if len(rows):
            zero[rows] &= squared_differences(blocks[rows], windows[rows], *second) == 0
    return np.nonzero(zero)


def _matched(words: np.ndarray, at: int, gap: int, stop: int, step: int) -> int:
    """How many words from ``at`` on (towards ``stop``, by ``step`` 1 or -1) equal the word ``gap`` further on."""
    done, size = 0, 64
    left = (stop - at) * step
    while done < left:
        take = min(size, left - done)
        first = at + done if step > 0 else at - done - take + 1
        same = words[first:first + take] == words[first + gap:first + gap + take]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done += take
        size *= 2
    return left


def _extended(words, begin, end, starts, gaps, b, runs):
    """Adds to ``runs`` the runs around the seeds: (first, last + 1) -> least period."""
    n = len(words)
    need = np.maximum(LEAST - gaps, gaps)
    right, left, alive = np.zeros_like(starts), np.zeros_like(starts), np.arange(len(starts))
    for size, side in ((right, 1), (left, -1)):
        live = alive
        for _ in range(STEPS):
            at = starts[live] + b + size[live] if side > 0 else starts[live] - 1 - size[live]
            ok = (at >= 0) & (at + gaps[live] < n)
            at, live = at[ok], live[ok]
            same = words[at] == words[at + gaps[live]]
            live = live[same]
            size[live] += 1
            if not len(live):
                break
    go = np.flatnonzero((right + left + b >= need) | (right == STEPS) | (left == STEPS))
    go = go[np.lexsort((starts[go], gaps[go]))]
    gap, until = -1, -1
    for s, d in zip(starts[go].tolist(), gaps[go].tolist(), strict=True):
        if d == gap and s < until:
            continue
        first = s - _matched(words, s - 1, d, int(begin[s]) - 1, -1)
        last = s + b + _matched(words, s + b, d, int(end[s]) - d, 1)
        gap, until = d, last
        if last - first + d >= max(LEAST, 2 * d):
            runs[first, last + d] = min(d, runs.get((first, last + d), d))


def find_runs(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of several texts laid end to end: (first word, last + 1, period), by start, then period.

    ``words`` numbers the words of each text from 0 on; ``lengths`` has the words of each text.
    """
    n = len(words)
    if not n:
        return []
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    begin, end = (ends - lengths)[text], ends[text]
    largest = int(words.max())
    # equal words of one text have one key, words of different texts never
    keys = words + begin
    order = np.argsort(keys, kind="stable")
    after = np.full(n, n, np.int64)
    again = keys[order][1:] == keys[order][:-1]
    after[order[:-1][again]] = (order[1:] - order[:-1])[again]
    longest = int(lengths.max())
    runs: dict[tuple[int, int], int] = {}
    covered = np.zeros(n, np.int64)
    b = 2
    while longest >= LEAST and (b == 2 or 2 * b - 1 <= longest // 2):
        low, high = 1 if b == 2 else 2 * b - 1, 4 * b - 2
        for (first, last), q in runs.items():
            if q <= b and (q > b // 2 or b == 4):  # the others are in since an earlier scale
                covered[first:last] = np.maximum(covered[first:last], last)
        starts = np.arange(0, n - b + 1, b)
        reach = after[:len(starts) * b].reshape(-1, b).max(axis=1)
        starts = starts[(reach <= high) & (end[starts] >= starts + b + low) & (covered[starts] < np.minimum(starts + high + b, end[starts]))]
        if len(starts):
            padded = np.concatenate([words, np.zeros(5 * b, np.int64)]).astype(np.uint64)
            width, rows = high - low + b, max(1, CELLS // (4 * b))
            seeds = []
            for i in range(0, len(starts), rows):
                s = starts[i:i + rows]
                row, place = _zeros(padded[s[:, None] + np.arange(b)], padded[s[:, None] + low + np.arange(width)], largest)
                at, gap = s[row], place + low
                inside = (at + gap + b <= end[at]) & (at + gap + b > covered[at])
                seeds.append((at[inside], gap[inside]))
            _extended(keys, begin, end, *(np.concatenate(x) for x in zip(*seeds, strict=True)), b, runs)
        b *= 2
    return sorted((first, last, q) for (first, last), q in runs.items())


def _of_group(texts: list[bytes]) -> tuple[np.ndarray, list, list[bytes]]:
    """Per text its number of words, its runs as (start, length, period), and its text without repeated words."""
    split = [t.split() for t in texts]  # bytes split at exactly 0x20 and 0x09 to 0x0D
    lengths = np.array([len(x) for x in split], np.int64)
    numbered = np.empty(int(lengths.sum()), np.int64)
    at = 0
    for x in split:
        number: dict[bytes, int] = {}
        numbered[at:at + len(x)] = [number.setdefault(w, len(number)) for w in x]
        at += len(x)
    found = find_runs(numbered, lengths)
    ends = np.cumsum(lengths)
    runs: list = [[] for _ in texts]
    gone: dict[int, np.ndarray] = {}
    for first, last, q in found:
        i = int(np.searchsorted(ends, first, side="right"))
        base = int(ends[i] - lengths[i])
        runs[i].append((first - base, last - first, q))
        gone.setdefault(i, np.zeros(len(split[i]), bool))[first - base + q:last - base] = True
    kept = [b" ".join(x) if i not in gone else b" ".join(w for w, g in zip(x, gone[i].tolist(), strict=True) if not g) for i, x in enumerate(split)]
    return lengths, runs, kept


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with ``n_words``, ``runs`` (start, length and period, by start, then period) and ``collapsed``.

    ``collapsed`` is the text, words joined by one space, without the words that
    a run holds after its first period. A null or empty text has no words, no
    runs and an empty ``collapsed``. Rows stay as they are, repeated ones
    included; other columns are not read. Different runs with the same words
    differ in their start or period, so there are no ties.
    """
    src = docs.select(*keep, F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary").alias("__text"))
    schema = widened(src.drop("__text").schema, n_words="long", runs="array<struct<start: long, length: long, period: long>>", collapsed="string")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_binary(texts.type) else np.int64, len(texts) + 1, texts.offset * (4 if pa.types.is_binary(texts.type) else 8)))
            group = np.cumsum(sizes) // GROUP
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                lengths, runs, kept = _of_group(texts.slice(a, z - a).to_pylist())
                flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUNS.value_type))
                cols = [batch.column(i).slice(a, z - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(kept, pa.binary()).cast(pa.string())],
                    schema.names)

    return src.mapInArrow(run, schema)


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text in which every tenth document, by the checksum of its id, repeats a part of itself up to its end.

    With h = crc32 of the decimal id and g = h div 10: if 10 divides h, every
    word from a = g mod n on becomes word a + (i - a) mod p, where
    p = 1 + (n - a) div (3 + g mod 8). Without an id the text stays.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.struct(words.alias("w"), F.expr(f"crc32(cast({doc_id} as string)) div 10").alias("g"))

    def repeated(x):
        w, g = x["w"], x["g"]
        n = F.size(w).cast("long")
        a = F.struct(w.alias("w"), (g % n).alias("a"), (F.lit(3) + g % 8).alias("by"))

        def placed(y):
            p = F.lit(1) + F.floor((F.size(y["w"]) - y["a"]) / y["by"])
            return F.array_join(F.transform(y["w"], lambda word, i: F.when(i < y["a"], word).otherwise(F.get(y["w"], (y["a"] + (i - y["a"]) % p).cast("int")))), " ")

        return F.when(n == 0, F.lit("")).otherwise(F.get(F.transform(F.array(a), placed), F.lit(0)))

    return F.when(h % 10 == 0, F.get(F.transform(F.array(part), repeated), F.lit(0))).otherwise(F.col(text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), planted())
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

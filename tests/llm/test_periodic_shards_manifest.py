"""Periodic runs, shards and the Merkle manifest: brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollspark.llm import manifest as M
from rollspark.llm import periodic as P
from rollspark.llm import shards as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


# periodic runs


def brute_runs(words, least=12):
    """Every stretch that keeps a period to both sides, with its smallest period."""
    n, found = len(words), {}
    for d in range(1, n // 2 + 1):
        i = 0
        while i < n - d:
            if words[i] != words[i + d]:
                i += 1
                continue
            j = i
            while j < n - d and words[j] == words[j + d]:
                j += 1
            if j - i + d >= max(least, 2 * d):
                found.setdefault((i, j + d), d)  # smallest d first
            i = j
    return sorted((a, z - a, q) for (a, z), q in found.items())


def library_runs(texts):
    lengths = np.array([len(t) for t in texts])
    flat = np.array([w for t in texts for w in t], np.int64)
    ends, out = np.cumsum(lengths), [[] for _ in texts]
    for first, last, q in P.find_runs(flat, lengths):
        i = int(np.searchsorted(ends, first, side="right"))
        base = int(ends[i] - lengths[i])
        out[i].append((first - base, last - first, q))
    return out


def sample_texts(rng):
    texts = [[], [0], [0] * 11, [0] * 12, [0, 1] * 6, [0, 1] * 5 + [0], [0] * 100]
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    texts.append(b)  # a Fibonacci word: runs of many periods, nested and overlapping
    for size in (30, 60, 200, 500):
        for letters in (1, 2, 3, 5, 50):
            texts.append([rng.randrange(letters) for _ in range(size)])
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, size // 2))]
            again = [rng.randrange(99) for _ in range(rng.randrange(9))] + (part * size)[:size] + [rng.randrange(99) for _ in range(rng.randrange(9))]
            texts.append(again)
            odd = list(again)
            odd[rng.randrange(len(odd))] = 77
            texts.append(odd)
            inner = ([5] * rng.randrange(1, 20) + part) * rng.randrange(2, 5)
            texts.append(inner)
    number = lambda t: [x for x in map({w: i for i, w in enumerate(dict.fromkeys(t))}.get, t)]
    return [number(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_brute_force(seed):
    texts = sample_texts(random.Random(seed))
    assert library_runs(texts) == [brute_runs(t) for t in texts]


def test_squared_differences_are_exact_and_second_prime_decides():
    rng = np.random.default_rng(1)
    blocks, windows = rng.integers(0, 1 << 20, (5, 16)).astype(np.uint64), rng.integers(0, 1 << 20, (5, 46)).astype(np.uint64)
    for prime, generator in P.PRIMES:
        got = P.squared_differences(blocks, windows, prime, generator)
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, w[i:i + 16], strict=True)) % prime for i in range(31)] for a, w in zip(blocks, windows, strict=True)]
        assert got.tolist() == want
    windows[3, 7:23] = blocks[3]
    assert [x.tolist() for x in P._zeros(blocks, windows, 1 << 20)] == [[3], [7]]
    # differences whose squares sum to a multiple of the first prime: 3221225473 = 14432^2 + 54897^2
    prime = P.PRIMES[0][0]
    a, b = next((x, int((prime - x * x) ** 0.5)) for x in range(1, 60000) if int((prime - x * x) ** 0.5) ** 2 == prime - x * x)
    block, window = np.zeros((1, 2), np.uint64), np.array([[a, b, 9]], np.uint64)
    assert P.squared_differences(block, window, *P.PRIMES[0])[0, 0] == 0
    assert P._zeros(block, window, max(a, b))[0].tolist() == []


def test_long_texts_stay_fast_and_whole():
    rng = random.Random(3)
    part = [rng.randrange(500) for _ in range(7001)]
    text = [500, 501] + part * 30 + [502]
    assert library_runs([text]) == [[(2, 7001 * 30, 7001)]] or (2, 7001 * 30, 7001) in library_runs([text])[0]
    assert library_runs([[0] * 300_000, [0] * 200_000 + [1], [0, 1, 2] * 50_000 + [3]]) == [[(0, 300_000, 1)], [(0, 200_000, 1)], [(0, 150_000, 3)]]


def expected_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and crc(doc_id) % 10 == 0 and n:
        g = crc(doc_id) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{a},{length},{q}\n" for a, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_rows(spark, sf_dir, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()][:120]
    tens = [i for i in range(10_000, 11_000) if crc(i) % 10 == 0]
    made = [(None, None), (None, "x " * 30), (1, ""), (1, ""), (tens[0], None), (tens[1], ""), (tens[2], " \t\n\x0b\x0c\r "), (tens[3], "one"), (tens[4], "a b c\x1cd " * 40),
            (tens[5], "é ü 漢字 " * 50), (2, "w " * 100_000), (tens[6], " ".join(str(i % 9 * i) for i in range(3000)))]
    spark.createDataFrame(rows + made, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in P.op11_periodic_runs(spark, str(tmp_path)).collect())
    made[-2] = (2, "w " * 300)  # the brute force takes the square; the long one is put in by hand
    want = Counter(expected_row(*r) for r in rows + made)
    short = next(r for r in want if r[0] == 2 and r[3] == 300)
    want[short] -= 1
    want[(2, 1, 0, 100_000, 1, 100_000_000, hashlib.sha256(b"0,100000,1\n").hexdigest(), short[7])] += 1
    assert got == +want


def test_op11_empty_table(spark):
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# shards


def brute_shards(rows, shards=8):
    """doc_id, size, crc32, shard and slot by whole sorts."""
    by = defaultdict(list)
    for doc_id, source, text in rows:
        t = (text or "").encode()
        dealt = hashlib.md5(f"{S.SEED}|{'-' if doc_id is None else doc_id}|{hashlib.md5(t).hexdigest()}".encode()).hexdigest()
        by["" if source is None else f"={source}"].append((dealt, -1 if doc_id is None else doc_id, len(t) + 1, zlib.crc32(t)))
    line = sorted((Fraction(2 * r + 1, 2 * len(x)), s.encode(), r, row) for s, x in by.items() for r, row in enumerate(sorted(x)))
    n, out = len(line), []
    for pos, (_, _, _, (_, doc_id, size, c)) in enumerate(line):
        k = pos * shards // n
        out.append((None if doc_id == -1 else doc_id, size, c, k, pos - -(-k * n // shards)))
    return Counter(out)


def test_shards_are_those_of_whole_sorts(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", None, "", "漢"]) if rng.random() < 0.6 else "hot", rng.choice([None, "", "same", f"é{i}"])) for i in range(5000)]
    rows += [(7, "hot", "copy")] * 2500 + [(None, "hot", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("rank", F.lit(1)).withColumn("range", F.lit("x"))
    out = S.stratified_shards(df)
    assert Counter(tuple(r) for r in out.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == brute_shards(rows)
    counts = {(r["shard"], r["stratum"]): r["count"] for r in out.groupBy("shard", "stratum").count().collect()}
    sizes = Counter(r[1] for r in rows)
    for (_, s), c in counts.items():
        assert abs(c - sizes[s] / 8) <= 7


@pytest.mark.parametrize("n", [0, 1, 3, 8, 9])
def test_few_rows(spark, n):
    rows = [(i, "s", "t") for i in range(n)]
    out = S.stratified_shards(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert Counter(tuple(r) for r in out.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == brute_shards(rows)


def test_more_ranges_than_one_task_changes_nothing(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", f"t{i % 50}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    monkeypatch.setattr(S, "RANGE_ROWS", 7)
    assert Counter(tuple(r) for r in S.stratified_shards(df, 5).select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == brute_shards(rows, 5)


# manifest


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest("".join(map(told, r)))
    trees = defaultdict(list)
    for r in rows:
        trees["" if r[2] is None else f"={r[2]}"].append(r)

    def build(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            other = level[i ^ 1] if i ^ 1 < len(level) else ""
            out.append(("", other) if i % 2 == 0 else (other, ""))
            i //= 2
        return out

    order = sorted(trees, key=str.encode)
    built = {t: build([d for _, d, _ in sorted(((r[0] is not None, r[0] or 0), leaf(r), i) for i, r in enumerate(trees[t]))]) for t in order}
    whole = build([built[t][-1][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for i, (_, d, j) in enumerate(sorted(((r[0] is not None, r[0] or 0), leaf(r), i) for i, r in enumerate(trees[t]))):
            r = trees[t][j]
            steps = path(built[t], i) + path(whole, k)
            changed = r[0] is not None and crc(r[0]) % 7 == 0 and r[3] is not None
            own = leaf((*r[:3], r[3] + 1, r[4])) if changed else d
            for a, b in steps:
                own = digest(a + own + b)
            out.append((r[0], d, built[t][-1][0], whole[-1][0], digest("".join(a + b for a, b in steps)), own, own == whole[-1][0]))
    return Counter(out)


def manifest_rows(n, seed=1):
    rng = random.Random(seed)
    rows = [(i * 3 - 40, rng.choice(["s", None]), rng.choice(["en", "en", "fr", "", "zh-漢"]), rng.choice([None, 5, i]), rng.choice([None, "", f"te+xt,{i}", "é"])) for i in range(n)]
    return rows + [(None, None, None, None, None)] * 2 + [(8, "s", "en", 3, "again")] * 5 + [(8, "s", "one", 1 << 62, "é")]


def written(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumn("idx", F.lit(1)).withColumn("tree", F.lit("t")).withColumn("above", F.lit(0)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("n", "band"), [(0, 10), (1, 10), (150, 1), (150, 3), (1500, 10), (1500, 4)])
def test_manifest_is_that_of_whole_trees(spark, tmp_path, monkeypatch, n, band):
    monkeypatch.setattr(M.merkle_manifest, "__defaults__", (*M.merkle_manifest.__defaults__[:-1], band))
    rows = manifest_rows(n) if n else manifest_rows(0)[:2]
    got = Counter(tuple(r) for r in M.op13_merkle_manifest(spark, written(spark, tmp_path, rows)).collect())
    want = brute_manifest(rows)
    assert got == want
    assert any(not r[-1] for r in got) == any(r[0] is not None and crc(r[0]) % 7 == 0 and r[3] is not None for r in rows)


def test_manifest_of_nothing(spark, tmp_path):
    assert M.op13_merkle_manifest(spark, written(spark, tmp_path, manifest_rows(0)[:0])).collect() == []


def test_sweeps_agree_with_recursion():
    for n in (1, 2, 3, 7, 8, 9, 1024):
        leaves = [digest(str(i)) for i in range(n)]
        levels = (n - 1).bit_length()
        top, sent = M.sweep_up(leaves, levels)
        level = leaves
        while len(level) > 1:
            level = [digest("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
        assert top == level[0]
        for leaf, proof in zip(leaves, M.sweep_down(sent, levels, "", n), strict=True):
            own = leaf
            for step in proof.split(",") if proof else []:
                own = digest(step.replace("+", own))
            assert own == top

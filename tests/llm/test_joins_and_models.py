"""Nearest neighbours, decontamination, Jaccard join, components, language model, pipeline: brute force and edge cases."""

from __future__ import annotations

import math
import os
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollspark.llm import ann, decontam, jaccard_trie, mixing_lm
from rollspark.llm.components import components


def test_visited_cells_come_in_order():
    rng = np.random.default_rng(0)
    u, w, held = rng.normal(size=6), rng.normal(size=5), rng.integers(0, 3, (6, 5))
    want = sorted(((i, j) for i in range(6) for j in range(5) if held[i, j]), key=lambda c: -u[c[0]] - w[c[1]])
    assert ann.visited(u, w, held, held.sum()) == want
    assert sum(held[c] for c in ann.visited(u, w, held, 4)) >= 4


def test_search_with_ties_nulls_and_full_visit(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x[40:80] = x[40]  # one common vector
    rows = [(i, [float(v) for v in x[i]], "extra") for i in range(120)]
    bad = [(200, None, ""), (220, [0.0] * 8, ""), (240, [float("nan")] * 8, ""), (260, [None] + [1.0] * 7, ""), (280, [1.0], ""), (None, [1.0] * 8, "")]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<float>, score string")
    got = ann.search(df, df.where("vec_id % 20 = 0").dropDuplicates(["vec_id"]), k=7, visit=1.0).toPandas()
    y = x.astype(np.float64)
    assert set(got.query_id) == set(range(0, 120, 20))
    for q, g in got.groupby("query_id"):
        s = {i: float((y[i] * y[q]).sum()) for i in range(120) if i != q}
        ids = [i for i in s for _ in range(2 if i == 0 else 1)]
        want = sorted(ids, key=lambda i: (-s[i], i))[:7]
        g = g.sort_values("rank")
        assert g.vec_id.tolist() == want and np.allclose(g.score, [s[i] for i in want], rtol=0, atol=1e-12)
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id < 3"), df.where("vec_id = 0").limit(1), k=20).count() == 2


def test_recall(spark, sf_dir):
    got = ann.op3_inverted_multi_index(spark, sf_dir).toPandas()
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(np.float64), e.vec_id.to_numpy()
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        want = set(ids[np.lexsort((ids, -s))[:20]])
        hit, total = hit + len(want & set(got[got.query_id == ids[q]].vec_id)), total + len(want)
    assert hit / total >= 0.9


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def test_overlaps_tolerate_substitutions_and_leave_clean_texts(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (14, 25, 40, 59, 3)]
    docs, want = [], {}
    for k, item in enumerate(items):
        w = item.split()
        for every in (0, 11, 7):
            swapped = [x if not every or (i + 1) % every else "changed" for i, x in enumerate(w)]
            want[len(docs)] = k
            docs.append(f"{prose(rng, 30)} {', '.join(swapped).upper()}. {prose(rng, 50)}")
    n = len(docs)
    docs += [prose(rng, 300) for _ in range(30)] + ["", None, "one", "w " * 3000, docs[0]]
    d = spark.createDataFrame([(i, x, "e") for i, x in enumerate(docs)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, x) for i, x in enumerate([*items, "", None])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.overlaps(d, b).collect()}
    for i, k in want.items():
        assert (i, k) in got, (i, k)
    assert {i for i, _ in got} <= {*range(n), len(docs) - 1} and (len(docs) - 1, 0) in got
    r = got[(0, 0)]
    assert (r["doc_start"], r["item_start"], r["n_words"], r["n_same"]) == (30, 0, 14, 14)
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns and kept.count() == len(docs) - len({i for i, _ in got})
    assert decontam.overlaps(d.limit(0), b).count() == 0 and decontam.overlaps(d, b.limit(0)).count() == 0


def test_overlaps_near_the_limits_and_all_on_a_diagonal(spark):
    rng = random.Random(5)
    item = [f"i{k}" for k in range(60)]
    other = lambda n: [f"d{rng.randrange(10**9)}" for _ in range(n)]
    texts = {0: item[:8] + other(1) + item[9:10], 1: item[:9] + other(1) + item[10:11], 2: item[:12] + other(25) + item[37:52], 3: item[:9]}
    d = spark.createDataFrame([(i, " ".join(other(5) + x + other(5))) for i, x in texts.items()], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.overlaps(d, b).collect())
    assert got == [(0, 7, 5, 0, 10, 9), (1, 7, 5, 0, 11, 10), (2, 7, 5, 0, 12, 12), (2, 7, 42, 37, 15, 15)]


def replaced_places(n):
    """Every choice of replaced places inside n words that leaves 80 % the same and both ends."""
    for r in range(n - -(-4 * n // 5) + 1):
        yield from itertools.combinations(range(1, n - 1), r)


def test_masks_leave_no_pattern_out():
    for n in range(10, 25):
        fits = [sum(1 << (s + i) for i, x in enumerate(m) if x == "1") for m in decontam.MASKS for s in range(n - len(m) + 1)]
        for gone in replaced_places(n):
            bad = sum(1 << i for i in gone)
            assert any(not bad & f for f in fits), (n, gone)


def test_every_overlap_at_the_limit_is_found(spark):
    """All ways to replace two of ten and eleven words or three of fifteen, and a very long text."""
    rng = random.Random(8)
    word = lambda: f"d{rng.randrange(10**9)}"
    rows, items, want = [], [], set()
    for n in (10, 11, 15):
        for gone in replaced_places(n):
            item = [word() for _ in range(n)]
            i = len(rows)
            items.append((i, " ".join(item)))
            rows.append((i, " ".join([word(), *[word() if k in gone else x for k, x in enumerate(item)], word()])))
            want.add((i, i, 1, n, n - len(gone)))
    long = [word() for _ in range(60_000)]
    items.append((len(rows), " ".join(long[59_980:])))
    rows.append((len(rows), " ".join(long)))
    want.add((len(rows) - 1, len(rows) - 1, 59_980, 20, 20))
    got = decontam.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.select("doc_id", "item_id", "doc_start", "n_words", "n_same").collect()} == want


def test_filter_grows_with_the_seeds_up_to_its_bound():
    assert [decontam.filter_size(n) for n in (0, 1, 512, 513, 10**12)] == [1 << 16, 1 << 16, 1 << 16, 1 << 17, 1 << 28]


def test_stretches_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.3, 0.8, 0.9])
        got = decontam.stretches(same, 10, 0.8)
        fit = [e - s for s in range(len(same)) for e in range(s + 10, len(same) + 1) if same[s] and same[e - 1] and same[s:e].sum() >= 0.8 * (e - s) - 1e-9]
        if len(same) > 10:
            assert max((e - s for s, e in got), default=0) == max(fit, default=0)
        assert all(a[1] <= b[0] for a, b in zip(sorted(got), sorted(got)[1:], strict=False))


def test_null_and_shared_ids_are_told_apart(spark, sf_dir):
    import corpus_pipeline
    rng = random.Random(6)
    item, a, b = prose(rng, 30), prose(rng, 40), prose(rng, 40)
    rows = [(None, f"{a} {item}"), (None, a), (4, f"{b} {item}"), (4, b)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {tuple(r) for r in decontam.clean(d, items).collect()} == {(None, a), (4, b)}
    copies = [(1, a), (2, a), (2, b), (None, a), (None, f"{a} x"), (None, item), (None, item), (None, None), (None, None)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(copies, "doc_id long, text string"), sf_dir)
    assert Counter(tuple(r) for r in kept.collect()) == Counter([(1, a), (2, b), (None, item), (None, None), (None, None)])


def brute(texts, n, percent):
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 2000), (5, 80, 7)])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard_trie, "BLOCK", block)
    rng = random.Random(n)
    line = prose(rng, 12)
    texts = [None, "", " \t", "a b", "A B", "a b", "x " * 500]
    for _ in range(25):
        base = prose(rng, rng.choice([3, 8, 40, 120])).split()
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
            texts.append(" ".join(w) + (f"\n{line}" if rng.random() < 0.4 else ""))
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, n int")
    got = sorted(tuple(r) for r in jaccard_trie.linked_components(df, n=n, percent=percent).collect())
    assert got == brute(texts, n, percent)
    assert jaccard_trie.linked_components(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None)], "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard_trie.linked_components(odd).collect()) == Counter([(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 0, None)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_model_counts_and_gain(spark, sf_dir):
    """Counts are exact; on a thousand documents the score beats the base, which gives unknown words a share without spelling them."""
    sf_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    got = mixing_lm.op10_context_mixing(spark, sf_dir).toPandas().set_index("doc_id")
    count: Counter = Counter()
    tokens = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        tokens[r["doc_id"]] = [*(r["text"] or "").encode().lower().split(), None]
        if zlib.crc32(str(r["doc_id"]).encode()) % 10:
            count.update(tokens[r["doc_id"]])
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got.loc[i]
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(t), sum(count[x] > 0 for x in t))
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_spelling_is_a_distribution():
    """The bits of every byte string of a length, ended or not, add up to one."""
    words = [b"abc", b"abd", b"b"]
    spelt = mixing_lm.Spelling(words)
    zeros, ones = np.zeros((len(mixing_lm.ORDERS), mixing_lm.SLOTS)), np.zeros((len(mixing_lm.ORDERS), mixing_lm.SLOTS))
    for bit, slots in spelt.bits():
        for k, at in enumerate(slots):
            np.add.at(zeros[k], at, bit == 0)
            np.add.at(ones[k], at, bit == 1)
    s = mixing_lm.Speller(zeros, ones)
    s.tune(words, np.ones(3))
    every = [bytes([i]) for i in range(256) if i != 10]
    first = sum(10 ** x for x in s.log10([b""]))  # the end at once
    one = 10 ** s.log10(every)
    assert first + one.sum() <= 1 + 1e-9 and (one > 0).all()


def test_language_model_edges(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "A a b", 3.0), (3, "A a b", 3.0), (None, "b", 1.0), (5, "new words", 1.0)], "doc_id long, text string, score double")
    got = sorted(tuple(r)[:5] for r in mixing_lm.scores(df.where("doc_id is not null"), held_out=F.col("doc_id") == 5).collect())
    assert got == [(1, False, 1, 1, 10), (2, False, 1, 1, 10), (3, False, 4, 4, 10), (3, False, 4, 4, 10), (5, True, 3, 1, 10)]
    assert mixing_lm.scores(df, held_out=F.lit(True)).where("n_known > 0 or train_tokens > 0 or isnan(score)").count() == 0
    assert mixing_lm.scores(df.limit(0)).count() == 0


@pytest.mark.parametrize("blank", [False, True])
def test_kinds_are_found_on_a_bounded_sample_whatever_the_ids(spark, monkeypatch, blank):
    """A null or a repeated id with half of the rows neither floods the driver nor fills the sample."""
    monkeypatch.setattr(mixing_lm, "SAMPLE", 60)
    text = F.when(F.lit(blank) & (F.col("id") % 2 == 0), F.lit(None)).otherwise(F.concat(F.lit("w"), F.col("id").cast("string")))
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 1, F.col("id")).alias("doc_id"), text.alias("text"))
    hot = df.withColumn("doc_id", F.coalesce("doc_id", F.lit(-7).cast("long")))
    got, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: got.append(collect(self)) or got[-1])
    for d in (df, hot):
        mixing_lm.kinds(d, 3000)
        odd = {int(r) for r in np.array([mixing_lm.features([b"w%d" % i])[0] for i in range(1, 3000, 2)])}
        rows = [int(np.frombuffer(r["f"], np.float32).argmax()) for r in got.pop()]
        assert 30 <= len(rows) <= 60 and sum(r in odd for r in rows) >= 20


def test_pipeline_stages_keep_columns_and_survive_odd_rows(spark, sf_dir, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, None, "x"), (10**9 + 1, "", "en", "s", 0, "x"), (None, "the cat sat with the dog", "en", None, 1, "x"),
                                 (10**9 + 2, "mail ab.72@mail0.example.com and the cat on the mat", None, "s", 1, "x")],
                                "doc_id long, text string, lang string, source string, n_chars long, score string")
    both = docs.withColumn("score", F.lit("x")).union(odd).union(docs.withColumn("score", F.lit("x")).limit(3))
    spark_docs = both
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{i}"
        stage(spark, spark_docs, sf_dir).write.parquet(path)
        spark_docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert spark_docs.columns == both.columns
        if i == 1:
            ids = [r["doc_id"] for r in spark_docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and None in ids
    assert spark_docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_kinds_and_weights_are_learned_from_all_training_rows(spark, monkeypatch):
    """Documents and words that the sample for the start does not hold change the kinds and the weights."""
    monkeypatch.setattr(mixing_lm, "SAMPLE", 40)
    # six vocabularies of 30 words; every document of a vocabulary holds 20 of its words
    v, i = F.col("id") % 6, F.floor(F.col("id") / 6)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("v"), v.cast("string"), F.lit("w"), ((i * 7 + k) % 30).cast("string"))), " ")
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 10 == 0).alias("held"))
    enc = docs.sparkSession.createDataFrame(mixing_lm.chunks(docs.repartition(3, "doc_id")).toPandas(), mixing_lm.chunks(docs).schema)
    start = mixing_lm.kinds(docs.where("not held"), 1200)
    log_p = mixing_lm.settled(enc, start)
    got = mixing_lm.counted(enc, log_p).toPandas()
    total = sum(sum(np.sum(x) for x in got[f"t{z}"]) for z in range(mixing_lm.CLASSES))
    assert total == 1080 * 20
    again = mixing_lm.settled(enc.repartition(1), start)
    assert np.allclose(log_p, again, atol=1e-12)
    # a kind's probability of a word is that of all its documents, not of the 40
    f = [mixing_lm.features([b"v0w%d" % k])[0] for k in range(30)]
    best = log_p[:, f].sum(axis=1).argmax()
    assert np.ptp(log_p[best, f]) < 0.5
    rows = [(b"v%dw%d" % (a, k), 1 + a) for a in range(6) for k in range(400)]
    words = spark.createDataFrame([(bytearray(w), c) for w, c in rows], "word binary, c long")
    speller = mixing_lm.Speller(*mixing_lm.context_tables(words, len(rows)))
    monkeypatch.setattr(mixing_lm, "TUNE_WORDS", 1000)
    seen = []
    monkeypatch.setattr(type(words), "collect", lambda self, real=type(words).collect: seen.append(real(self)) or seen[-1])
    weights = mixing_lm.tuned(words, speller, len(rows))
    assert sum(r["n"] for r in seen[-1]) == len(rows) and len(seen[-1]) == 3 and not np.allclose(weights, speller.weights)

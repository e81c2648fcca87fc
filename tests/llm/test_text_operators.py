"""Language ID, token counts, packing, HTML text: brute force and edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rollspark.llm import common, html_text, langid, packing, token_counts

ODD = ["", " ", "  a  b ", "<|endoftext|>", "x<|ENDOFTEXT|>y <|startoftext|> z", "ΣΑΣ σας", "e ́a ́x", "a\tb\x0bc\x85d e　f", "it's 'S 'LL don't", "ｆｕｌｌ ﬁ ² Ⅷ",
       "👩‍👩‍👧 ok", "a\x1cb", "İI", "▁▁a ▁b", "<s> </s> <unk>", "a" * 5000, " ".join(["x"] * 9000), "\r\n a \r b", "Thon, thon! THON*** élan. ÉLAN.'s don't."]


def odd_texts(n=400):
    rng = random.Random(0)
    letters = "ab Σσ\n\t'<|>endoftext é́ 1２▁.,! "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def table_of(spark, texts):
    return spark.createDataFrame([(i, x, "extra") for i, x in enumerate([*texts, None])], "doc_id long, text string, n_tokens string")


def test_ngrams_against_counting():
    for text in [*odd_texts(50), "L'été, 12 été!  Ça"]:
        want: Counter = Counter()
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        run = " " + " ".join(letters.split()) + " "
        if letters.split():
            for i, c in enumerate(run):
                if c != " ":
                    want[c] += 1
                if i + 1 < len(run):
                    want[run[i:i + 2]] += 1
                if i + 2 < len(run) and run[i + 1] != " ":
                    want[run[i:i + 3]] += 1
        codes, counts = langid.ngrams(text)
        got = Counter({"".join(chr(int(c) >> s & 0x1FFFFF) for s in (0, 21, 42) if int(c) >> s): int(n) for c, n in zip(codes, counts, strict=True)})
        assert got == want, text


def test_long_texts_count_in_windows(monkeypatch):
    text = "les été de la ville " * 50
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "WINDOW", 37)
    assert all((a == b).all() for a, b in zip(whole, langid.ngrams(text), strict=True))


def test_distances_against_plain_lists():
    """The out-of-place sum over the document's ranked n-grams, worked out rank by rank."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé  .") for _ in range(rng.randrange(1, 80))) for _ in range(60)]

    def order(text, size):
        codes, counts = langid.ngrams(text)
        return [c for c, _ in sorted(zip(codes.tolist(), counts.tolist(), strict=True), key=lambda x: (-x[1], x[0]))][:size]

    by_lang = {k: order(" ".join(texts[i::3]), n) for i, (k, n) in enumerate([("xx", 30), ("yy", 20), ("zz", 30)])}
    ranks = langid.Ranks(by_lang, 25)
    for t in texts:
        mine = order(t, 25)
        if not mine:
            assert ranks.predict(t) == ("und", 0.0)
            continue
        far = {k: sum(min(abs(p.index(g) - i), 30) if g in p else 30 for i, g in enumerate(mine)) for k, p in by_lang.items()}
        best = min(sorted(far), key=far.get)
        lang, score = ranks.predict(t)
        assert lang == best and abs(score - (1 - far[best] / (30 * len(mine)))) < 1e-12


def test_language_held_out_accuracy(spark, sf_dir):
    got = langid.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", "en"), (4, "the cat", None), (None, "the dog", "en"), (4, "the cat", None)],
                               "doc_id long, text string, lang string")
    by = langid.profiles(df)
    assert list(by) == ["en"]
    rows = langid.identify(df, by, keep=("doc_id", "text", "lang"), pred="p", score="s").collect()
    assert len(rows) == 6 and {r["doc_id"]: r["p"] for r in rows} == {1: "und", 2: "und", 3: "und", 4: "en", None: "en"}
    assert langid.identify(df.limit(0), by).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.profiles(df.limit(0))).collect()} == {"und"}


def test_token_counts_against_whole_texts(spark, monkeypatch):
    import sentencepiece
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    c = token_counts.Counter(model)
    assert c.splits
    texts = odd_texts()
    monkeypatch.setattr(token_counts, "PIECE", 20)
    monkeypatch.setattr(token_counts, "pieces", lambda t, f=token_counts.pieces: f(t, 20))
    assert c.lengths(texts) == [len(sp.encode(x)) for x in texts]
    got = token_counts.token_counts(table_of(spark, texts).drop("n_tokens"), model).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(sp.encode(x)) for x in texts] + [0]
    assert [r["n_bytes"] for r in got] == [len(x.encode()) for x in texts] + [0]


def test_ids_round_trip_and_gapless_sequences(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = odd_texts()
    enc = packing.Encoder(path)
    for x in texts:
        assert enc.encode(x) == np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x
    docs = table_of(spark, texts)
    got = packing.pack(packing.token_pieces(docs.union(docs), path, capacity=64), capacity=64, group_rows=300).toPandas()
    for i, x in enumerate([*texts, ""]):
        ids = [*whole.encode(x, add_special_tokens=False).ids, 1]
        mine = got[got.doc_id == i].sort_values("piece")
        assert len(mine) == 2 * -(-len(ids) // 64)
        for r in mine.itertuples():
            part = ids[r.start:r.start + 64]
            assert r.start == 64 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= 64
    assert packing.pack(packing.token_pieces(docs.limit(0), path)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 2000) if seed else np.full(999, 34)
    bins, offsets = packing.best_two_fit(lengths, 100)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 100 and fill.sum() == lengths.sum()
    assert len(fill) <= (-(-lengths.sum() // 100) * 1.01 + 1 if seed else 500)
    assert packing.best_two_fit(np.zeros(0), 100)[0].size == 0


def naive_best_two_fit(lengths, capacity):
    """The bins' lengths, piece by piece from plain lists."""
    pool, bins = sorted(lengths), []
    while pool:
        mine = []
        while fits := [x for x in pool if x <= capacity - sum(mine)]:
            mine.append(fits[-1])
            pool.remove(fits[-1])
        if sum(mine) < capacity and len(mine) > 1:
            room = capacity - sum(mine) + mine[-1]
            pairs = [(a + b, -a) for k, a in enumerate(pool) for b in pool[:k] if a + b <= room]
            if pairs and max(pairs)[0] > mine[-1]:
                both, a = max(pairs)
                pool.append(mine.pop())
                for x in (-a, both + a):
                    pool.remove(x)
                    mine.append(x)
                pool.sort()
        bins.append(mine)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_is_the_naive_one(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [101, 60, 12, 100, 40, 3][seed], 150)
    bins, offsets = packing.best_two_fit(lengths, 100)
    got = [sorted(lengths[bins == b].tolist()) for b in range(bins.max() + 1)]
    assert got == [sorted(b) for b in naive_best_two_fit(lengths.tolist(), 100)]


def test_best_two_fit_replaces_the_smallest():
    # greedy takes 60 + 30 and leaves 10; the pair 25 + 15 fits the place of 30 and the gap
    bins, _ = packing.best_two_fit(np.array([60, 30, 25, 15]), 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="<p>no</p>";</script></head><body><nav><ul><li><a href="/x">menu words</a></li></ul></nav>
<header><h2>Site</h2></header><!-- <p>gone</p> --><div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p><b>First
 block<br>goes <i>on</i>ward.<p>Second &eacute;&#233;&hellip;</p><aside>no</aside><form>name <input value="a>b"></form><p title="a>b">Third</p>
<section id="comments"><p>Nice post</p></section></article><footer><p>&copy; no</p></footer></body></html>"""


def test_main_text_of_marked_and_unmarked_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE)] * 3 + [(2, "v", None), (3, None, ""), (4, "w", "plain words"), (5, "x", "<p>cut <a href='")], "page_id long, url string, html string")
    weights = html_text.learn_weights(pages)
    want = "Head & more\nFirst block goes onward.\nSecond éé…\nThird"
    got = {r["page_id"]: r for r in html_text.extract(pages, weights).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert [got[i]["text"] for i in (2, 3, 4, 5)] == ["", "", "plain words", "cut"]
    assert html_text.main_text(PAGE.replace("article", "div"), weights) == want
    assert html_text.extract(pages, weights).count() == 7 and html_text.extract(pages.limit(0), weights).count() == 0
    assert html_text.learn_weights(pages.limit(0)) == {"text": {}, "tag": {}, "gone": {}}


def test_layout_classes_and_other_attributes_cost_no_text(spark):
    words = "one two three four five six seven eight nine ten"
    weights = {"text": {}, "tag": {}, "gone": {}}
    for attrs in ('title="hidden gems"', 'data-hidden="false"', 'class="has-sidebar"', 'class="no-comments"', 'class="overflow-hidden"', 'class="post-header"',
                  'id="related-work"'):
        assert html_text.main_text(f"<body><div {attrs}><h1>Top</h1><p>{words}</p></div><p>{words} {words}</p></body>", weights) == f"Top\n{words}\n{words} {words}", attrs
    assert html_text.main_text(f'<body><div class="page sidebar"><h1>Top</h1><p>{words}</p></div></body>', weights) == f"Top\n{words}"
    assert html_text.main_text(f'<p>go <a href="/hidden-gems">there</a> {words}</p>', weights) == f"go there {words}"
    for attrs in ('class="sidebar"', 'class="site-header"', "hidden", "style='display: none'", 'role=navigation', 'id="comments"'):
        assert html_text.main_text(f"<body><p>{words}</p><div {attrs}><p>not this</p></div><p>{words}</p></body>", weights) == f"{words}\n{words}", attrs
    assert html_text.main_text(f'<p>{words}</p><div id="comments"><p>{words} {words}</p></div>', weights) == words


def test_article_body_teaches_weights(spark):
    page = '<div><ul><li>menu words here</li></ul><div itemprop="articleBody"><div><p>the text</p></div><p>more text</p></div><p>outside</p></div>'
    assert [t for _, _, t, inside in html_text.read(page) if t and inside] == ["the text", "more text"]
    got = html_text.learn_weights(spark.createDataFrame([(page,)] * 5, "html string"))
    assert got["text"]["p"] > 0.5 > got["text"]["li"]


def test_main_text_is_the_article_of_given_pages(spark, sf_dir):
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_text.op7_html_main_text(spark, sf_dir).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside.replace("<b>", "").replace("</b>", ""))]
        assert r["text"] == "\n".join(x for x in blocks if x)


def test_memory_of_a_worker_is_bounded(monkeypatch):
    """Words are forgotten in two generations, texts are read in slices, and a task of another operator drops the words."""
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    assert packing.CACHED <= 200_000 and langid.MERGE_AT <= 1_000_000
    monkeypatch.setattr(packing, "CACHED", 20)
    monkeypatch.setattr(common, "_KEPT", {})
    enc = packing.encoder(path)
    words = ["naïve", "ÀÉÎ!", "straße", "µm", "ªº", "don't", "x's", "Ünï-çødé", "日本語", "İstanbul", "ǅ", "é", "é", "1a2", "<|endoftext|>", "THE.", "the"]
    texts = [f"{w} {w}{i} {'ab' * i}{w}" for i in range(30) for w in words]
    for x in [*texts, *texts[:40]]:
        assert enc.encode(x) == np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x
        assert len(enc.known) <= 20 + 16 and len(enc.known.before) <= 20 + 16
    assert common._KEPT
    rows = pa.RecordBatch.from_pydict({"text": [str(i) for i in range(25)]})
    seen = []
    out = list(common.lean(lambda batches: (seen.append(len(b)) or b for b in batches), 10)([rows, rows.slice(0, 0), rows.slice(0, 3)]))
    assert seen == [10, 10, 5, 3] and pa.Table.from_batches(out).num_rows == 28
    assert list(common.lean(lambda batches: batches, 0)([rows]))[0].equals(rows)
    common.forget()
    assert not common._KEPT

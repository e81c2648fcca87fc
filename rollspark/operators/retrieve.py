"""Retrieval for QA rollouts: exact dense top-k, BM25 top-k, result text,
encoder prefixes, mean pooling (O7, O8, P17, C19, C20).

Dense top-k is exact: every pair of a query block and a document block is a
group scored by matrix products that keeps its local top-k per query, and the
global top-k is a group limit over at most k x document blocks per query. BM25 works in pairs of blocks as well,
over a postings table; upper bounds keep documents from meeting the long lists of common terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollspark.functions.cols import ROUND_SHIFT, col, pystrip, rnd, with_scalars
from rollspark.session import materialize as write_once

TOKEN_SPLIT = r"[^a-z0-9]+"


def _topk_with_ties(qi, di, sr, raw, k: int):
    """Per query, keep the candidates whose rounded score reaches the query's
    k-th best (ties included, so the exact global cut is still possible)."""
    import numpy as np
    if len(qi) == 0:
        return qi, di, sr, raw
    order = np.lexsort((di, -sr, qi))
    qi, di, sr, raw = qi[order], di[order], sr[order], raw[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    sizes = np.diff(np.r_[starts, len(qi)])
    kth = np.where(sizes >= k, sr[np.minimum(starts + k - 1, len(qi) - 1)], -np.inf)
    keep = sr >= np.repeat(kth, sizes)
    return qi[keep], di[keep], sr[keep], raw[keep]


def _block_topk_fn(k: int, score_digits: int, step: int = 256):
    import numpy as np
    import pandas as pd
    scale = float(10 ** score_digits)

    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64"),
                               "score": pd.Series(dtype="float64")})]
        if len(docs) and len(queries):
            vecs = np.stack(docs["_dv"].to_numpy()).astype(np.float64)
            ids = docs["_did"].to_numpy()
            kk = min(k, len(ids))
            for at in range(0, len(queries), step):  # the score matrix stays at block x step
                some = queries.iloc[at:at + step]
                raw = vecs @ np.stack(some["_qv"].to_numpy()).astype(np.float64).T
                # the same rounding as the global ranking, so the local cut keeps
                # every document that can still reach the global top-k
                sr = np.floor(raw * scale + ROUND_SHIFT) / scale
                rows, cols = np.nonzero(sr >= np.partition(sr, len(ids) - kk, axis=0)[len(ids) - kk])
                qi, di, _, score = _topk_with_ties(cols, ids[rows], sr[rows, cols], raw[rows, cols], k)
                found.append(pd.DataFrame({"query_id": some["_qid"].to_numpy()[qi], "doc_id": di, "score": score}))
        return pd.concat(found, ignore_index=True)
    return run


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, doc_id="doc_id", doc_vec="embedding",
               query_id="query_id", query_vec="embedding", query_block: int = 2048, doc_block: int = 8192,
               score_digits: int = 6) -> DataFrame:
    """Exact top-k documents by inner product for every query.

    Queries and documents are hashed into blocks of about ``query_block`` and
    ``doc_block`` rows. Every pair of blocks is one group whose task scores it
    with matrix products and keeps the block's top k per query (and ties); the
    global cut is a group limit over those. Only two counts reach the driver,
    and no relation is broadcast. Ranking is by the score rounded to
    ``score_digits`` (descending), then by doc id, so equal scores cut
    deterministically. Rows with a null id or vector take no part."""
    q = queries.select(col(query_id).alias("_qid"), col(query_vec).alias("_qv")).dropna()
    c = corpus.select(col(doc_id).alias("_did"), col(doc_vec).alias("_dv")).dropna()
    q_blocks = max(1, -(-q.count() // query_block))
    c_blocks = max(1, -(-c.count() // doc_block))

    def spread(df, key, own, n_own, other, n_other):
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own))) \
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint"))))

    q = spread(q, "_qid", "_qb", q_blocks, "_cb", c_blocks)
    c = spread(c, "_did", "_cb", c_blocks, "_qb", q_blocks)
    cand = q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb")).applyInPandas(
        _block_topk_fn(k, score_digits), "query_id long, doc_id long, score double")
    w = Window.partitionBy("query_id").orderBy(rnd("score", score_digits).desc(), F.col("doc_id"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .withColumnRenamed("query_id", query_id if isinstance(query_id, str) else "query_id") \
        .withColumnRenamed("doc_id", doc_id if isinstance(doc_id, str) else "doc_id")


def tokenize(text) -> Column:
    """Lower-case ASCII word tokens (letters and digits), empty pieces dropped."""
    return F.filter(F.split(F.lower(col(text)), TOKEN_SPLIT), lambda t: t != "")


def bm25_index(docs: DataFrame, doc_id="doc_id", text="text", k1: float = 0.9, b: float = 0.4,
               terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc_id, weight): BM25 term weight with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)) and length normalisation by the
    average document length. ``k1`` / ``b`` are explicit. With ``terms`` (a
    column ``term``) only their postings are made; the weights are the same, as
    N, document frequencies and lengths still come from all documents.

    Texts are split once, into a table from which the statistics and the terms
    are taken. The document length travels with its term counts, so no join
    brings it back."""
    toks = write_once(docs.select(col(doc_id).alias("doc_id"), tokenize(text).alias("_t")), "bm25_tokens")
    stats = toks.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("_t")).alias("avgdl"))
    words = toks.select("doc_id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if terms is not None:
        # written, so that its size is known: Spark broadcasts a short list and the words are not shuffled for it
        words = words.join(write_once(terms.select("term").distinct(), "bm25_terms"), "term", "left_semi")
    tf = words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    p = with_scalars(tf.join(dfreq, "term"), stats)  # stats: one row
    idf = F.log(F.lit(1.0) + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return p.select("term", "doc_id", (idf * norm).alias("weight"))


def query_terms(queries: DataFrame, query_id="query_id", text="text") -> DataFrame:
    """(query_id, term, qtf): the terms of each query with their counts."""
    return queries.select(col(query_id).alias("query_id"), F.explode(tokenize(text)).alias("term")) \
        .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


#: Postings of a block, about; a block is a hash range of document ids.
BLOCK_POSTINGS = 1 << 16
#: A posting that is looked up costs about this many that are read.
LOOKUP_COST = 8
#: From so many blocks on a score that k documents surely reach is worked out over all of them first, so that whole
#: blocks are left out; a few blocks find their own while they are scored.
FLOOR_BLOCKS = 32


def _bm25_tables(index: DataFrame, queries: DataFrame, query_id, text, block_postings: int):
    """Query terms and postings with their block, each written once, and the number of blocks."""
    qt = write_once(query_terms(queries, query_id, text), "bm25_query_terms")
    posts = write_once(index.select("term", "doc_id", "weight"), "bm25_postings")
    n_blocks = max(1, -(-posts.count() // block_postings))
    return qt, posts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))), n_blocks


def _sums(terms: DataFrame, posts: DataFrame, on: list[str]) -> DataFrame:
    return terms.join(posts, on).groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qtf")).alias("score"))


def _best(scores: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)


def _bm25_threshold(qt: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): a score that k documents of the query reach for certain.

    The terms that can add most, up to the one at which their postings reach 4k,
    give partial scores; the 2k best documents by these are scored in full, and
    the k-th best of them is the floor. A query with fewer has none."""
    terms = posts.groupBy("term").agg(F.max("weight").alias("most"), F.count(F.lit(1)).alias("df"))
    up = Window.partitionBy("query_id").orderBy((F.col("most") * F.col("qtf")).desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = qt.join(terms, "term").withColumn("_before", F.coalesce(F.sum("df").over(up), F.lit(0))).filter(F.col("_before") < 4 * k)
    some = _best(_sums(seeds.select("query_id", "term", "qtf"), posts, ["term"]), 2 * k).select("query_id", "doc_id")
    full = _sums(some.join(qt, "query_id"), posts, ["term", "doc_id"])
    return _best(full, k).filter(F.col("_r") == k).select("query_id", F.col("score").alias("floor"))


def _block_bm25_fn(k: int, score_digits: int):
    """Best documents of one block for each query of one block.

    Terms are added from the one that can add most on. The floor is the query's,
    or the k-th best sum in the block so far; once the terms left over stay
    below it together, only documents whose sum can still reach it get them."""
    import numpy as np
    import pandas as pd
    scale, slack = float(10 ** score_digits), 2 * 10.0 ** -score_digits

    def run(asked: pd.DataFrame, posts: pd.DataFrame) -> pd.DataFrame:
        found, scored = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})], 0
        if len(asked) and len(posts):
            ids, doc = np.unique(posts["doc_id"].to_numpy(), return_inverse=True)
            codes, names = pd.factorize(posts["term"])
            order = np.lexsort((doc, codes))
            doc, weight, codes = doc[order], posts["weight"].to_numpy()[order], codes[order]
            at = dict(zip(names, zip(np.searchsorted(codes, np.arange(len(names))), np.searchsorted(codes, np.arange(len(names)), "right"), strict=True), strict=True))
            score = np.zeros(len(ids))
            for query, terms in asked.groupby("query_id", sort=False):
                lists = [(a, z, weight[a:z].max() * n, n) for (a, z), n in ((at[t], n) for t, n in zip(terms["term"], terms["qtf"], strict=True) if t in at)]
                lists.sort(key=lambda x: x[2])
                least = np.cumsum([x[2] for x in lists])
                floor, first = float(terms["floor"].iloc[0]), len(lists)
                if not len(lists) or least[-1] < floor:
                    continue
                score[:] = 0.0
                while first and least[first - 1] >= floor:  # what is left over could still make a document by itself
                    first -= 1
                    a, z, _, n = lists[first]
                    score[doc[a:z]] += weight[a:z] * n
                    if first % 4 == 0 and len(ids) >= k:
                        floor = max(floor, np.partition(score, len(ids) - k)[len(ids) - k] - slack)
                rest = least[first - 1] if first else 0.0
                left = np.flatnonzero((score > 0) & (score + rest >= floor))
                scored += len(left)
                common = sum(z - a for a, z, _, _ in lists[:first])
                if LOOKUP_COST * len(left) * first < common:
                    for a, z, _, n in lists[:first]:
                        p = a + np.searchsorted(doc[a:z], left)
                        hit = (p < z) & (doc[np.minimum(p, z - 1)] == left)
                        score[left[hit]] += weight[p[hit]] * n
                else:
                    for a, z, _, n in lists[:first]:
                        score[doc[a:z]] += weight[a:z] * n
                if len(left):
                    raw = score[left]
                    q, d, _, r = _topk_with_ties(np.zeros(len(left), np.int64), ids[left], np.floor(raw * scale + ROUND_SHIFT) / scale, raw, k)
                    found.append(pd.DataFrame({"query_id": query, "doc_id": d, "score": r}))
        out = pd.concat(found, ignore_index=True)
        out["scored"] = 0
        if len(out):
            out.loc[0, "scored"] = scored  # of the whole pair of blocks
        return out
    return run


def _bm25_block_hits(index, queries, k, query_id, text, score_digits, block_postings, query_block):
    qt, posts, n_blocks = _bm25_tables(index, queries, query_id, text, block_postings)
    asked = qt.withColumn("floor", F.lit(0.0))
    if n_blocks > FLOOR_BLOCKS:
        floors = _bm25_threshold(qt, posts, k)
        asked = qt.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - F.lit(2 * 10.0 ** -score_digits))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    q_blocks = max(1, -(-qt.select("query_id").distinct().count() // query_block))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)))
    posts = posts.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))
    hits = asked.groupBy("qb", "block").cogroup(posts.groupBy("qb", "block")).applyInPandas(
        _block_bm25_fn(k, score_digits), "query_id long, doc_id long, score double, scored long")
    return qt, posts, hits


def bm25_topk(index: DataFrame, queries: DataFrame, k: int, query_id="query_id", text="text", score_digits: int = 6,
              block_postings: int = BLOCK_POSTINGS, query_block: int = 2048) -> DataFrame:
    """Top-k documents per query by BM25 (O8): query terms (with repeats, as a
    bag) meet the postings on term, scores are summed per (query, doc).

    Postings lie in blocks (hash ranges of documents), queries in blocks too; a
    pair of blocks is one group, in which postings are added up in arrays and
    only the best ``k`` (and ties) of each query leave it. So a common term is as
    many keys as there are blocks, and what is shuffled is the postings once per
    query block and k rows per query and block. Exact, with pruning by upper
    bounds, the largest weights of each term in the block: documents that cannot
    reach a score that k documents surely have (:func:`_bm25_threshold`, and the
    block's own best) are left out: whole blocks, then documents without an
    essential term (the terms that add least and together stay below that score
    are not), then those whose essential terms leave too little. Query and
    document ids are integers."""
    *_, hits = _bm25_block_hits(index, queries, k, query_id, text, score_digits, block_postings, query_block)
    w = Window.partitionBy("query_id").orderBy(rnd("score", score_digits).desc(), F.col("doc_id"))
    return hits.select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_pruning(index: DataFrame, queries: DataFrame, k: int, query_id="query_id", text="text", score_digits: int = 6,
                 block_postings: int = BLOCK_POSTINGS, query_block: int = 2048) -> DataFrame:
    """One row: the pairs of a query and a document that share a term (``sharing``), and those that :func:`bm25_topk`
    scores in full (``scored``; pairs of blocks without any hit count none)."""
    qt, posts, hits = _bm25_block_hits(index, queries, k, query_id, text, score_digits, block_postings, query_block)
    sharing = qt.join(posts.filter("qb = 0"), "term").select("query_id", "doc_id").distinct().agg(F.count(F.lit(1)).alias("sharing"))
    return with_scalars(sharing, hits.agg(F.sum("scored").alias("scored")))


def results_text(hits: DataFrame, query_id="query_id", rank="rank", content="contents", style: str = "doc") -> DataFrame:
    """One text per query. style 'doc': 'Doc i: <content>' lines;
    style 'query': 'Query: <q>' then 'Document i:' / content lines (needs a
    ``query`` column). Hits of one query are at most k rows."""
    if style == "doc":
        line = F.concat(F.lit("Doc "), col(rank).cast("string"), F.lit(": "), pystrip(col(content)), F.lit("\n"))
        g = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(col(rank).alias("r"), line.alias("l"))))
                                       .alias("_x"))
        return g.select(query_id, F.array_join(F.transform("_x", lambda x: x["l"]), "").alias("text"))
    line = F.concat(F.lit("Document "), col(rank).cast("string"), F.lit(":\n"), col(content), F.lit("\n"))
    g = hits.groupBy(query_id, "query").agg(
        F.array_sort(F.collect_list(F.struct(col(rank).alias("r"), line.alias("l")))).alias("_x"))
    return g.select(query_id, F.concat(F.lit("Query: "), F.col("query"), F.lit("\n"),
                                       F.array_join(F.transform("_x", lambda x: x["l"]), "")).alias("text"))


# Encoder-specific prefixes.
E5_QUERY, E5_PASSAGE = "query: ", "passage: "
BGE_QUERY = "Represent this sentence for searching relevant passages: "


def encoder_prefix(text, model_name: str, is_query: bool) -> Column:
    """e5 models prefix 'query: ' / 'passage: '; bge prefixes queries."""
    t = col(text)
    name = model_name.lower()
    if "e5" in name:
        t = F.concat(F.lit(E5_QUERY if is_query else E5_PASSAGE), t)
    if "bge" in name and is_query:
        t = F.concat(F.lit(BGE_QUERY), t)
    return t


POOLED_KEYS = 4096


def _partial_sums(batches):
    """(key, sums, counts) of the vectors of one task, one row per key and vector length; handed on whenever
    ``POOLED_KEYS`` keys have come together."""
    import numpy as np
    import pyarrow as pa
    found: dict = {}

    def flush():
        keys = list(found)
        out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), *(pa.array([found[k][i].tolist() for k in keys], pa.list_(pa.float64())) for i in (0, 1))],
                                         ["_k", "_s", "_c"])
        found.clear()
        return out

    for batch in batches:
        vecs = batch.column(1)
        lengths = np.diff(vecs.offsets.to_numpy())
        flat = vecs.flatten()
        present = flat.is_valid().to_numpy(zero_copy_only=False).astype(np.float64)
        values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        coded = batch.column(0).dictionary_encode()
        codes, names = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for size in np.unique(lengths):
            rows = np.flatnonzero((lengths == size) & vecs.is_valid().to_numpy(zero_copy_only=False))
            if not size or not len(rows):
                continue
            cells = starts[rows][:, None] + np.arange(size)
            order = np.argsort(codes[rows], kind="stable")
            cuts = np.flatnonzero(np.diff(codes[rows][order], prepend=-2))
            for code, total, count in zip(codes[rows][order][cuts], np.add.reduceat(values[cells][order], cuts, axis=0),
                                          np.add.reduceat(present[cells][order], cuts, axis=0), strict=True):
                had = found.setdefault((None if code < 0 else names[code], int(size)), [np.zeros(size), np.zeros(size)])
                had[0] += total
                had[1] += count
        if len(found) >= POOLED_KEYS:
            yield flush()
    yield flush()


def mean_pool(df: DataFrame, key, vec="embedding", mask=None, normalize: bool = True) -> DataFrame:
    """C20: element-wise mean of the vectors of each key (masked rows skipped),
    then L2 normalisation.

    Each task adds up its vectors per key (flat Arrow buffers), so the shuffle
    carries one sum per task and key; only these are taken apart by dimension.
    Null components count for nothing; vectors of a key may differ in length."""
    d = df if mask is None else df.filter(col(mask) > 0)
    name = key if isinstance(key, str) else "key"
    d = d.select(col(key).alias("_k"), col(vec).alias("_v"))
    kind = d.schema["_k"].dataType
    sums = d.select(F.col("_k").cast("string"), "_v").mapInArrow(_partial_sums, "_k string, _s array<double>, _c array<double>")
    cells = sums.select("_k", F.posexplode(F.arrays_zip("_s", "_c")).alias("_i", "_x"))
    m = cells.groupBy("_k", "_i").agg(F.try_divide(F.sum("_x._s"), F.sum("_x._c")).alias("_m"))
    vecs = m.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_x")) \
        .select(F.col("_k").cast(kind).alias(name), F.transform("_x", lambda x: x["_m"]).alias("pooled"))
    if not normalize:
        return vecs
    norm = F.sqrt(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))
    return vecs.withColumn("pooled", F.transform("pooled", lambda x: x / F.greatest(norm, F.lit(1e-12))))

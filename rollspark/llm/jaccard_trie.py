"""N-gram Jaccard join with a prefix tree.

Two documents link when the Jaccard similarity of their sets of word n-grams
reaches a threshold. The steps:

1. One scan of the texts makes each document's set, a 128-bit signature of it
   (documents with equal sets are one node from then on), and the part of the
   set that a partner must share: a document of n n-grams shares at least
   ``need(n)`` of them with any partner, so of its ``n - need(n) + more(n)`` first
   in the order of the hashes it shares ``more`` at least.
2. Documents of which fewer n-grams than that occur in any other document have
   no partner. Counting goes by hash in packed blocks; a task first settles what
   it can see itself, so an n-gram of very many documents is sent once a task.
3. The others' whole sets are ordered by frequency among them, rarest first;
   partners share one of the first ``n - need(n) + 1``. Documents that share one
   are put in a block.
4. A block's whole sets, in one global order (commonest first), are stored in a
   trie. For each set the trie is walked with the overlap counted so far, which
   all sets below a node share, and a subtree is left when what remains of the
   set or of the longest set below cannot reach the overlap that the shortest
   below needs, or when it is linked already. Blocks with more than
   ``BLOCK`` sets are cut into chunks, and every pair of chunks is one task.

All is exact but for equal 64-bit hashes of different n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollspark.llm.common import kept, lean, table, write_once
from rollspark.llm.components import components

KNOWN_WORDS, BLOCK, ENTRIES = 300_000, 2000, 1_000_000
BLOOM_BITS = 1 << 24
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Ascending distinct hashes of the text's word n-grams; of the whole sequence if it has fewer words.

    A-Z are lower-cased; words are what stands between blanks, tabs and line ends of ASCII.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(kept("ngram words", Words).__getitem__, words), np.uint64, len(words))
    if len(w) < n:
        return np.array([xxhash.xxh64_intdigest(w.tobytes(), seed=n)], np.uint64)
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = (h ^ (h >> np.uint64(29))) * ODD[0] + w[j:len(h) + j] * ODD[j % len(ODD)]
    h ^= h >> np.uint64(32)
    h *= ODD[1]
    return np.unique(h ^ (h >> np.uint64(29)))


def need(n, percent: int):
    """Overlap that a set of ``n`` has at least with any partner."""
    return (percent * n + 99) // 100


def more(n):
    return np.maximum(1, n // 10)


def part_size(n, percent: int):
    return n - need(n, percent) + more(n)


def least_shared(n, percent: int):
    """How many of its part a set of ``n`` shares with any partner, which may be smaller, at least."""
    return more(need(n, percent))


def sets_and_parts(docs: DataFrame, text: str, doc_id: str, n: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, part) of every row; ``part`` packs 64-bit hashes."""
    def run(batches):
        for b in batches:
            size, sig, part = [], [], []
            for x in b.column(1):
                s = ngram_set(x.as_py(), n)
                size.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                part.append(s[:part_size(len(s), percent)].tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(part, pa.binary())],
                                             ["doc_id", "n", "sig", "part"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(lean(run), "doc_id long, n long, sig binary, part binary")


def runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def spans(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    at = runs(sorted_values).tolist()
    return list(zip(at, at[1:] + [len(sorted_values)], strict=True)) if at else []


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def shared_counts(parts: DataFrame, buckets: int) -> DataFrame:
    """(key, shared): of how many n-grams of its part another set has a copy too, at least when it counts (equal sets may add up)."""
    schema = "bucket int, tokens binary, keys binary, done_keys binary, done_counts binary"

    def deal(batches):
        for b in (whole.slice(k, 5000) for whole in batches for k in range(0, len(whole), 5000)):
            keys = np.array([int.from_bytes(x[:8], "little") | 1 for x in b.column(0).to_pylist()], np.uint64)
            packed = b.column(1).to_pylist()
            tokens = np.frombuffer(b"".join(packed), np.uint64)
            keys = np.repeat(keys, [len(x) // 8 for x in packed])
            order = np.lexsort((keys, tokens))
            tokens, keys = tokens[order], keys[order]
            new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])]) if len(tokens) else np.zeros(0, bool)
            tokens, keys = tokens[new], keys[new]  # an n-gram once for each different set
            first = runs(tokens)
            length = np.diff(np.concatenate([first, [len(tokens)]]))
            many = np.repeat(length > 1, length)
            done, counts = counted(keys[many])
            keys = np.where(many, np.uint64(0), keys)  # settled here: one entry tells other tasks
            kept = ~many
            kept[first] = True
            tokens, keys = tokens[kept], keys[kept]
            bucket = (tokens >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, keys = bucket[order], tokens[order], keys[order]
            rows = [(int(bucket[s]), tokens[s:e].tobytes(), keys[s:e].tobytes(), b"", b"") for s, e in spans(bucket)]
            if len(done):
                rows.append((len(packed) % buckets, b"", b"", done.tobytes(), counts.astype(np.int64).tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                             ["bucket", "tokens", "keys", "done_keys", "done_counts"])

    def settle(batches):
        tokens, keys = [], []

        def out(k, c):
            bucket = (k >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, k, c = bucket[order], k[order], c[order].astype(np.int64)
            cut = spans(bucket)
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[s]) for s, _ in cut], pa.int32()), pa.array([k[s:e].tobytes() for s, e in cut], pa.binary()),
                                               pa.array([c[s:e].tobytes() for s, e in cut], pa.binary())], ["bucket", "keys", "counts"])

        for b in batches:
            for t, k, dk, dc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens.append(np.frombuffer(t, np.uint64))
                keys.append(np.frombuffer(k, np.uint64))
                if dk:
                    yield out(np.frombuffer(dk, np.uint64), np.frombuffer(dc, np.int64))
        if tokens:
            t, k = np.concatenate(tokens), np.concatenate(keys)
            order = np.lexsort((k, t))
            t, k = t[order], k[order]
            first = runs(t)
            length = np.diff(np.concatenate([first, [len(t)]]))
            last = first + length - 1
            shared = np.repeat((k[first] != k[last]) | (k[first] == 0), length)
            yield out(*counted(k[shared & (k != 0)]))

    def add(batches):
        keys, counts = [], []
        for b in batches:
            keys += [np.frombuffer(x, np.uint64) for x in b.column(0).to_pylist()]
            counts += [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        if keys:
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = runs(k)
            yield pa.RecordBatch.from_arrays([pa.array(k[first].view(np.int64)), pa.array(np.add.reduceat(c, first) if len(c) else c, pa.int64())], ["key", "shared"])

    dealt = parts.select("sig", "part").mapInArrow(lean(deal, 0), schema)
    # as many partitions as buckets: what a partition gets is sorted whole, ENTRIES or so
    settled = dealt.repartition(buckets, "bucket").select("tokens", "keys", "done_keys", "done_counts") \
        .mapInArrow(lean(settle, 0), "bucket int, keys binary, counts binary")
    return settled.repartition(buckets, "bucket").select("keys", "counts").mapInArrow(lean(add, 0), "key long, shared long")


def key_of(sig) -> F.Column:
    """The key that :func:`shared_counts` makes of a signature: its first 8 bytes, little-endian, made odd."""
    raw = F.substring(F.hex(sig), 1, 16)
    little = F.concat(*[F.substring(raw, 15 - 2 * i, 2) for i in range(8)])
    high, low = F.conv(F.substring(little, 1, 8), 16, 10).cast("long"), F.conv(F.substring(little, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseOR(F.lit(1).cast("long"))


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """(node, block) for nodes that share a deciding n-gram with another, from (node, n, grams)."""
    def unpack(batches):
        for b in batches:
            for first in range(0, len(b), 200):
                part = b.slice(first, 200)
                packed = part.column(2).to_pylist()
                rep = pa.array(np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rep), part.column(1).take(rep), pa.array(np.frombuffer(b"".join(packed), np.int64))],
                                                 ["node", "n", "token"])

    tokens = members.select("node", "n", "grams").mapInArrow(lean(unpack, 0), "node long, n long, token long")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    each = Window.partitionBy("node")
    overlap = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    first = (tokens.join(often, "token").withColumn("k", F.count(F.lit(1)).over(each)).withColumn("r", F.row_number().over(each.orderBy("f", "token")))
             .where(F.col("r") <= F.col("k") - overlap + 1).select("token", "node"))
    first = write_once(first, "deciding")
    hubs = first.groupBy("token").agg(F.min("node").alias("hub"))
    edges = first.join(hubs, "token").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    return components(edges).withColumnRenamed("component", "block")


class Trie:
    """Sets as ascending rank lists in a compressed trie; finds which are linked."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        every = np.concatenate(sets)
        _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))  # commonest first
        cut = np.cumsum([len(s) for s in sets])[:-1]
        ranked = [np.sort(r) for r in np.split(rank[inverse], cut)]
        self.order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
        self.sets = [ranked[i] for i in self.order]
        self.width = len(count)
        self.parent = list(range(len(sets)))
        # a node: [start, end, a set that passes it, children, set that ends here or -1, last leaf, shortest, longest, component or -1]
        self.root = [0, 0, 0, [], -1, len(sets) - 1, 0, 0, -1]
        path = [self.root]
        for i, s in enumerate(self.sets):
            common = 0
            if i:
                t = self.sets[i - 1]
                m = min(len(s), len(t))
                differ = np.flatnonzero(s[:m] != t[:m])
                common = int(differ[0]) if len(differ) else m
            while len(path) > 1 and path[-1][0] >= common:
                path.pop()
            top = path[-1]
            if top[1] > common:  # cut the edge where the new set leaves it
                lower = [common, top[1], top[2], top[3], top[4], top[5], 0, 0, -1]
                top[1], top[3], top[4] = common, [lower], -1
            if len(s) == common:
                top[4] = i
            else:
                leaf = [common, len(s), i, [], i, i, 0, 0, -1]
                top[3].append(leaf)
                path.append(leaf)
        self.nodes = []
        stack = [self.root]
        while stack:
            node = stack.pop()
            self.nodes.append(node)
            stack += node[3]
        for node in reversed(self.nodes):
            ends = [len(self.sets[node[4]])] if node[4] >= 0 else []
            node[6] = min(ends + [c[6] for c in node[3]])
            node[7] = max(ends + [c[7] for c in node[3]])
            node[5] = max(([node[4]] if node[4] >= 0 else []) + [c[5] for c in node[3]])

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return 100 * overlap >= self.percent * (a + b - overlap)

    def join(self) -> list[int]:
        """The component of each set given, as the number of one of them."""
        p, q = self.percent, 100 + self.percent
        for i in range(len(self.sets) - 1):  # neighbours in the trie's order
            a, b = self.sets[i], self.sets[i + 1]
            if min(len(a), len(b)) * 100 >= p * max(len(a), len(b)) and self.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)):
                self.parent[self.find(i + 1)] = self.find(i)
        for node in reversed(self.nodes):  # a subtree that is one component
            inside = {self.find(node[4])} if node[4] >= 0 else set()
            inside |= {self.find(c[8]) if c[8] >= 0 else -1 for c in node[3]}
            node[8] = inside.pop() if len(inside) == 1 else -1
        mask = np.zeros(self.width, bool)
        for i, s in enumerate(self.sets):
            if self.root[8] >= 0:
                break
            size = len(s)
            mask[s] = True
            stack = [(self.root, 0)]
            while stack:
                node, overlap = stack.pop()
                if node[5] <= i or (node[8] >= 0 and self.find(node[8]) == self.find(i)):
                    continue
                if node[7] * 100 < p * size or size * 100 < p * node[6]:
                    continue
                start, end = node[0], node[1]
                if end > start:
                    segment = self.sets[node[2]][start:end]
                    overlap += int(np.count_nonzero(mask[segment]))
                    left = size - int(np.searchsorted(s, segment[-1], "right"))
                    if (overlap + min(left, node[7] - end)) * q < p * (size + node[6]):
                        continue
                if node[4] > i and self.linked(overlap, size, end):
                    a, b = self.find(i), self.find(node[4])
                    if a != b:
                        self.parent[b] = a
                stack += [(c, overlap) for c in node[3]]
            mask[s] = False
        out = [0] * len(self.sets)
        for place, i in enumerate(self.order):
            out[i] = self.order[self.find(place)]
        return out


def whole_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, n: int) -> DataFrame:
    """(doc_id, sig, grams) of the rows whose id may be in ``wanted`` (by a Bloom filter of fixed size)."""
    spots = F.array(F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BLOOM_BITS)))
    rows = (wanted.select(F.explode(spots).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).toArrow())
    words = np.zeros(BLOOM_BITS // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    bits = docs.sparkSession.sparkContext.broadcast(words.tobytes())

    def run(batches):
        held = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool)
        for b in batches:
            maybe = np.flatnonzero(held[b.column(2).to_numpy()] & held[b.column(3).to_numpy()])
            took = b.take(pa.array(maybe))
            sets = [ngram_set(x, n) for x in took.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [took.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "sig", "grams"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    src = src.select("doc_id", "text", spots[0].alias("x"), spots[1].alias("y"))
    return src.mapInArrow(lean(run), "doc_id long, sig binary, grams binary")


def joined_blocks(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges between linked nodes, enough to connect them, from (node, block, grams)."""
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    m = members.join(sizes, "block").withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tasks = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "block", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "chunks", "node", "grams")
    # with several chunks, the pairs of different ones also join each with itself
    tasks = tasks.where("i < j or chunks = 1").drop("chunks")

    def run(batches):
        held, key = [], None

        def done():
            found = Trie([np.frombuffer(g, np.uint64) for _, g in held], percent).join() if len(held) > 1 else []
            rows = [(held[i][0], held[r][0]) for i, r in enumerate(found) if i != r]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], ["a", "b"])

        for b in batches:
            for block, i, j, node, grams in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, i, j) != key:
                    if held:
                        yield done()
                    held, key = [], (block, i, j)
                held.append((node, grams))
        if held:
            yield done()

    keys = ["block", "i", "j"]
    return tasks.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def linked_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the smallest id reachable by links. Documents without
    text or words are linked with nothing; a row with a null id has a null
    component unless it has the n-grams of others. Repeated rows each return;
    rows of one id with different texts are different documents. Other columns
    are not read.
    """
    spark = docs.sparkSession
    scan = write_once(sets_and_parts(docs, text, doc_id, n, percent), "sets")
    reps = write_once(scan.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"))
                      .withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = scan.agg(F.sum(F.length("part"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // 8 // ENTRIES + 1)
    counts = shared_counts(scan.where("n > 0"), buckets)
    least = F.greatest(F.lit(1), F.floor(F.floor((F.lit(percent) * F.col("n") + 99) / 100) / 10))
    live = write_once(reps.where("rep is not null").withColumn("key", key_of("sig")).join(counts, "key").where(F.col("shared") >= least)
                      .select("node", "n", "sig", F.col("rep").alias("doc_id")), "live")
    members = write_once(whole_sets(docs, live, text, doc_id, n).join(live, ["doc_id", "sig"]).dropDuplicates(["node"]).select("node", "n", "grams"), "members")
    block = blocks(members, percent)
    linked = components(joined_blocks(members.select("node", "grams").join(block, "node"), percent))
    named = reps.join(linked, "node", "left").withColumn("c", F.coalesce("component", "node"))
    smallest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    of = named.join(smallest, "c").select(F.col("sig").alias("s"), "component_id")
    out = scan.join(of, (F.col("sig") == F.col("s")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * shared >= 85 * (s.n + t.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = d.doc_id
"""

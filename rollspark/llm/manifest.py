"""Merkle manifest of a dataset by time-forward processing.

A node's label is its level and its place in the level; in the order of labels
every child comes before its parent. Children send their digests into a
priority queue under the label of their parent; a node, when its label is the
least of the queue, takes all that was sent to it. A sweep in the reversed order
sends to each child the proof above it: the steps from the child up to the root.

The queue is external: the trees are worked on in bands of ``BAND`` levels. What
a band sends to later ones is a table keyed by (tree, block), which Spark's
shuffle brings together and sorts; inside a block of 2^BAND nodes, which is
what a task holds at a time, the queue is a heap. So no task sees a whole tree,
and n leaves take log2(n) / BAND rounds each way over tables that shrink by
2^BAND a round.

A step of a proof is the text whose digest is the parent's: the digests of the
node and its sibling in order, with ``+`` in the node's own place.
"""

from __future__ import annotations

from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollspark.llm.common import CRC_TABLE, crc32_sql, table, write_once

#: Levels of a tree that one task works on at a time.
BAND = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UP = "tree string, n long, idx long, digest string"


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def sweep_up(leaves: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The digest ``levels`` above the leaves (at most 2^levels) and what each node on the way was sent, by label."""
    queue = [((1, i // 2), i, d) for i, d in enumerate(leaves)] if levels else []
    sent: dict[tuple[int, int], list[str]] = {}
    top = leaves[0]
    while queue:
        label = queue[0][0]
        inbox = []
        while queue and queue[0][0] == label:
            inbox.append(heappop(queue)[2])
        sent[label] = inbox
        top = _digest("".join(inbox))
        level, i = label
        if level < levels:
            heappush(queue, ((level + 1, i // 2), i, top))
    return top, sent


def sweep_down(sent: dict[tuple[int, int], list[str]], levels: int, above: str, n: int) -> list[str]:
    """The proof of each of the ``n`` leaves, with that of their top node behind it."""
    out = [above] * n
    queue = [(-levels, 0, above)] if levels else []
    while queue:
        neg, i, proof = heappop(queue)
        inbox = sent[-neg, i]
        for side in range(len(inbox)):
            step = "+" if len(inbox) == 1 else f"+{inbox[1]}" if side == 0 else f"{inbox[0]}+"
            child = f"{step},{proof}" if proof else step
            if neg == -1:
                out[2 * i + side] = child
            else:
                heappush(queue, (neg + 1, 2 * i + side, child))
    return out


def _levels(n: int, band: int, high: int) -> int:
    """How many levels of a tree over n leaves lie in this band of ``high`` levels."""
    return min(max((n - 1).bit_length() - band * high, 0), high)


def _blocks(nodes: DataFrame, high: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", high))


def _climb(nodes: DataFrame, band: int, high: int) -> DataFrame:
    """From the nodes of a band (tree, n, idx, digest) those of the next: one a block."""

    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        n = t["n"][0].as_py()
        top, _ = sweep_up(t["digest"].to_pylist(), _levels(n, band, high))
        return pa.table({"tree": t["tree"][:1], "n": [n], "idx": t["block"][:1], "digest": [top]})

    return _blocks(nodes.select("tree", "n", "idx", "digest"), high).groupBy("tree", "block").applyInArrow(up, _UP)


def _descend(nodes: DataFrame, above: DataFrame, band: int, high: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of a band (tree, idx and ``keep``) with ``above``, the proof of each, and their ``subroot``; from those of their blocks."""
    nodes = _blocks(nodes.select(*dict.fromkeys(("tree", "n", "idx", "digest", *keep))), high)
    schema = nodes.select("tree", "idx", *keep).schema.add("above", "string").add("subroot", "string")

    def down(t: pa.Table, proofs: pa.Table) -> pa.Table:
        t, below, subroots = t.sort_by("idx"), [], []
        if len(t):
            levels = _levels(t["n"][0].as_py(), band, high)
            _, sent = sweep_up(t["digest"].to_pylist(), levels)
            below = sweep_down(sent, levels, proofs["above"][0].as_py(), len(t))
            subroots = [proofs["subroot"][0].as_py()] * len(t)
        return t.select(["tree", "idx", *keep]).append_column("above", pa.array(below, pa.string())).append_column("subroot", pa.array(subroots, pa.string()))

    return nodes.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(down, schema)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with a column tree) and ``n``, the rows of the tree, and ``idx``, their place in it by ``order``.

    Rows are dealt and sorted by ranges of (tree, order) once; a row's place
    is its place in the range plus the tree's rows in the ranges before. Equal
    rows are told apart by where they were read, so a range is never stuck on one value.
    """
    here = F.monotonically_increasing_id()
    ranged = (rows.withColumn("__tie", here).repartitionByRange("tree", *order, "__tie").sortWithinPartitions("tree", *order, "__tie").drop("__tie")
              .withColumn("__at", here))
    ranged = write_once(ranged, name).withColumn("__range", F.shiftright("__at", 33))
    before = Window.partitionBy("tree").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("tree", "__range").agg(F.count("*").alias("held"), F.min("__at").alias("first"))
              .select("tree", "__range", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(Window.partitionBy("tree")).alias("n")))
    return (ranged.join(starts, ["tree", "__range"])
            .withColumn("idx", F.col("__at") - F.col("first") + F.col("start")).drop("__range", "__at", "first", "start"))


def _grow(nodes: DataFrame, high: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes at the foot of each band, and the root of each tree (tree, digest)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    bands = [nodes]
    for band in range(max(1, -(-(most - 1).bit_length() // high))):
        bands.append(write_once(_climb(bands[-1], band, high), f"{name}-{band + 1}"))
    return bands[:-1], bands[-1].select("tree", "digest")


def _sink(bands: list[DataFrame], above: DataFrame, high: int, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The proofs (column above) of the lowest band's nodes, from those of the trees (tree, above, subroot)."""
    above = above.select("tree", F.lit(0).cast("long").alias("block"), "above", "subroot")
    for band in range(len(bands) - 1, 0, -1):
        above = write_once(_descend(bands[band], above, band, high).select("tree", F.col("idx").alias("block"), "above", "subroot"), f"{name}-{band}")
    return _descend(bands[0], above, 0, high, keep)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    def told(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(told(c) for c in fields.values())).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof (array of steps) lead to."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.replace(step, F.lit("+"), own).cast("binary"), 256))


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id", also: dict[str, Column] | None = None, high: int = BAND) -> DataFrame:
    """``order``, the columns ``also``, ``leaf``, ``subroot``, ``root`` and ``proof`` (array of steps) of every row.

    The leaves of each value of ``tree`` form one tree by ascending ``order``
    (nulls first, equal ones by digest); the trees' roots, by that value (null
    first, then bytewise), form the tree whose root is ``root``. Two consecutive
    nodes become one, a last single one too, until one is left. Equal rows are
    leaves each; columns not named are not read; an empty table gives no rows.
    ``high`` is the number of levels of a band.
    """
    also = also or {}
    tree_key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    leaves = write_once(docs.select(F.col(order).alias("__order"), tree_key.alias("tree"), leaf_digest({c: F.col(c) for c in fields}).alias("digest"),
                                    *(c.alias(f"also_{k}") for k, c in also.items())), "merkle-leaves")
    carried = tuple(f"also_{k}" for k in also)
    bands, roots = _grow(_numbered(leaves, ["__order", "digest"], "merkle-ranges"), high, "merkle-up")
    subroots = _numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"], "merkle-trees")
    top, root = _grow(subroots, high, "merkle-top-up")
    proofs = write_once(_sink(top, root.select("tree", F.lit("").alias("above"), F.lit(None).cast("string").alias("subroot")), high, "merkle-top-down", ("of", "digest"))
                        .select(F.col("of").alias("tree"), "above", F.col("digest").alias("subroot")), "merkle-subroots")
    found = root.first()
    out = _sink(bands, proofs, high, "merkle-down", ("__order", "digest", *carried))
    return out.select(F.col("__order").alias(order), *(F.col(f"also_{k}").alias(k) for k in also), F.col("digest").alias("leaf"), "subroot",
                      F.lit(found["digest"] if found else None).cast("string").alias("root"),
                      F.when(F.col("above") == "", F.array().cast("array<string>")).otherwise(F.split("above", ",")).alias("proof"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = {c: F.col(c) for c in FIELDS} | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(changed))
    out = merkle_manifest(docs, also={"tampered": tampered})
    siblings = F.array_join(F.transform("proof", lambda s: F.replace(s, F.lit("+"), F.lit(""))), "")
    return (out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
            .select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def _told(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


#: Whole levels at a time; every leaf's path follows the levels of its tree, then those of the top tree.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
marked AS (SELECT documents.*, doc_id IS NOT NULL AND {crc32_sql("encode(doc_id::VARCHAR)")} % 7 = 0 AS hit FROM documents, crc),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({' || '.join(_told(c) for c in FIELDS)}) AS leaf,
    CASE WHEN hit THEN sha256({' || '.join(_told('(n_chars + 1)' if c == 'n_chars' else c) for c in FIELDS)}) END AS tampered FROM marked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (
  SELECT tree, 0 AS level, idx, n AS left_over, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, (left_over + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE left_over > 1 GROUP BY tree, level, idx // 2, left_over),
subroots AS (
  SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE left_over = 1),
high AS (
  SELECT 0 AS level, idx, n AS left_over, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (left_over + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE left_over > 1 GROUP BY level, idx // 2, left_over),
top AS (SELECT digest AS root, level AS height FROM high WHERE left_over = 1),
nodes AS (SELECT tree, level, idx, digest FROM low UNION ALL SELECT '*', level, idx, digest FROM high),
walk AS (
  SELECT p.doc_id, p.leaf, s.subroot, s.tree AS own, s.idx AS place, s.height AS low_height, top.root, top.height AS high_height,
    p.tree AS tree, 0 AS level, p.idx AS idx, coalesce(p.tampered, p.leaf) AS folded, '' AS siblings, p.idx AS leaf_idx
  FROM placed p JOIN subroots s USING (tree), top
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.own, w.place, w.low_height, w.root, w.high_height,
    CASE WHEN w.tree <> '*' AND w.level + 1 >= w.low_height THEN '*' ELSE w.tree END,
    CASE WHEN w.tree <> '*' AND w.level + 1 >= w.low_height THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.tree <> '*' AND w.level + 1 >= w.low_height THEN w.place ELSE w.idx // 2 END,
    CASE WHEN w.tree <> '*' AND w.low_height = 0 THEN w.folded
         WHEN s.digest IS NULL THEN sha256(w.folded) WHEN w.idx % 2 = 0 THEN sha256(w.folded || s.digest) ELSE sha256(s.digest || w.folded) END,
    w.siblings || coalesce(s.digest, ''), w.leaf_idx
  FROM walk w LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.idx = xor(w.idx, 1) AND (w.tree = '*' OR w.low_height > 0)
  WHERE w.tree <> '*' OR w.level < w.high_height)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk WHERE tree = '*' AND level = high_height
"""

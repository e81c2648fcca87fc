"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, ``CENTROIDS`` centroids
each, so a vector lies in one of ``CENTROIDS`` squared cells. A query visits
cells in the order of their summed nearness (inner products of its halves with
the cell's two centroids), drawn one by one from a heap over the two sorted
lists, until the cells hold the ``visit`` share of the index. The vectors found
are scored exactly in double precision.

The quantisers are fitted on ``SAMPLE`` vectors; every vector is indexed. Cells
with the same first centroid form a group; a group is split into blocks of about
``BLOCK`` vectors by hash, so a value that a third of all rows share fills many
blocks, and a task holds a block and some queries. Each returns a query's best
``k`` of its block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollspark.llm.common import table, widened, write_once

CENTROIDS, SAMPLE, BLOCK, QUERIES = 32, 10_000, 8192, 8192


def usable(vector: str):
    """Not null, no null, NaN or infinite component, not all zero."""
    v = F.col(vector)
    inf = float("inf")
    return (v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0))


def centroids(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from points spread over the sample."""
    points = np.unique(points, axis=0)
    c = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        a = nearest(points, c)
        for i in np.unique(a):
            c[i] = points[a == i].mean(axis=0)
    return c


def nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * points @ c.T).argmin(axis=1)


def matrix(column) -> np.ndarray:
    """An Arrow list column without nulls as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def visited(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells by falling ``first[i] + second[j]`` until they hold ``enough`` vectors; empty cells are passed over."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b, held = a.tolist(), b.tolist(), held.tolist()
    heap, out, got = [(-x[0] - y[0], 0, 0)], [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        n = held[a[i]][b[j]]
        if n:
            out.append((a[i], b[j]))
            got += n
        if j + 1 < len(y):
            heapq.heappush(heap, (-x[i] - y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-x[i + 1] - y[0], i + 1, 0))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           visit: float = 0.6) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` nearest of those visited, its own id left out.

    Nearness is the inner product; ties go to the smaller id. Vectors that are
    null, zero, or have a null or non-finite component take no part on either
    side, nor do null ids or vectors of another length than most; repeated
    rows of one id are all candidates for others. Fewer candidates than ``k``
    give fewer rows. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(usable("v") & F.col("vec_id").isNotNull())
    asked = queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(usable("v") & F.col("vec_id").isNotNull())
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, rows = sizes["d"], sizes["count"]
    good, asked = good.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    h = max(1, dim // 2)
    sample = matrix(good.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow()["v"])
    c1 = centroids(sample[:, :h], CENTROIDS)
    c2 = centroids(sample[:, h:], CENTROIDS) if dim > 1 else np.zeros((1, 0))

    def quantise(batches):
        for b in batches:
            m = matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(m[:, :h], c1), pa.int32()), pa.array(nearest(m[:, h:], c2), pa.int32())],
                                             ["vec_id", "v", "i", "j"])

    index = write_once(good.mapInArrow(quantise, widened(good.schema, i="int", j="int")), "index")
    held = np.zeros((len(c1), len(c2)), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # CENTROIDS squared rows at most
        held[r["i"], r["j"]] = r["count"]
    blocks = np.maximum(1, -(-held.sum(axis=1) // BLOCK))
    enough = max(int(np.ceil(visit * rows)), 10 * k)
    parts = max(1, -(-asked.count() // QUERIES))

    def traverse(batches):
        for b in batches:
            m = matrix(b.column(1))
            u, w = m[:, :h] @ c1.T, m[:, h:] @ c2.T
            take, i_of, b_of, cells = [], [], [], []
            for q in range(len(m)):
                by_first: dict[int, list[int]] = {}
                for i, j in visited(u[q], w[q], held, enough):
                    by_first.setdefault(i, []).append(j)
                for i, js in by_first.items():
                    for n in range(blocks[i]):
                        take.append(q)
                        i_of.append(i)
                        b_of.append(n)
                        cells.append(js)
            t = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(t), b.column(1).take(t), pa.array(i_of, pa.int32()), pa.array(b_of, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                ["vec_id", "v", "i", "b", "cells"])

    probes = (asked.mapInArrow(traverse, widened(asked.schema, i="int", b="int", cells="array<int>"))
              .withColumn("p", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")))
    per_first = F.array(*[F.lit(int(x)) for x in blocks])
    placed = (index.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.element_at(per_first, F.col("i") + 1)).cast("int"))
              .withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(left) and len(right):
            ids, order = right["vec_id"].to_numpy(), np.argsort(right["vec_id"].to_numpy(), kind="stable")
            ids, vs, js = ids[order], matrix(right["v"])[order], right["j"].to_numpy()[order]
            q_ids, qs, cells = left["vec_id"].to_numpy(), matrix(left["v"]), left["cells"].to_pylist()
            for s in range(0, len(qs), 256):
                near = qs[s:s + 256] @ vs.T
                for n, row in enumerate(near):
                    allowed = np.zeros(CENTROIDS, bool)
                    allowed[cells[s + n]] = True
                    at = np.flatnonzero(allowed[js] & (ids != q_ids[s + n]))
                    if len(at) > k:  # those that may tie with the k-th are all scored exactly
                        x = row[at]
                        at = at[x >= np.partition(x, len(x) - k)[len(x) - k] - 1e-9 * max(1.0, float(np.abs(x).max()))]
                    exact = (vs[at] * qs[s + n]).sum(axis=1)
                    best = np.lexsort((ids[at], -exact))[:k]
                    out[0].append(np.full(len(best), q_ids[s + n]))
                    out[1].append(ids[at][best])
                    out[2].append(exact[best])
        cat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "vec_id": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(np.float64))})

    tops = (probes.groupBy("i", "b", "p").cogroup(placed.groupBy("i", "b", "p"))
            .applyInArrow(score, "query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))

"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt to blocks of bounded size and every pair of a query
block and a candidate block is one group.  Inside, vectors are quantised to int8 with
a scale and the exact norm of the rounding error.  The product of an int8 tile gives a
distance, and the two error norms bound how far it can be off (triangle inequality),
so only pairs whose lower bound may still beat a query's k-th best survive; those are
recomputed from the original vectors in double precision and kept in a heap for each
query.  The heaps of the blocks are merged in rounds of ``FAN``.  As the bounds are
strict, the neighbours found are the true ones.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite
component take no part, nor do rows without an id; of rows that repeat an id the one
with the smallest vector counts; only vectors of a query's own length are compared
with it; ties go to the smaller id; a query's own id is never its neighbour; other
columns don't take part.  Empty tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import table

#: Most rows of a query block, of a candidate block and of a tile of candidates; heaps merged at once.
QUERY_BLOCK, BLOCK, TILE, FAN = 2048, 8192, 1024, 32
#: int8 products of this many components are exact sums in single precision.
EXACT = 1024
#: What squares that underflow may add to a distance between vectors of components up to 1.
LEAST = 1e-150
FOUND = "qblock int, cblock int, query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the norms of what the codes leave out, by row."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).astype("i1")
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        total += a[:, at : at + EXACT].astype("f4") @ b[:, at : at + EXACT].astype("f4").T
    return total


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed from the first component to the last.

    Where squares would leave the range of doubles, a row is scaled by a power of two,
    which is exact, and its distance scaled back.
    """
    apart = x - y
    exponent = np.frexp(np.abs(apart).max(axis=1))[1]
    exponent[np.abs(exponent) < 400] = 0
    apart = np.ldexp(apart, -exponent[:, None])
    return np.ldexp(np.sqrt(np.cumsum(apart**2, axis=1)[:, -1]), exponent)


def rows_of(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    group = group.sort_values("id")
    return group["id"].to_numpy("i8"), np.stack(group["vector"].to_numpy()).astype("f8")


def best_of_blocks(k: int):
    def run(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"qblock": [], "cblock": [], "query_id": [], "vec_id": [], "score": []})
        with np.errstate(over="ignore", invalid="ignore"):
            return best(key, *rows_of(q), *rows_of(c), k)

    return run


def best(key: tuple, qid: np.ndarray, whole_q: np.ndarray, cid: np.ndarray, whole_c: np.ndarray, k: int) -> pd.DataFrame:
    # bounds are found on vectors scaled by a power of two, so that no square overflows
    scaling = int(np.frexp(max(np.abs(whole_q).max(), np.abs(whole_c).max()))[1])
    q, c = np.ldexp(whole_q, -scaling), np.ldexp(whole_c, -scaling)
    qcode, qscale, qerr = quantised(q)
    qnorm = np.sqrt((q**2).sum(axis=1))
    qsize = (qcode.astype("f8") ** 2).sum(axis=1) * qscale**2
    heaps: list[list] = [[] for _ in qid]
    kth = np.full(len(qid), np.inf)
    for at in range(0, len(cid), TILE):
        ids, tile = cid[at : at + TILE], c[at : at + TILE]
        code, scale, err = quantised(tile)
        size = (code.astype("f8") ** 2).sum(axis=1) * scale**2
        off = LEAST + qerr[:, None] + err + 1e-7 * (qnorm[:, None] + np.sqrt((tile**2).sum(axis=1)))
        seen = np.sqrt(np.maximum(qsize[:, None] + size - 2 * qscale[:, None] * scale * products(qcode, code), 0))
        upper = seen + off
        lower = np.maximum(seen - off, 0)
        own = qid[:, None] == ids
        upper[own] = lower[own] = np.inf
        reach = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(qid), np.inf)
        rows, cols = np.nonzero((lower <= reach[:, None]) & (lower <= kth[:, None]) & ~own)
        for part in range(0, len(rows), 65536):
            r, s = rows[part : part + 65536], cols[part : part + 65536]
            for i, j, d in zip(r.tolist(), ids[s].tolist(), distances(whole_c[at + s], whole_q[r]).tolist(), strict=True):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -j))
                elif (-d, -j) > heap[0]:
                    heapq.heapreplace(heap, (-d, -j))
        for i, heap in enumerate(heaps):
            if len(heap) == k:
                kth[i] = np.ldexp(-heap[0][0], -scaling)
    found = [(key[0], key[1], i, -j, -d) for i, heap in zip(qid.tolist(), heaps, strict=True) for d, j in heap]
    return pd.DataFrame(found, columns=["qblock", "cblock", "query_id", "vec_id", "score"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, of one group of blocks."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[int, list] = {}
        for i, j, d in zip(group["query_id"].tolist(), group["vec_id"].tolist(), group["score"].tolist(), strict=True):
            heaps.setdefault(i, []).append((d, j))
        out = [(*key, i, j, d) for i, rows in heaps.items() for d, j in heapq.nsmallest(k, rows)]
        return pd.DataFrame(out, columns=["qblock", "cblock", "query_id", "vec_id", "score"])

    return found.groupBy("qblock", "cblock").applyInPandas(run, FOUND)


def one_of_each(rows: DataFrame) -> DataFrame:
    """Rows of (id, vector, dim) with one vector for each id, the smallest: the least in the first component that differs, or the shorter one."""
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest candidates by Euclidean distance.

    Both inputs have (vec_id, embedding); a query is compared with every candidate
    that hasn't its id.
    """
    clean = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.size("embedding").alias("dim")
    )
    q, c = (one_of_each(clean(df)) for df in (queries, candidates))
    qblocks = max(1, -(-q.count() // QUERY_BLOCK))
    cblocks = max(1, -(-c.count() // BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qblock", deal(qblocks)).withColumn("cblock", every(cblocks))
    c = c.withColumn("cblock", deal(cblocks)).withColumn("qblock", every(qblocks))
    by = ("qblock", "cblock", "dim")
    found = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(best_of_blocks(k), FOUND)
    blocks = cblocks
    while True:
        blocks = -(-blocks // FAN)
        found = merged(found.withColumn("cblock", (F.col("cblock") / FAN).cast("int")), k)
        if blocks <= 1:
            break

    def ranked(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["query_id", "score", "vec_id"])
        return group.assign(rank=group.groupby("query_id").cumcount() + 1)[["query_id", "rank", "vec_id", "score"]]

    return found.groupBy("qblock").applyInPandas(ranked, "query_id long, rank int, vec_id long, score double")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all ``embeddings`` for each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.where("vec_id % 100 = 0"), vectors, 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, 
         sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
WHERE rank <= 10
"""

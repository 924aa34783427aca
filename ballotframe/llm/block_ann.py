"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, exact scores for what survives.

Vectors are quantised to int8 with a scale each. Candidates and queries are dealt to blocks by a hash; a tile is one
block of queries against one block of candidates, and each tile is a task's matrix product. With x = x' + e and
y = y' + f, where x' and y' are the quantised vectors,

    |x.y - x'.y'| <= |e| |y| + |x'| |f|

so the product of the int8 codes bounds each inner product from both sides. In a tile a query keeps the candidates whose
upper bound reaches its k-th largest lower bound; their inner products are computed again in double precision, and a heap
keeps the best k. What tiles find for a query is merged the same way. The result is exact.

Each candidate is sent once for each block of queries and each query once for each block of candidates; blocks are as
large as tasks' memory permits.

Vectors that are null, zero or hold null or non-finite components take no part. Shorter vectors count as if zeros
followed. Rows with a null id take no part; rows of one id count as one, the smallest vector by order of arrays.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BlockParams:
    """``k``: neighbours; rows of a block of candidates and of queries; ``rows_at_once``: queries of one product."""

    k: int = 20
    candidate_rows: int = 8_192
    query_rows: int = 8_192
    rows_at_once: int = 128


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one row for each id whose vector takes part, components as doubles."""
    v = F.col("embedding").cast("array<double>")
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(~broken & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, the norms of the quantised vectors and of what is lost."""
    scale = np.maximum(np.abs(x).max(1), np.finfo(float).tiny) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 codes multiplied; sums of up to 1024 products are exact in float32."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of one query and some candidates, summed in the order of the components."""
    total = np.zeros(len(c))
    for k in range(len(q)):
        total += q[k] * c[:, k]
    return total


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k largest scores, smaller ids first among equals."""
    return heapq.nsmallest(k, zip((-scores).tolist(), ids.tolist(), strict=True))


def search_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, p: BlockParams) -> Iterator[tuple[int, int, float]]:
    """(query, candidate, score): for each query its k nearest in the tile, itself left out."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    c_codes, c_scale, c_norm, c_lost = quantise(c)
    c_full = np.linalg.norm(c, axis=1)
    q_codes, q_scale, q_norm, q_lost = quantise(q)
    for a in range(0, len(q), p.rows_at_once):
        s = slice(a, a + p.rows_at_once)
        near = product(q_codes[s], c_codes) * q_scale[s, None] * c_scale
        slack = q_lost[s, None] * c_full + q_norm[s, None] * c_lost
        slack += 1e-9 * (np.abs(near) + slack) + 1e-300  # rounding of the bounds themselves
        own = np.searchsorted(c_ids, q_ids[s])
        own_here = (own < len(c_ids)) & (c_ids[np.minimum(own, len(c_ids) - 1)] == q_ids[s])
        rows = np.flatnonzero(own_here)
        near[rows, own[rows]] = -np.inf
        low = near - slack
        high = near + slack
        k = min(p.k, len(c_ids))
        floor = np.partition(low, len(c_ids) - k, axis=1)[:, len(c_ids) - k]
        for i in range(len(near)):
            kept = np.flatnonzero((high[i] >= floor[i]) & (near[i] > -np.inf))
            for negative, vec in best_of(exact(q[a + i], c[kept]), c_ids[kept], p.k):
                yield int(q_ids[a + i]), vec, -negative


def nearest(vectors: DataFrame, is_query, params: BlockParams | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score). ``is_query``: a condition on vec_id."""
    p = params or BlockParams()
    rows = usable(vectors)
    n, asked = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    c_blocks, q_blocks = max(1, -(-n // p.candidate_rows)), max(1, -(-asked // p.query_rows))
    block = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select(block(c_blocks).alias("cb"), every(q_blocks).alias("qb"), "vec_id", "v")
    queries = rows.where(is_query).select(every(c_blocks).alias("cb"), block(q_blocks).alias("qb"), "vec_id", "v")

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            width = max(map(len, [*q["v"], *c["v"]]))
            sides = [(x["vec_id"].to_numpy(), matrix(list(x["v"]), width)) for x in (q, c)]
            found = list(search_tile(*sides[0], *sides[1], p))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    tiles = queries.groupBy("cb", "qb").cogroup(candidates.groupBy("cb", "qb"))
    found = tiles.applyInPandas(tile, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH flags AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), rows AS (
  SELECT vec_id, v FROM flags
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

"""Approximate nearest neighbours by collision-counting hashing.

Vectors are projected on random lines, and each line keeps its projections as a sorted array. A query opens a window
centred at its own projection on each line; the vectors between the ends of the windows collide with it there and are
counted. Windows widen by a constant factor (virtual rehashing), each time counting only what they newly reach, until
enough vectors have collided on at least a threshold share of the lines; those are verified by the exact inner product.
Largest inner product becomes nearest distance by the usual extra coordinate (norms filled up to the largest; queries
scaled to one); an index only holds vectors whose norms lie within a factor of two, so that none drowns the others.

Arrays are those of a block of vectors, and queries come in blocks, each pair of them being one group: the stated query
set against all rows. Arrays over the whole table would have to send what they count as rows, and windows of the recall
asked for span over half of each line on vectors without clusters (see the README). A group is bounded, an index is
built once for thousands of queries, and the best of the blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, staged

NEAREST = 20
EVERY = 20
LINES = 128
#: First half width of a window, in units of the distance between unit vectors; it grows by WIDEN.
HALF_WIDTH = 1.1
WIDEN = 1.08
#: A vector is verified if it collides on this share of the lines.
THRESHOLD = 0.61
#: Windows widen until this share of an index's vectors reach the threshold, and at least so many.
ENOUGH, AT_LEAST = 0.1, 40 * NEAREST
#: Fewer vectors of like norms than this have no index of their own: all of them are verified.
LEAST_INDEXED = 64
VECTORS_A_BLOCK = 8192
QUERIES_A_BLOCK = 4096
#: Queries whose counts are held at a time.
QUERIES_A_STEP = 128
SEED = 20


def lines(dim: int, n: int = LINES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, dim + 1))


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products in double precision, summed from the first component to the last for every row alike."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.add.accumulate(vectors * query, axis=1)[:, -1]


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the binary logarithms of the norms; neither overflows, as rows are first scaled by their largest component."""
    most = np.abs(vectors).max(axis=1)
    unit = np.ldexp(vectors, -np.frexp(most)[1][:, None])
    norm = np.sqrt((unit**2).sum(axis=1))
    return unit / norm[:, None], np.log2(norm) + np.frexp(most)[1]


class Index:
    """Sorted arrays of the projections of vectors of like norms."""

    def __init__(self, unit: np.ndarray, size: np.ndarray) -> None:
        ratio = np.exp2(size - size.max())
        self.axes = lines(unit.shape[1])
        projected = self.axes @ np.concatenate([unit * ratio[:, None], np.sqrt(np.maximum(0.0, 1 - ratio**2))[:, None]], axis=1).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted, self.order = np.take_along_axis(projected, order, axis=1), order.astype(np.uint16)

    def _window(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Ends [query, line] of the windows of half width half centred at at [query, line]."""
        lo = [np.searchsorted(s, a - half) for s, a in zip(self.sorted, at.T, strict=True)]
        hi = [np.searchsorted(s, a + half, side="right") for s, a in zip(self.sorted, at.T, strict=True)]
        return np.stack(lo, axis=1), np.stack(hi, axis=1)

    def candidates(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        """For each query (a unit vector) the vectors that collide with it on enough lines, windows having widened as far as needed."""
        n = self.order.shape[1]
        wanted, least = min(n, max(AT_LEAST, ENOUGH * n)), np.ceil(THRESHOLD * len(self.order))
        for begin in range(0, len(unit), QUERIES_A_STEP):
            at = unit[begin : begin + QUERIES_A_STEP] @ self.axes[:, :-1].T
            counts = np.zeros((len(at), n), np.int16)
            lo, _ = self._window(at, 0.0)
            hi = lo.copy()
            found: list = [None] * len(at)
            left, half = np.arange(len(at)), HALF_WIDTH
            while len(left):
                new_lo, new_hi = self._window(at[left], half)
                for q, a, b, c, d in zip(left.tolist(), new_lo.tolist(), lo[left].tolist(), hi[left].tolist(), new_hi.tolist(), strict=True):
                    if half == HALF_WIDTH and 2 * (sum(d) - sum(a)) > n * len(a):  # a first window over more than half: count what it leaves out
                        missed = np.concatenate([x for row, i, m in zip(self.order, a, d, strict=True) for x in (row[:i], row[m:])])
                        counts[q] = len(a) - np.bincount(missed, minlength=n)
                    else:
                        reached = np.concatenate([x for row, i, j, k, m in zip(self.order, a, b, c, d, strict=True) for x in (row[i:j], row[k:m])])
                        counts[q] += np.bincount(reached, minlength=n).astype(np.int16)
                    close = np.flatnonzero(counts[q] >= least)
                    if len(close) >= wanted or (sum(a) == 0 and min(d) == n):
                        found[q] = close
                lo[left], hi[left] = new_lo, new_hi
                left, half = np.array([q for q in left.tolist() if found[q] is None], np.int64), half * WIDEN
            yield from found


def search(ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, k: int = NEAREST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of a query, ids, scores) of the best k found of all rows but the query's own, ties to smaller ids."""
    unit, size = directions(vectors)
    asked = directions(queries)[0]
    # Norms about 1, the usual ones, fall into one tier.
    most, tier = np.abs(vectors).max(), np.floor(size + 0.5)
    parts = [np.flatnonzero(tier == t) for t in np.unique(tier)]
    loose = np.concatenate([np.empty(0, np.int64), *(p for p in parts if len(p) < LEAST_INDEXED)])
    parts = [p for p in parts if len(p) >= LEAST_INDEXED]
    streams = [Index(unit[p], size[p]).candidates(asked) for p in parts]
    for q in range(len(queries)):
        found = np.concatenate([loose, *(p[next(s)] for p, s in zip(parts, streams, strict=True))])
        found = found[(ids[found] != query_ids[q]) | (keys[found] != query_keys[q])]
        with np.errstate(over="ignore", invalid="ignore"):
            near = vectors[found] @ queries[q]
            slack = 1e-9 * np.abs(queries[q]).max() * most
        if len(found) > k and np.isfinite(near).all() and np.isfinite(slack):  # the exact order is taken of what can be among the best
            found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - slack]
        score = inner_products(vectors[found], queries[q])
        best = np.lexsort((ids[found], -np.where(np.isnan(score), -np.inf, score)))[:k]
        yield q, ids[found][best], score[best]


def _search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    if len(vectors) and len(queries):
        # Vectors of several lengths can't be compared; each length is a table of its own.
        for dim, part in vectors.groupby(vectors["embedding"].map(len)):
            asked = queries[queries["query"].map(len) == dim]
            if len(asked):
                a, b = asked["query_id"].to_numpy(), asked["query_key"].to_numpy()
                for q, ids, scores in search(part["vec_id"].to_numpy(), part["key"].to_numpy(), np.stack(part["embedding"].to_list()), a, b, np.stack(asked["query"].to_list())):
                    out += zip([a[q]] * len(ids), [b[q]] * len(ids), ids.tolist(), scores.tolist(), strict=True)
    return pd.DataFrame(out, columns=["query_id", "query_key", "vec_id", "score"])


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by every, its k nearest of all others.

    Nearness is the largest inner product in double precision, ties to the smaller vec_id; a score that is not a number
    (an overflow in both directions) comes last. Rows with a null id, or a null, empty or zero vector, or one with null
    or non-finite components, take no part. Rows that share a vec_id are rows of their own, as candidates and queries;
    only rows that repeat in both id and vector are one row. If there are fewer than k others, all that are found come
    back. An empty table gives an empty one; extra columns are ignored.
    """
    rows = columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    good = staged(good.withColumn("key", F.xxhash64("embedding")).groupBy("vec_id", "key").agg(F.first("embedding").alias("embedding")))
    asked = good.where(F.col("vec_id") % every == 0).toDF("query_id", "query_key", "query")
    n, m = good.count(), asked.count()
    blocks, asks = max(1, -(-n // VECTORS_A_BLOCK)), max(1, -(-m // QUERIES_A_BLOCK))
    left = good.withColumn("b", F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = asked.withColumn("a", F.pmod(F.xxhash64("query_id", "query_key", F.lit(1)), F.lit(asks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("b", "a").cogroup(right.groupBy("b", "a")).applyInPandas(_search, "query_id long, query_key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score")).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

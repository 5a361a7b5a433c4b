"""Nearest neighbours by inner product with collision-counting hashing.

Largest inner product becomes least distance: every vector is scaled by the largest norm and given
one more component that fills it up to length one; a query is scaled to length one and given 0. Each
of PROJECTIONS random lines gets one sorted array per block of vectors. A query looks at a window
around its own projection in each array; the windows grow together by a fixed factor (virtual
rehashing: one set of arrays serves every radius) from their last bounds on, so each entry is counted
once, and a vector that has been in at least THRESHOLD of them is verified by its exact inner product. A query's search in a block ends when its k-th best
vector lies within the radius, for every vector as near collides that often with high probability,
or when all are verified.

Rows are dealt into blocks of vectors and of queries by hash, so each task sees one block of each,
of bounded size; nothing is drawn together but the k best of each query per block. Where queries are a
fixed share of all rows, as in the query of the contract, the work grows with the square of the rows:
at a radius that holds the k best, each window already covers a large part of its array.

Defined results: an empty table gives no rows; other columns, whatever their names, are not read; vectors that are null, empty, zero, or hold a null or non-finite component, or
whose length is not the most frequent one, take no part; rows that repeat an id are rows of their
own, and none of them is a candidate of a query of that id; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Random lines, and collisions that make a vector a candidate. A vector at distance R falls into a window of half-width
#: R around the query with probability 0.683, so of 96 windows into 65.6 with a standard deviation of 4.6.
PROJECTIONS, THRESHOLD = 96, 59
#: Factor by which windows grow.
GROWTH = 1.05
#: One in so many vectors helps to guess a first radius.
STRIDE = 8
#: Vectors and queries in a block.
BLOCK, QUERIES = 16_384, 2_048
FOUND = "query_id long, vec_id long, score double"


def usable(v: Column) -> Column:
    """Whether a vector takes part, its length aside."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def lines(d: int) -> np.ndarray:
    """The projections; every task makes the same."""
    return np.random.default_rng(11).standard_normal((d, PROJECTIONS)).astype(np.float32)


def matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


class Arrays:
    """The sorted arrays of one block of vectors."""

    def __init__(self, x: np.ndarray, largest: float):
        self.x, self.largest, scaled = x, largest, x / largest
        self.full = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1, keepdims=True)))])
        self.lines = lines(self.full.shape[1])
        h = (self.full.astype(np.float32) @ self.lines).T
        order = np.argsort(h, axis=1, kind="stable")
        narrow = np.uint16 if len(x) < 1 << 16 else np.uint32
        self.sorted, self.order = np.take_along_axis(h, order, 1), order.astype(narrow)
        self.place = np.empty(h.shape, narrow)  # of each vector in each sorted array
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(len(x), dtype=narrow), h.shape), 1)
        # every STRIDE-th vector, to guess a first radius from
        self.some = np.arange(0, len(x), STRIDE)

    def bounds(self, at: np.ndarray, radius: float) -> np.ndarray:
        """First place and end of the window of that radius in each sorted array."""
        edges = np.stack([at - radius, at + radius], 1).astype(np.float32)
        return np.array([s.searchsorted(e) for s, e in zip(self.sorted, edges, strict=True)])

    def count(self, bounds: np.ndarray) -> np.ndarray:
        """In how many first windows each vector lies: each array's places are compared at once, for such windows hold much of it."""
        counts, held, inside = (np.zeros(len(self.x), t) for t in (np.uint8, self.place.dtype, bool))
        for place, (low, high) in zip(self.place, bounds.astype(self.place.dtype), strict=True):
            np.subtract(place, low, out=held)  # wraps around below the window
            np.less(held, high - low, out=inside)
            np.add(counts, inside.view(np.uint8), out=counts)
        return counts

    def grow(self, counts: np.ndarray, bounds: np.ndarray, wider: np.ndarray) -> None:
        """Add to ``counts`` what windows take in on either side when they grow from ``bounds`` to ``wider``."""
        taken = [x for order, (low, high), (a, b) in zip(self.order, bounds.tolist(), wider.tolist(), strict=True) for x in (order[a:low], order[high:b])]
        counts += np.bincount(np.concatenate(taken), minlength=len(counts)).astype(np.uint8)

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the verified vectors that may be among the k best; ``own`` marks the query's own rows."""
        unit = np.append(q / np.sqrt(q @ q), 0.0)
        at = unit.astype(np.float32) @ self.lines
        open_, scores = ~own, np.full(len(self.x), -np.inf)
        some = self.some[open_[self.some]]
        # the best k / STRIDE of some vectors are about as near as the best k of all
        near = np.sort(2 - 2 * (self.full[some] @ unit))[: k // STRIDE + 1] if len(some) else np.ones(1)
        radius = max(1e-3, float(np.sqrt(max(0.0, near[-1]))))
        bounds = self.bounds(at, radius)
        counts = self.count(bounds)
        while True:
            new = np.flatnonzero((counts >= THRESHOLD) & open_)
            open_[new] = False
            scores[new] = (self.x[new] * q).sum(1)
            done = np.flatnonzero(scores > -np.inf)
            if len(done) >= k:
                kth = np.partition(scores[done], len(done) - k)[len(done) - k]
                # distance of unit query and filled-up vector whose inner product with the query is kth
                reach = np.sqrt(max(0.0, 2 - 2 * kth / (np.sqrt(q @ q) * self.largest)))
                if reach <= radius:
                    return done[scores[done] >= kth], scores[done[scores[done] >= kth]]
            if not open_.any():
                return done, scores[done]
            radius *= GROWTH
            wider = self.bounds(at, radius)
            self.grow(counts, bounds, wider)
            bounds = wider


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product for each row where ``queries`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.max(norm).alias("largest")).orderBy(F.desc("n"), "d").limit(1).collect()
    d, n, asks, largest = sizes[0] if sizes else (0, 0, 0, 1.0)
    rows = rows.filter(F.size("v") == d)
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-asks // QUERIES))
    deal = lambda count, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = rows.select("id", "v", deal(blocks, 1).alias("block"), every(parts).alias("part"))
    asked = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", deal(parts, 2).alias("part"), every(blocks).alias("block"))

    def search(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids = own["id"].to_numpy()
        arrays = Arrays(matrix(own["v"]), largest)
        out = []
        for query, q in zip(ask["id"].to_numpy(), matrix(ask["v"]), strict=True):
            at, score = arrays.search(q, ids == query, k)
            best = np.lexsort((ids[at], -score))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[best]], "score": score[best]}))
        return pd.concat(out)

    found = data.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

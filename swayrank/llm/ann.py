"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are cut into blocks, and so are queries where there are very many; each pair of blocks is one group of a task, so a block of
vectors moves and is indexed once for each block of queries. A block is indexed by
`projections` random directions, each a sorted array of the vectors' projections. For a query, every array is
entered at the query's own projection and a window around it is widened step by step (virtual rehashing: the
window for radius R is the one for radius 1 scaled by R, so nothing is rehashed). A vector seen in at least
`threshold` of the windows collides often enough to be verified by its true distance. Widening stops when the k-th
verified distance is within the radius, since nearer vectors would have collided by then with a known probability.

Each block of vectors gives its k nearest for each query; the k best over all blocks are kept, so the answer does
not depend on how many blocks there are in any other way than that more blocks verify more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swayrank.session import freeze

K = 10
PROJECTIONS = 128
HALF_WIDTH = 1.1  # of a window at radius 1; a vector at distance 1 falls in with probability 0.73
THRESHOLD = 0.69  # share of the windows a vector must be in to be verified
GROWTH = 1.4  # from one radius to the next
VECTOR_BLOCK = 32_768
QUERY_BLOCK = 32_768
SEED = 20_011
FIRST_SHARE = 0.02  # of a block, in the first windows


def lengths(gaps: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        found = np.sqrt((gaps * gaps).sum(axis=1))
    odd = np.flatnonzero(~np.isfinite(found) | (found < 1e-140))
    if len(odd):
        most = np.abs(gaps[odd]).max(axis=1)
        safe = np.where(most > 0, most, 1.0)
        found[odd] = most * np.sqrt(((gaps[odd] / safe[:, None]) ** 2).sum(axis=1))
    return found


def scale_of(*parts: np.ndarray) -> float:
    """A power of two that brings vectors whose projections would leave the range of doubles into it; dividing by it is exact."""
    most = max(float(np.abs(p).max()) for p in parts)
    return 1.0 if 1e-100 < most < 1e100 else 2.0 ** np.floor(np.log2(most))


class SortedProjections:
    """The index of one block."""

    def __init__(self, vectors: np.ndarray, projections: int, half_width: float, seed: int):
        dimension = vectors.shape[1]
        self.vectors = vectors
        self.directions = np.random.default_rng(seed).standard_normal((dimension, projections))
        values = np.ascontiguousarray((vectors @ self.directions).T)
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.half_width, self.start = half_width, self.first_radius(half_width)

    def first_radius(self, half_width: float) -> float:
        """The radius whose windows hold about `FIRST_SHARE` of the block where it is densest.

        Starting there instead of near 0 can only verify more.
        """
        low, high = np.quantile(self.values, [0.5 - FIRST_SHARE, 0.5 + FIRST_SHARE], axis=1)
        return max(float(np.median(high - low)) / (4 * half_width), 1e-12)

    def search(
        self, query: np.ndarray, k: int, own: np.ndarray, threshold: float, growth: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of vectors verified for `query`; the rows `own` take no part."""
        count, arrays = len(self.vectors), len(self.values)
        centres = query @ self.directions
        needed = int(np.ceil(threshold * arrays))
        hits = np.zeros(count, np.int64)
        verified = np.zeros(count, bool)
        verified[own] = True
        rows, distances = [], []
        low = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centres)])
        high = low.copy()
        wanted = min(k, count - len(own))
        best = np.empty(0)
        radius = self.start
        while wanted and (len(best) < wanted or best[wanted - 1] > radius):
            if len(best) >= wanted:
                # The answer cannot need a window beyond the k-th distance found so far.
                radius = min(radius * growth, max(radius, float(best[wanted - 1])))
            else:
                radius *= growth
            reach = self.half_width * radius
            fresh = []
            for j, (values, order) in enumerate(zip(self.values, self.order)):
                a, b = values.searchsorted(centres[j] - reach), values.searchsorted(centres[j] + reach, "right")
                if a < low[j]:
                    fresh.append(order[a : low[j]])
                    low[j] = a
                if b > high[j]:
                    fresh.append(order[high[j] : b])
                    high[j] = b
            if fresh:
                hits += np.bincount(np.concatenate(fresh), minlength=count)
            new = np.flatnonzero((hits >= needed) & ~verified)
            if len(new):
                verified[new] = True
                found = lengths(self.vectors[new] - query)
                rows.append(new)
                distances.append(found)
                best = np.sort(np.concatenate((best, found)))[:k]
        if not rows:
            return np.empty(0, np.int64), np.empty(0)
        return np.concatenate(rows), np.concatenate(distances)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part: an id, and a finite vector that is not zero."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & fine)
        .withColumn("dim", F.size("v"))
    )


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding",
    projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, threshold: float = THRESHOLD,
    growth: float = GROWTH, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found for each row of `queries`, by Euclidean distance.

    Candidates are all rows of `vectors` of the same dimension but those with the query's own id; all of them if
    there are fewer than `k`. Ties go to the smaller id. Distances are exact, in double precision, on the original
    vectors. Rows whose id or vector is null, and vectors that are empty, zero, or hold a null or a value that is
    not finite, take no part. Of query rows that share an id the one whose vector comes first asks; a repeated vector row
    counts once for each (id, vector). Other columns are ignored. An empty table on either side gives no rows.
    """
    base = freeze(usable(vectors, vec_id, embedding))
    if base.groupBy("vec_id", F.xxhash64("v").alias("h")).count().filter("count > 1").head(1):
        base = freeze(base.dropDuplicates(["vec_id", "v"]))  # before they meet in one block
    asked = usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = freeze(asked.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim")))
    block_count = lambda df, size: max(1, -(-df.count() // size))
    v_blocks, q_blocks = block_count(base, vector_block), block_count(asked, query_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select(
        "dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(v_blocks)).cast("int").alias("vb"), every(q_blocks).alias("qb"), "vec_id", "v"
    )
    right = asked.select(
        "dim", every(v_blocks).alias("vb"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb"), "query_id", "v"
    )

    def each(block: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(block) or not len(batch):
            return pd.DataFrame({c: np.empty(0, "int64" if c != "score" else "float64") for c in columns})
        ids = block["vec_id"].to_numpy(np.int64)
        held, asks = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (block, batch))
        scale = scale_of(held, asks)
        index = SortedProjections(held / scale, projections, half_width, seed)
        made = []
        for query_id, v in zip(batch["query_id"], asks / scale):
            rows, scores = index.search(v, k, np.flatnonzero(ids == query_id), threshold, growth)
            scores = scores * scale
            first = np.lexsort((ids[rows], scores))[:k]
            made.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows[first]], "score": scores[first]}))
        return pd.concat(made, ignore_index=True)

    keys = ["dim", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(each, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

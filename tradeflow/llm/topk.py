"""Exact top-k inner products from an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one index block, and queries that meet a block in one task.
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 2_048
#: Quantised impacts of a dimension.
LEVELS = 20
#: Shares of the segments after which rows that cannot win are sought, and the part of
#: a block that counts as few enough to be scored exactly.
CHECKS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0)
FEW = 4


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, for vectors that take part.

    Null ids, null vectors and those with null or non-finite components do not. Rows
    with the same id each take part as rows of their own: as candidates each is scored,
    and a query's rows share its id, so it meets none of them. A shorter vector counts as
    if zeros followed.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    good = F.forall(
        F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(good)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


class ImpactIndex:
    """Posting segments of one block: rows of a dimension with the same quantised value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.doubles = vectors.astype(np.float64)
        self.largest = int(np.abs(vectors).max(initial=0))
        dims, low, high, self.rows = [], [], [], []
        for j in range(vectors.shape[1]):
            column = vectors[:, j]
            order = np.argsort(column, kind="stable")
            ranked = column[order]
            width = max(1, -(-int(ranked[-1] - ranked[0] + 1) // LEVELS))
            cuts = np.flatnonzero(np.diff(ranked // width)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
                dims.append(j)
                low.append(ranked[a])
                high.append(ranked[b - 1])
                self.rows.append(order[a:b])
        self.dims, self.low, self.high = np.array(dims), np.array(low), np.array(high)
        self.first = np.flatnonzero(np.diff(self.dims, prepend=-1))

    def _exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products; as doubles where every sum is exact in them, which is faster."""
        most = int(np.abs(query).max(initial=0)) * self.largest * len(query)
        if most < 1 << 53:
            return (self.doubles[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ query

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score) of this block, ties to the smaller id.

        Every row begins with the least that any segment gives. Segments add what they
        give beyond that, largest first. What is still to come for a row is at most the
        largest addition left in each dimension and the width of its segments; rows that
        cannot reach the k-th sum so far even with that are out for good. Once few rows
        are left, or all segments are done, those left are scored exactly.
        """
        q = query[self.dims]
        least = np.where(q >= 0, q * self.low, q * self.high)
        most = np.where(q >= 0, q * self.high, q * self.low)
        floor = np.minimum.reduceat(least, self.first)
        gain = least - floor[self.dims]
        width = int(np.maximum.reduceat(most - least, self.first).sum())
        order = np.argsort(-gain, kind="stable")
        sums = np.zeros(len(self.ids), np.int64)
        own = self.ids == query_id
        sums[own] = -(1 << 62)
        k = min(k, len(sums) - int(own.sum()))
        if k <= 0:
            return []
        done, gains = 0, gain.tolist()
        for share in CHECKS:
            until = int(len(order) * share)
            for s in order[done:until].tolist():
                if gains[s]:
                    sums[self.rows[s]] += gains[s]
            done = until
            rest = np.zeros(len(self.first), np.int64)
            np.maximum.at(rest, self.dims[order[done:]], gain[order[done:]])
            kth = np.partition(sums, len(sums) - k)[len(sums) - k]
            possible = np.flatnonzero((sums + (int(rest.sum()) + width) >= kth) & ~own)
            if len(possible) <= max(8 * k, len(sums) // FEW):
                break
        scores = self._exact(possible, query)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return [(int(self.ids[possible[b]]), int(scores[b])) for b in best]


def _matrix(lists: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for k, values in enumerate(lists):
        out[k, : len(values)] = values
    return out


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for ids divisible by `every`, the k best other rows.

    Vectors are dealt into index blocks of bounded size and queries into blocks of
    bounded size; each pair of blocks is one group, whose task builds the index and
    returns k rows for each query. The work is queries times vectors; no group grows
    with the table, and nothing is broadcast. Sums are 64-bit: |scale * x| must stay
    below 2^25 for up to a thousand dimensions.
    """
    rows = quantised(vectors, id_col, vector_col)
    count = rows.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")
    ).first()
    blocks = max(1, -(-count["n"] // block_vectors))
    parts = max(1, -(-count["q"] // block_queries))
    spread = F.xxhash64("vec_id")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    held = rows.select(F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), each(parts).alias("part"), "vec_id", "v")
    asked = rows.filter(F.col("vec_id") % every == 0).select(
        each(blocks).alias("block"), F.pmod(spread, F.lit(parts)).cast("int").alias("part"), "vec_id", "v"
    )

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(block) and len(queries):
            width = max(1, *(max(map(len, frame["v"])) for frame in (block, queries)))
            index = ImpactIndex(block["vec_id"].to_numpy(), _matrix(block["v"], width))
            for query_id, query in zip(queries["vec_id"], _matrix(queries["v"], width), strict=True):
                found += [(query_id, i, score) for i, score in index.search(query_id, query, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = (
        held.groupBy("block", "part")
        .cogroup(asked.groupBy("block", "part"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by columnar branch and bound.

Vectors lie in vertical layout (a row per dimension).  Inner products are accumulated one block of dimensions
at a time; after each block the mass that remains in the dimensions to come (the product of both norms there)
bounds every candidate from above and below, candidates that cannot reach the k-th best are dropped, and the
survivors are compacted.  Scores are exact integers.

Queries meet candidates block by block: candidates are dealt to blocks by a hash of their id, queries likewise,
and a task works on one pair of blocks, so its memory is bounded by the two block sizes at any table size.
Each pair keeps its k best; the best of those are the answer.

Vectors that are null or hold a null, NaN or infinite component take no part.  Only vectors of one length are
compared.  A candidate with the query's own id is not its answer; equal scores go to the smaller id; rows that
repeat another vector under their own ids are candidates of their own.  Rows that repeat an id are one vector: of several
under one id the least takes part, by its quantised components from the first on, a shorter one before its extensions.
It is a query if one of the id's rows that take part is.  Scores outside the 64-bit range are
held at its ends.  Fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = 16  # dimensions accumulated between two prunings
QUERY_ROWS = 2048
CANDIDATE_ROWS = 8192
TOGETHER = 128  # queries whose first dimensions are accumulated in one product
EXACT = 2.0**53  # sums of integers below are exact in doubles


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null where the vector takes no part."""
    usable = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def remaining(vectors: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norm of each column over the dimensions from each edge on."""
    return np.sqrt(np.stack([np.square(vectors[e:]).sum(axis=0) for e in edges]))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        found = np.flatnonzero(scores >= least)
        return found[np.lexsort((ids[found], -scores[found]))[:k]]
    return np.lexsort((ids, -scores))


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query position, candidate position, score) of the k best candidates of each query.

    ``queries`` and ``vectors`` hold a column per vector.
    """
    dims = len(vectors)
    edges = [*range(0, dims, STEP), dims] if dims else [0, 0]
    rest_q, rest_x = remaining(queries, edges), remaining(vectors, edges)
    out: list[tuple[int, int, int]] = []
    for start in range(0, queries.shape[1], TOGETHER):
        first = queries[: edges[1], start : start + TOGETHER].T @ vectors[: edges[1]]
        for at, partial in enumerate(first, start):
            alive = np.flatnonzero(ids != query_ids[at])
            partial = partial[alive]
            for b in range(1, len(edges)):
                if b > 1:
                    partial = partial + queries[edges[b - 1] : edges[b], at] @ vectors[edges[b - 1] : edges[b], alive]
                if len(alive) > k and b < len(edges) - 1:
                    slack = rest_q[b, at] * rest_x[b, alive] * (1 + 1e-9) + 0.5
                    reached = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
                    stays = partial + slack >= reached
                    alive, partial = alive[stays], partial[stays]
            for c in best_of(partial, ids[alive], k):
                out.append((at, int(alive[c]), int(partial[c])))
    return out


def exact_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """As :func:`search_block`, in whole numbers of any size, for components beyond what doubles hold exactly."""
    out = []
    columns = [[int(v) for v in vectors[:, c]] for c in range(vectors.shape[1])]
    for at in range(queries.shape[1]):
        query = [int(v) for v in queries[:, at]]
        scored = (
            (-sum(a * b for a, b in zip(query, columns[c])), ids[c], c)
            for c in range(len(columns))
            if ids[c] != query_ids[at]
        )
        for score, _, c in sorted(scored)[:k]:
            out.append((at, c, max(-(2**63), min(2**63 - 1, -score))))
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best other rows for every row that ``is_query`` holds for."""
    rows = (
        vectors.select(
            F.col(id_col).alias("_id"), quantised(vector_col).alias("_vector"), F.coalesce(is_query, F.lit(False)).alias("_query")
        )
        .filter(F.col("_vector").isNotNull() & F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.min("_vector").alias("_vector"), F.max("_query").alias("_query"))
        .withColumn("_dims", F.size("_vector"))
    )
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_query").alias("q")).first()
    query_blocks, blocks = sizes["q"] // QUERY_ROWS + 1, sizes["n"] // CANDIDATE_ROWS + 1

    def dealt(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        return df.select(
            "_dims",
            F.pmod(F.xxhash64("_id"), F.lit(own_blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other),
            "_id",
            "_vector",
        )

    asked = dealt(rows.filter("_query"), "_i", query_blocks, "_j", blocks)
    offered = dealt(rows, "_j", blocks, "_i", query_blocks)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "_id": [], "score": []}).astype("int64")
        queries, candidates = np.stack(left["_vector"]).T, np.stack(right["_vector"]).T
        query_ids, ids = left["_id"].to_numpy(), right["_id"].to_numpy()
        dims = len(queries)
        largest = np.abs(queries.astype(float)).max(initial=0) * np.abs(candidates.astype(float)).max(initial=0)
        search = search_block if dims * largest < EXACT else exact_block
        if search is search_block:
            queries, candidates = queries.astype(float), candidates.astype(float)
        found = search(queries, query_ids, candidates, ids, k)
        return pd.DataFrame(
            {
                "query_id": query_ids[[f[0] for f in found]],
                "_id": ids[[f[1] for f in found]],
                "score": np.array([f[2] for f in found], np.int64),
            }
        )

    kind = rows.schema["_id"].dataType.simpleString()
    keys = ["_dims", "_i", "_j"]
    found = (
        asked.groupBy(*keys)
        .cogroup(offered.groupBy(*keys))
        .applyInPandas(work, f"query_id {kind}, _id {kind}, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("_id").alias(id_col), "score")
    )

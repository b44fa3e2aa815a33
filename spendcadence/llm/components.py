"""Connected components by alternating large-star and small-star rounds, all in DataFrames.

Every round writes its edges to the shared checkpoint folder, removes those of the round before, and stops when nothing changes.  The neighbours
of a node are never gathered: the smallest neighbour is a pre-aggregated minimum that joins back to the edges,
in a join whose both sides are shuffled for it, so that the edges of a hub can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcadence.llm.shared import removed, written

ROUND_ROWS = 20_000  # edges of a round in one of its files


def hub_join(rows: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """Join a narrow table that was aggregated by ``key`` back to rows of which one key may hold very many.

    The second, redundant key keeps the aggregate's own partitioning from being used for the join, which would
    stop adaptive execution from splitting a hot key's partition.
    """
    again = F.xxhash64(key)
    return rows.withColumn("_again", again).join(by_key.withColumn("_again", again), [key, "_again"]).drop("_again")


def large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour (or the node itself)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        hub_join(both, least, "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them; edges point to smaller nodes."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = hub_join(edges, least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node ``a`` of the edges (a, b) that isn't the smallest of its component ``b``."""
    edges = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = state(edges)
    while before[0]:
        # Rounds over few edges write few files, however many partitions a shuffle has.
        last, edges = edges, written(small_star(large_star(edges)).coalesce(before[0] // ROUND_ROWS + 1))
        after = state(edges)
        removed(last)
        if after == before:
            break
        before = after
    return edges

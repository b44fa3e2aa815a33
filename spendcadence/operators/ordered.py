"""Ordered-series helpers that keep a hot key from landing in one task.

A window or a ``collect_list`` per key puts the whole key into one task.  Here a
key with more than ``hot_rows`` rows is cut into blocks that follow the series
order; only one small edge row per block is then windowed per key.

* Blocks are ``(order value, seq div block_rows)``.  ``seq`` is unique within a
  key, so a block holds at most ``block_rows`` rows.  The cut is a pure function
  of the row, so every branch of a plan and every retried task agrees on it.
* At most ``rows / hot_rows`` keys can be hot.  With the default of one million
  that is a million keys (tens of MB) even for 10**12 rows, which is the size
  bound behind the broadcast of the hot-key list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
BLOCK_ROWS = 1_000_000
TOGETHER = 1 << 18  # rows of series that are folded next to each other

BLOCK = ["_block", "_part"]


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: a map-side combined count, tiny output."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows).select(*keys)


def mark_blocks(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    part: Column,
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``_block`` / ``_part``: null / 0 for ordinary keys, the block id for hot ones."""
    hot = hot_keys(df, keys, hot_rows) if hot is None else hot
    flagged = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), list(keys), "left")
    return flagged.withColumns(
        {
            "_block": F.when(F.col("_hot"), block),
            "_part": F.when(F.col("_hot"), part).otherwise(F.lit(0)).cast("bigint"),
        }
    ).drop("_hot")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    seq: str,
    value: str,
    name: str,
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``name`` = ``value`` of the preceding row of the key in (day, seq) order.

    ``value`` must not be null.  One shuffle of the rows, on (key, block): the
    edge rows are aggregated from the same exchange (the test for hot blocks is
    on an aggregate, so that it is not pushed below it), and the carry join
    reuses that partitioning.
    """
    part = F.floor(F.col(seq) / block_rows).cast("long")
    marked = mark_blocks(df, keys, F.col(day), part, hot=hot, hot_rows=hot_rows)
    groups = [*keys, *BLOCK]
    series = Window.partitionBy(*groups).orderBy(day, seq)
    inside = marked.withColumn(name, F.lag(value).over(series))
    edges = (
        marked.groupBy(*groups)
        .agg(F.max_by(value, F.struct(day, seq)).alias("_last"), F.max("_block").alias("_cut"))
        .filter(F.col("_cut").isNotNull())
        .drop("_cut")
    )
    carried = edges.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(*BLOCK))).drop("_last")
    return (
        inside.join(carried, groups, "left")
        .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
        .drop("_carry", *BLOCK)
    )


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    part: Column,
    name: str,
    hot_rows: int = HOT_ROWS,
    *,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``name`` = 1-based position of the row in its key.

    ``(block, part)`` must not decrease along ``order``; a row's rank is its
    position in its block plus the row count of the blocks before it.
    """
    marked = mark_blocks(df, keys, block, part, hot=hot, hot_rows=hot_rows)
    groups = [*keys, *BLOCK]
    inside = marked.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    # Only hot keys have blocks: where there are none, adaptive execution leaves this branch out before it reads a row.
    sizes = marked.filter(F.col("_block").isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        inside.join(offsets, groups, "left")
        .withColumn(name, (F.col(name) + F.coalesce(F.col("_offset"), F.lit(0))).cast("int"))
        .drop("_offset", *BLOCK)
    )


def with_split_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """:func:`with_rank` for any order: a hot key is cut at seams drawn from its own ``order`` values.

    A hash of the values draws one in ``hot_rows / 2`` of them, so that every branch of a plan and every retried task
    agrees on the seams.  Blocks hold ``hot_rows / 2`` rows on average, however the values are distributed; only rows that
    agree in all of ``order`` stay together.  Seams of all hot keys number about 2 * rows / ``hot_rows``, which bounds
    their broadcast.  Where no key is hot, adaptive execution removes this part.
    """
    place = F.struct(*order)
    hot = hot_keys(df, keys, hot_rows)
    drawn = F.pmod(F.xxhash64(*order), F.lit(max(hot_rows // 2, 1))) == 0
    seams = (
        df.join(F.broadcast(hot), list(keys)).filter(drawn).groupBy(*keys).agg(F.collect_set(place).alias("_seams"))
    )
    below = F.size(F.filter("_seams", lambda seam: seam <= place))
    cut = df.join(F.broadcast(seams), list(keys), "left").withColumn(
        "_below", F.when(F.col("_seams").isNull(), 0).otherwise(below)
    ).drop("_seams")
    return with_rank(cut, keys, order, F.lit(0), F.col("_below"), name, hot_rows, hot=hot).drop("_below")


def grouped(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], together: int = TOGETHER
) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Rows that come ordered by ``keys``, as tables of about ``together`` rows.

    With each table come the places where its groups begin, and whether the first goes on with the last group of the
    table before; a long group is never held whole.
    """
    held: list[pa.RecordBatch] = []
    last = None

    def table() -> tuple[pa.Table, np.ndarray, bool]:
        nonlocal last
        rows = pa.Table.from_batches(held)
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in keys:
            code = rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        first = tuple(rows[k][0].as_py() for k in keys)
        goes_on, last = first == last, tuple(rows[k][rows.num_rows - 1].as_py() for k in keys)
        held.clear()
        return rows, np.flatnonzero(new), goes_on

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= together:
                yield table()
    if held:
        yield table()


def side_by_side(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(t, groups of more than t rows) for each t: groups are folded next to each other, a row of each at a time."""
    order = np.argsort(-sizes, kind="stable")
    counts = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    for t, count in enumerate(counts.tolist()):
        yield t, order[:count]
